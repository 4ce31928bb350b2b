"""Queries over all segments and targets: decisions, and monthly and annual results.

Each segment x target is a part of the run with its own stages.  In SQL a part is a copy of the expressions that depend on the
segment's categories or the target's columns, made from the originals (``clone``)."""

import functools
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from metermill import rules
from metermill.operators import projection as pj
from metermill.sources import landing

from . import stages as st
from .q_eval import DEC, decision
from .q_model import ATTRS, LVL
from .q_projection import ANNUAL_COLUMNS, MD, monthly
from .registry import out, query
from .sqlkit import CTES, P, clone, cte, inlist, lit, r, values

BT, PJ = P.backtest, P.projection
PARTS = [(f"p{i}{j}", s, t) for i, s in enumerate(P.segments) for j, t in enumerate(rules.TARGETS)]


def part_texts(tag, segment, target):
    """What differs in the expressions of one part."""
    vol, units = rules.TARGETS[target]
    given = {
        "mbase": CTES["mbase"].replace(inlist(BT.categories), inlist(segment.categories)),
        "k_rows": f"SELECT {ATTRS}, period, {vol} AS vol, {units} AS units FROM mbase WHERE {vol} IS NOT NULL AND {units} > 0",
        "decision": CTES["decision"].replace(lit(BT.segment), lit(segment.name)).replace("'med_agua'", lit(target)),
        "inc": CTES["inc"].replace("'AGUA'", lit(pj.service_of(target))),
        "upremise": CTES["upremise"].replace("'AGUA'", lit(pj.service_of(target))),
        "month_result": CTES["month_result"].replace(lit(BT.segment), lit(segment.name)).replace("'med_agua'", lit(target)),
        "pchoice": f"SELECT category_detail, grouping, model FROM part_choice WHERE segment = {lit(segment.name)} AND target = {lit(target)}",
    }
    level = ", ".join(segment.units_level)
    for name in ("lvl_now", "lvl_sum", "lvl_full", "lvl", "ud_y", "ud_grid", "ud_opt", "ud_best", "ud_fc", "ukey"):
        joined = [" AND ".join(f"f.{c} = n.{c}" for c in cols) for cols in (LVL.split(", "), segment.units_level)]
        given[name] = CTES[name].replace(joined[0], joined[1]).replace(LVL, level)
    if segment.clean_units:
        clone(f"{tag}u", {**given, "c1": CTES["c1"].replace("consumption", "units")}, ["c7"])
        attrs = ", ".join(f"a.{c}" for c in ATTRS.split(", "))

        def cleaned(t):
            return f"CASE WHEN {t}.inside AND {t}.obs >= 4 THEN CASE WHEN {t}.ok IS NOT NULL THEN {t}.x ELSE exp({t}.z + {t}.s) END ELSE {t}.x END"

        given["keys0"] = f"""
SELECT {attrs}, a.period, a.vol, a.units, a.consumption, coalesce({cleaned("u")}, a.units) AS units_adj, coalesce({cleaned("a")}, a.consumption) AS consumption_adj
FROM c7 a JOIN c7__{tag}u u ON u.series_key = a.series_key AND u.period = a.period WHERE a.units IS NOT NULL"""
    return given


def union_of(name, columns="*"):
    return " UNION ALL ".join(f"SELECT {columns} FROM {name}__{tag}" for tag, _, _ in PARTS)


for _tag, _segment, _target in PARTS:
    clone(_tag, part_texts(_tag, _segment, _target), ["decision", "month_result"])
cte("part_decision", union_of("decision"))
cte("part_categories", " UNION ALL ".join(
    f"SELECT DISTINCT {lit(s.name)} AS segment, category_detail FROM mbase__p{i}0" for i, s in enumerate(P.segments)))
# the backtest covers the measured targets, and not one of the categories: the sibling's choice and the default come into play
cte("part_backtest", f"SELECT * FROM part_decision WHERE target IN {inlist(BT.targets)} AND category_detail <> 'Industrial'")
cte("part_choice", f"""
SELECT c.segment, t.target, c.category_detail, coalesce(a.grouping, b.grouping, {lit(PJ.default_choice[0])}) AS grouping,
  coalesce(a.model, b.model, {lit(PJ.default_choice[1])}) AS model,
  CASE WHEN a.model IS NOT NULL THEN 'backtest' WHEN b.model IS NOT NULL THEN 'backtest (' || t.sibling || ')' ELSE 'padrão' END AS source, 'consumo/economia' AS model_kind
FROM part_categories c CROSS JOIN {values("t", "target, sibling", [(t, rules.MEASURED_SIBLING.get(t, t)) for t in rules.TARGETS])}
LEFT JOIN part_backtest a ON a.segment = c.segment AND a.target = t.target AND a.category_detail = c.category_detail
LEFT JOIN part_backtest b ON b.segment = c.segment AND b.target = t.sibling AND b.category_detail = c.category_detail""")


def of_parts(ws, make):
    """Rows of every segment x target that ``make`` has already named."""
    return functools.reduce(DataFrame.unionByName, st.each_part(ws, make, tuple(rules.TARGETS)))


def decisions(ws):
    return of_parts(ws, decision)


def part_choices(ws):
    """Grouping and model of every category of every segment x target."""

    def make():
        dec = decisions(ws).where(F.col("target").isin(*ws.params.backtest.targets) & (F.col("category_detail") != "Industrial"))
        found = []
        for s in ws.params.segments:
            cats = st.mbase(ws.part(ws.params.part(s, ws.params.backtest.targets[0]))).select("category_detail").distinct()
            found.append(landing.src_decision(ws.spark, dec, cats, s.name, ws.params.projection))
        return functools.reduce(DataFrame.unionByName, found)

    # made before the stage is entered: the parts run side by side and need the workspace's own stages
    rows = None if ws.has("part_choices") else make()
    return ws.stage("part_choices", lambda: rows)


def results(ws):
    part_choices(ws)  # the parts read it
    return of_parts(ws, monthly)


@query("sel_decision", f"SELECT * REPLACE ({', '.join(r(c, 5) + f' AS {c}' for c in DEC)}) FROM part_decision")
def _(ws):
    return out(decisions(ws), 5)


@query("src_decision", "SELECT * FROM part_choice")
def _(ws):
    return part_choices(ws)


MANUAL = (("Nao_Residencial", "med_esg", "Pública", "G2_superintendencia", "vol_arima_2"), ("Residencial", "fat_agua", "Residencial Normal", "G3_municipio", "arima_0"),
          ("Nao_Residencial", "med_esg", "Inexistente", "G2_superintendencia", "arima_0"))


@query("jn_override", f"""
SELECT segment, target, category_detail, coalesce(m.g, grouping) AS grouping, coalesce(m.m, model) AS model, CASE WHEN m.m IS NULL THEN source ELSE 'manual' END AS source,
  CASE WHEN coalesce(m.m, model) LIKE 'vol_%' THEN 'volume' ELSE 'consumo/economia' END AS model_kind
FROM part_choice LEFT JOIN {values("m", "segment, target, category_detail, g, m", MANUAL)} USING (segment, target, category_detail)""")
def _(ws):
    p = replace(ws.params.projection, manual_choice=MANUAL)
    return landing.jn_override(part_choices(ws), landing.manual_choices(ws.spark, p))


MONTHLY = f"SELECT segment, target, scenario, region_adj, category_detail, territory, period, kind, {MD}, {r('vol / nullif(units, 0)', 4)} AS consumption FROM part_month"
cte("part_month", union_of("month_result"))


@query("agg_mensal", MONTHLY)
def _(ws):
    return out(results(ws))


@query("agg_annual", ANNUAL_COLUMNS + " (" + CTES["annual0"].replace("month_result", "part_month") + ")")
def _(ws):
    return out(pj.agg_annual(results(ws)), var_vol=6, var_units=6, var_consumption=6)


@query("agg_imputed_share", f"""
SELECT segment, target, scenario, period, {r("sum(CASE WHEN kind = 'IMPUTADO' THEN vol ELSE 0 END) / nullif(sum(vol), 0)", 6)} AS imputed_share, {r("sum(vol)", 4)} AS vol
FROM part_month WHERE kind <> 'PROJ' GROUP BY 1, 2, 3, 4""")
def _(ws):
    return out(pj.agg_imputed_share(results(ws)), 6, vol=4)
