"""Queries: scans, bills, the fact and the account rules."""

from pyspark.sql import functions as F

from metermill.operators import accounts, facts
from metermill.sources import driver_tables as src
from metermill.sources.values import relation

from . import stages as st
from .oracle_bills import FL, REAL_ACCOUNT, VS
from .registry import out, query
from .sqlkit import P, d, r

BILL_DEC = [c for c in facts.BILL_COLUMNS if c.startswith(("meas_", "bill_"))]
BILL_SQL = ", ".join(r(c, 4) + f" AS {c}" if c in BILL_DEC else f'"{c}"' for c in facts.BILL_COLUMNS)
FACT_VOLS = [
    "vol_meas_water", "vol_meas_sewage", "vol_meas_sewage_real", "vol_meas_sewage_avail",
    "vol_bill_water", "vol_bill_sewage", "vol_bill_sewage_real", "vol_bill_sewage_avail",
]
FACT_ROUND = "REPLACE (" + ", ".join(f"{r(v, 4)} AS {v}" for v in FACT_VOLS) + ")"
HIST_VOLS = [*FACT_VOLS, "vol_meas_water_raw", "vol_bill_water_raw"]
HIST_ROUND = "REPLACE (" + ", ".join(f"{r(v, 4)} AS {v}" for v in HIST_VOLS) + ")"


@query("src_bills", f"SELECT {BILL_SQL}, processed FROM bills WHERE processed = 'S'")
def _(ws):
    return out(facts.src_bills(st.bills(ws)).select(*facts.BILL_COLUMNS, "processed"))


@query("src_registry", "SELECT * FROM registry")
def _(ws):
    return st.registry(ws)


@query("src_dims", """
SELECT office, region, municipality, ibge_full, count(*) AS n_bills, count(DISTINCT category_detail) AS n_details
FROM fact JOIN category_map USING (category_code) JOIN geo USING (office) GROUP BY ALL""")
def _(ws):
    rows = accounts.jn_map_inner(st.fact(ws), st.cmap(ws)).groupBy("office").agg(
        F.count("*").alias("n_bills"), F.countDistinct("category_detail").alias("n_details")
    )
    return rows.join(st.geo(ws), "office")


@query("prj_dedup", f"SELECT {BILL_SQL} FROM clean_bills")
def _(ws):
    return out(facts.prj_dedup(st.bills(ws)))


@query("prj_item", "SELECT item_code, water_item, sewage_item, count(*) AS n FROM flagged GROUP BY ALL")
def _(ws):
    return facts.prj_item(st.clean_bills(ws)).groupBy("item_code", "water_item", "sewage_item").agg(
        F.count("*").alias("n")
    )


@query("prj_flags", "SELECT sewage_item, is_water, is_sewage, is_avail, count(*) AS n FROM flagged GROUP BY ALL")
def _(ws):
    return facts.prj_flags(st.clean_bills(ws)).groupBy(
        "sewage_item", "is_water", "is_sewage", "is_avail"
    ).agg(F.count("*").alias("n"))


@query("prj_classify", """
SELECT category_code, item_code, product_code, benefit_type, class_code, usage_code, count(*) AS n FROM coded GROUP BY ALL""")
def _(ws):
    return facts.classified(st.clean_bills(ws)).groupBy(
        "category_code", "item_code", "product_code", "benefit_type", "class_code", "usage_code"
    ).agg(F.count("*").alias("n"))


@query("flt_pattern", r"""
SELECT class_code, class_code LIKE '%SOC\_50%' ESCAPE '\' AS is_soc_50, class_code NOT LIKE '%\_COMER%' ESCAPE '\' AS not_comer,
  regexp_matches(class_code, '(_PRO|CON_PR|PUB_PR)') AS is_program, count(*) AS n_bills FROM clean_bills GROUP BY class_code""")
def _(ws):
    return facts.flt_pattern(st.clean_bills(ws))


@query("win_latest", "SELECT account, territory FROM latest")
def _(ws):
    return st.latest(ws)


@query("jn_latest", """
SELECT b.account, b.contract, b."year", b."month", l.territory, count(*) AS n
FROM clean_bills b LEFT JOIN latest l ON b.account = l.account GROUP BY ALL""")
def _(ws):
    # several bills of a contract fold before the join
    rows = st.clean_bills(ws).groupBy("account", "contract", "year", "month").agg(F.count("*").alias("n"))
    return facts.jn_latest(rows, st.latest(ws)).select("account", "contract", "year", "month", "territory", "n")


@query("agg_account_month", f"SELECT * {FACT_ROUND} FROM fact")
def _(ws):
    f = facts.agg_account_month(facts.classified(st.clean_bills(ws)), st.latest(ws))
    return out(f)


@query("flt_account", f'SELECT count(*) AS n_rows, count(DISTINCT account) AS n_accounts, {r("sum(vol_meas_water)", 4)} AS vol FROM fact WHERE {REAL_ACCOUNT}')
def _(ws):
    return out(facts.flt_account(st.fact(ws)).agg(
        F.count("*").alias("n_rows"), F.countDistinct("account").alias("n_accounts"), F.sum("vol_meas_water").alias("vol")
    ))


@query("prj_yyyymm", f"""
SELECT account, "year" * 100 + "month" AS yyyymm, {r("sum(vol_meas_water)", 4)} AS vol FROM fact
WHERE "year" * 100 + "month" BETWEEN {P.size.ref_from} AND {P.size.ref_to} GROUP BY ALL""")
def _(ws):
    rows = facts.prj_yyyymm(st.fact(ws), ws.params.size.ref_from, ws.params.size.ref_to)
    return out(rows.groupBy("account", "yyyymm").agg(F.sum("vol_meas_water").alias("vol")))


@query("jn_map_inner", """
SELECT category_code, category_name, category_detail, category, count(*) AS n FROM fact JOIN category_map USING (category_code) GROUP BY ALL""")
def _(ws):
    return accounts.jn_map_inner(st.fact(ws), st.cmap(ws)).groupBy(
        "category_code", "category_name", "category_detail", "category"
    ).agg(F.count("*").alias("n"))


@query("jn_geo_left", """
SELECT account, office, region, municipality, count(*) AS n FROM fact LEFT JOIN geo USING (office) GROUP BY ALL""")
def _(ws):
    return accounts.jn_geo_left(st.fact(ws), st.geo(ws)).groupBy("account", "office", "region", "municipality").agg(
        F.count("*").alias("n")
    )


@query("agg_ref", f"SELECT * REPLACE ({r('vol_median_ref', 4)} AS vol_median_ref, {r('vol_max_ref', 4)} AS vol_max_ref) FROM acc_ref")
def _(ws):
    return out(accounts.agg_ref(st.fact(ws), st.cmap(ws), st.geo(ws), ws.params.size))


@query("agg_series_total", f"SELECT category_detail, region, {r('vol_series_ref', 4)} AS vol_series_ref FROM acc_total")
def _(ws):
    return out(accounts.agg_series_total(st.ref(ws)))


@query("jn_series_using", f"""
SELECT account, category_detail, region, {r('vol_median_ref', 4)} AS vol_median_ref, {r('vol_series_ref', 4)} AS vol_series_ref,
  {r('share_min', 4)} AS share_min, {r('v_min', 4)} AS v_min
FROM acc_ref JOIN acc_total USING (category_detail, region) LEFT JOIN acc_limits USING (category_detail)""")
def _(ws):
    rf = st.ref(ws)
    j = accounts.jn_series_using(rf, accounts.agg_series_total(rf), accounts.thresholds(ws.spark, ws.params.size))
    return out(j.select("account", "category_detail", "region", "vol_median_ref", "vol_series_ref", "share_min", "v_min"))


SIZE_ROUND = "REPLACE (" + ", ".join(
    f"{r(c, 6)} AS {c}" for c in ("vol_median_ref", "vol_max_ref", "vol_series_ref", "share_series")) + ")"


@query("agg_size", f"SELECT * {SIZE_ROUND} FROM acc_size")
def _(ws):
    return out(st.sized(ws), 6)


@query("win_main_cat", f"SELECT * {SIZE_ROUND} FROM size_cls")
def _(ws):
    return out(accounts.win_main_cat(st.sized(ws)), 6)


@query("agg_size_summary", f"""
SELECT category_detail, count(*) FILTER (size_class = 'Grande') AS n_large, count(*) AS n_accounts,
  {r("100 * sum(CASE WHEN size_class = 'Grande' THEN vol_median_ref END) / nullif(sum(vol_median_ref), 0)", 1)} AS pct_volume_large
FROM size_cls GROUP BY 1""")
def _(ws):
    return accounts.agg_size_summary(st.size(ws))


@query("agg_absurd_cand", f"SELECT * REPLACE ({', '.join(r(v, 4) + f' AS {v}' for v in VS)}) FROM absurd_cand")
def _(ws):
    return out(accounts.agg_absurd_cand(st.fact(ws), ws.params.absurd))


@query("jn_semi_in", f"""
SELECT account, count(*) AS n, {r("sum(vol_meas_water)", 4)} AS vol FROM fact
WHERE account IN (SELECT account FROM absurd_cand) GROUP BY account""")
def _(ws):
    f = facts.flt_account(st.fact(ws))
    j = accounts.jn_semi_in(f, accounts.agg_absurd_cand(st.fact(ws), ws.params.absurd))
    return out(j.groupBy("account").agg(F.count("*").alias("n"), F.sum("vol_meas_water").alias("vol")))


FAC = [*VS, *(f"median_{v}" for v in VS), *(f"f_{v}" for v in VS)]


@query("agg_absurd_factor", f"SELECT * REPLACE ({', '.join(r(v, 6) + f' AS {v}' for v in FAC)}) FROM factors")
def _(ws):
    return out(accounts.agg_absurd_factor(st.fact(ws), ws.params.absurd), 6)


@query("agg_absurd_summary", 'SELECT "year", count(*) AS account_months, ' + ", ".join(
    r(f"sum({v} * (1 - f_{v}))", 0) + f" AS removed_{v}" for v in VS) + ' FROM factors GROUP BY "year"')
def _(ws):
    return accounts.agg_absurd_summary(st.factors(ws))


@query("jn_factor", f"""
SELECT f.account, f."year", f."month", {r("sum(CAST(vol_meas_water AS DOUBLE) * coalesce(f_meas_water, 1))", 4)} AS vol,
  {r("min(coalesce(f_meas_water, 1))", 6)} AS factor
FROM fact f LEFT JOIN factors c ON f.account = c.account AND f."year" = c."year" AND f."month" = c."month"
GROUP BY ALL""")
def _(ws):
    j = accounts.jn_factor(st.fact(ws), st.factors(ws))
    g = j.groupBy("account", "year", "month").agg(
        F.sum(F.col("vol_meas_water").cast("double") * F.col("f_meas_water")).alias("vol"),
        F.min("f_meas_water").alias("factor"),
    )
    return out(g, 6, vol=4)


@query("jn_large", f"""
SELECT account, count(*) AS n, {r("max(share_series)", 6)} AS share_series FROM fact
JOIN (SELECT account, share_series FROM size_cls WHERE size_class = 'Grande') USING (account) GROUP BY account""")
def _(ws):
    j = accounts.jn_large(st.fact(ws), st.size(ws))
    return out(j.groupBy("account").agg(F.count("*").alias("n"), F.max("share_series").alias("share_series")), 6)


@query("agg_hist", f"SELECT * {HIST_ROUND} FROM hist")
def _(ws):
    return out(accounts.agg_hist(st.fact(ws), st.cmap(ws), st.geo(ws), st.size(ws), st.factors(ws)))


DETAIL = ", ".join(f"{r(f'CAST(vol_{v} AS DOUBLE) * coalesce(f_{v}, 1)', 4)} AS vol_{v}" for v in VS)


@query("prj_large_detail", f"""
SELECT f.account, category_code, dp.category_detail, category, g.region, municipality, ibge_full, office, territory, f."year", f."month",
  {r("vol_median_ref", 4)} AS vol_median_ref, {r("vol_max_ref", 4)} AS vol_max_ref, months_ref, {r("share_series", 4)} AS share_series,
  days, units_water, units_sewage, {DETAIL}
FROM fact f JOIN (SELECT * FROM size_cls WHERE size_class = 'Grande') pt ON f.account = pt.account
LEFT JOIN factors c ON f.account = c.account AND f."year" = c."year" AND f."month" = c."month"
JOIN category_map dp USING (category_code) LEFT JOIN geo g USING (office)""")
def _(ws):
    return out(accounts.prj_large_detail(st.fact(ws), st.cmap(ws), st.geo(ws), st.size(ws), st.factors(ws)))


@query("src_values", f"""
SELECT category_detail, {r("share_min", 4)} AS share_min, {r("v_min", 4)} AS v_min, count(*) AS n_accounts
FROM acc_limits JOIN size_cls USING (category_detail) GROUP BY ALL""")
def _(ws):
    limits = accounts.thresholds(ws.spark, ws.params.size)
    n = st.size(ws).groupBy("category_detail").agg(F.count("*").alias("n_accounts"))
    return out(n.join(F.broadcast(limits), "category_detail"))


@query("jn_params", f"""
SELECT account, "year", "month", {r("meas_water", 4)} AS meas_water FROM acc_month WHERE meas_water >= {P.absurd.floor}""")
def _(ws):
    params = relation(ws.spark, [("floor", "double"), ("ratio", "double")], [(ws.params.absurd.floor, ws.params.absurd.ratio)])
    m = accounts.account_months(facts.flt_account(st.fact(ws))).crossJoin(F.broadcast(params))
    return out(m.where(F.col("meas_water") >= F.col("floor")).select("account", "year", "month", "meas_water"))
