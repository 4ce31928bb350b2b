"""Queries: series months, ABC, validity, rebalancing, covariates, base."""

from pyspark.sql import functions as F

from metermill.operators import covariates, rebalance, territory
from metermill.schemas import SERIES, SERIES_SIZE
from metermill.sources import driver_tables as src

from . import oracle_series as o
from . import stages as st
from .registry import out, query
from .sqlkit import P, d, lit, r


def rounded(cols, digits=4):
    return "REPLACE (" + ", ".join(f"{r(c, digits)} AS {c}" for c in cols) + ")"


ST1 = [*o.VOL4, "vol_meas_water_raw", "vol_bill_water_raw", "vol_meas_water_imputed"]


@query("prj_period", """
SELECT make_date("year", "month", 1) AS period, substr(ibge_full, 1, 6) AS ibge_code, count(*) AS n FROM hist GROUP BY ALL""")
def _(ws):
    return territory.prj_period(st.hist(ws)).groupBy("period", "ibge_code").agg(F.count("*").alias("n"))


@query("prj_sentinel", """
SELECT CASE WHEN trim(territory) IN ('', 'null', 'NULL', '0') THEN NULL ELSE trim(territory) END AS territory, count(*) AS n
FROM registry GROUP BY 1""")
def _(ws):
    return territory.prj_sentinel(st.registry(ws)).groupBy("territory").agg(F.count("*").alias("n"))


@query("flt_excl", f"""
SELECT category_detail, count(*) AS n, {r("sum(vol_meas_water)", 4)} AS vol FROM hist
WHERE category_detail NOT IN ('Atacado', 'Outras', 'Industrial - DF', 'Comercial - DF') GROUP BY 1""")
def _(ws):
    g = territory.flt_excl(st.hist(ws)).groupBy("category_detail")
    return out(g.agg(F.count("*").alias("n"), F.sum("vol_meas_water").alias("vol")))


@query("prj_override", "SELECT ibge_code, region, municipality, office, count(*) AS n FROM hist_dated GROUP BY ALL")
def _(ws):
    rows = territory.flt_excl(territory.prj_sentinel(territory.prj_period(st.hist(ws))))
    return territory.prj_override(rows, st.overrides(ws)).groupBy("ibge_code", "region", "municipality", "office").agg(
        F.count("*").alias("n")
    )


@query("prj_territory", f"""
SELECT category_detail, municipality, territory, territory_filled, count(*) AS n, {r("sum(vol_meas_water)", 4)} AS vol FROM recoded GROUP BY ALL""")
def _(ws):
    rows = territory.prepared(st.hist(ws), st.overrides(ws), ws.params.base)
    g = rows.groupBy("category_detail", "municipality", "territory", "territory_filled")
    return out(g.agg(F.count("*").alias("n"), F.sum("vol_meas_water").alias("vol")))


@query("agg_series_month", f"SELECT * {rounded(ST1)} FROM stage1")
def _(ws):
    return out(territory.agg_series_month(st.hist(ws), st.overrides(ws), ws.params.base))


@query("agg_municipality_12m", f"SELECT municipality, {r('vol', 4)} AS vol FROM mun_vol")
def _(ws):
    return out(st.mun_volume(ws))


@query("win_cum_share", f"SELECT municipality, {r('vol', 6)} AS vol, {r('cum_share', 6)} AS cum_share FROM cum")
def _(ws):
    return out(territory.win_cum_share(st.mun_volume(ws)), 6)


@query("prj_abc", f"SELECT municipality, {r('vol_abc', 6)} AS vol_abc, {r('cum_share', 6)} AS cum_share, abc_class FROM abc")
def _(ws):
    return out(territory.prj_abc(st.mun_volume(ws), ws.params.base), 6)


DQ_ABC = f"SELECT abc_class, count(*) AS municipalities, {r('100 * sum(vol_abc) / sum(sum(vol_abc)) OVER ()', 1)} AS pct_volume FROM abc GROUP BY 1"


@query("dq_abc", DQ_ABC)
def _(ws):
    return territory.dq_abc(st.abc(ws))


@query("win_agg_ratio", f"""
SELECT abc_class, category_detail, {r("100 * sum(vol_meas_water) / sum(sum(vol_meas_water)) OVER ()", 3)} AS pct
FROM stage1 JOIN abc USING (municipality) GROUP BY 1, 2""")
def _(ws):
    from metermill.functions.numeric import percent

    g = st.stage1(ws).join(st.abc(ws), "municipality").groupBy("abc_class", "category_detail").agg(
        F.sum("vol_meas_water").alias("v")
    )
    return g.crossJoin(F.broadcast(g.agg(F.sum("v").alias("t")))).select(
        "abc_class", "category_detail", percent("v", "t", 3).alias("pct")
    )


STATS = f"SELECT * {rounded(['mean_units', 'mean_volume'], 6)} FROM stats"


@query("agg_series_stats", STATS)
def _(ws):
    return out(territory.agg_series_stats(st.stage1(ws), ws.params.base), 6)


@query("prj_validity", f"""
SELECT {o.S7}, last_period, {r("mean_units", 4)} AS mean_units, {r("mean_volume", 4)} AS mean_volume, reason FROM stats WHERE reason IS NOT NULL""")
def _(ws):
    s = territory.agg_series_stats(st.stage1(ws), ws.params.base).where("reason IS NOT NULL")
    return out(s.select(*SERIES, "last_period", "mean_units", "mean_volume", "reason"))


@query("dq_series", f"""
SELECT coalesce(reason, 'válida') AS situation, category_detail, count(*) AS series, {r("sum(mean_volume)", 0)} AS mean_monthly_volume
FROM stats GROUP BY 1, 2""")
def _(ws):
    return territory.dq_series(st.stats(ws))


@query("jn_using7", f"""
SELECT {o.S7}, size_class, period, {r("vol_meas_water", 4)} AS vol_meas_water, reason, {r("mean_volume", 4)} AS mean_volume
FROM stage1 JOIN stats USING ({o.S7})""")
def _(ws):
    j = territory.jn_using7(st.stage1(ws), st.stats(ws))
    return out(j.select(*SERIES_SIZE, "period", "vol_meas_water", "reason", "mean_volume"))


@query("rb_valid", f"SELECT {o.S8}, period, {r('vol_meas_water', 4)} AS vol_meas_water FROM valid")
def _(ws):
    return out(st.valid(ws).select(*SERIES_SIZE, "period", "vol_meas_water"))


@query("agg_share_year", f"SELECT {o.S8}, {r('s', 6)} AS s FROM share_med")
def _(ws):
    return out(rebalance.agg_share_year(st.valid(ws), ws.params.base), 6)


@query("rb_share", f"""
SELECT {o.S8}, {r(f"CASE WHEN s BETWEEN {P.base.share_min} AND {P.base.share_max} THEN s ELSE {P.base.share_default} END", 6)} AS s FROM share_med""")
def _(ws):
    return out(rebalance.rb_share(st.valid(ws), ws.params.base), 6)


BIMV = [c for c in o.BIM if c.startswith("vol")]
BIMI = [c for c in o.BIM if not c.startswith("vol")]
BIM_REPL = "REPLACE (" + ", ".join(f"{r(c, 4)} AS {c}" for c in BIMV) + ", " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in BIMI) + ")"


@query("agg_bimester", f"SELECT * {BIM_REPL} FROM bim")
def _(ws):
    return out(rebalance.agg_bimester(st.valid(ws), ws.params.base))


NEARV = [f"near_{v}" for v in o.VOL4]
NEARI = [f"{s}_{c}" for c in o.STK for s in ("before", "after")]
NEAR_REPL = "REPLACE (" + ", ".join(f"{r(c, 4)} AS {c}" for c in NEARV) + ", " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in NEARI) + ")"


@query("agg_neighbours", f"SELECT * {NEAR_REPL} FROM near")
def _(ws):
    return out(rebalance.agg_neighbours(st.valid(ws), ws.params.base))


@query("jn_using8", f"SELECT {o.S8}, {r('s', 6)} AS s, {r('vol_meas_water', 4)} AS vol_meas_water, {r('near_vol_meas_water', 4)} AS near_vol_meas_water FROM bim_near")
def _(ws):
    j = st.joined8(ws).select(*SERIES_SIZE, "s", "vol_meas_water", "near_vol_meas_water")
    return out(j, 4, s=6)


GRP = [f"group_{v}" for v in o.VOL4] + [f"group_near_{v}" for v in o.VOL4]


@query("win_named_group", f"SELECT {o.S8}, {', '.join(r(c, 4) + f' AS {c}' for c in GRP)} FROM bim_group")
def _(ws):
    return out(rebalance.win_named_group(st.joined8(ws)).select(*SERIES_SIZE, *GRP))


@query("rb_redistribute", f"SELECT {o.S8}, {r('s', 4)} AS s, {', '.join(r(c, 4) + f' AS {c}' for c in o.VOL7)} FROM bim_new")
def _(ws):
    return out(rebalance.rb_redistribute(st.joined8(ws)).select(*SERIES_SIZE, "s", *o.VOL7))


@query("jn_k", f"SELECT {o.S8}, k, {r('vol_meas_water', 4)} AS vol_meas_water FROM bim_new, (SELECT unnest([1, 2]) AS k)")
def _(ws):
    return out(rebalance.jn_k(rebalance.rb_redistribute(st.joined8(ws))).select(*SERIES_SIZE, "k", "vol_meas_water"))


@query("rb_stock", f"SELECT {o.S8}, k, {', '.join(r(c, 4) + f' AS {c}' for c in o.STK)} FROM bim_k")
def _(ws):
    return out(rebalance.rb_stock(rebalance.rb_redistribute(st.joined8(ws))).select(*SERIES_SIZE, "k", *o.STK))


@query("rb_emit", f"SELECT * {rounded(o.ORDER)} FROM stage4")
def _(ws):
    return out(rebalance.rebalance(st.valid(ws), ws.params.base))


@query("set_union", f"SELECT rebalanced, period, count(*) AS n, {r('sum(vol_meas_water)', 3)} AS vol FROM stage4 GROUP BY 1, 2")
def _(ws):
    g = st.stage4(ws).groupBy("rebalanced", "period").agg(F.count("*").alias("n"), F.sum("vol_meas_water").alias("vol"))
    return out(g, 3)


# -- covariates -------------------------------------------------------------


@query("win_cumprod", f"SELECT * {rounded(['monthly', 'index'], 6)} FROM ipca_index")
def _(ws):
    return out(covariates.win_cumprod(src.price_index_monthly(st.order_months(ws))), 6)


@query("agg_tariff", f"SELECT * {rounded(['nominal', 'index', 'real_tariff'], 6)} FROM tariff")
def _(ws):
    return out(st.tariff(ws), 6)


@query("agg_expand_all", f"""
SELECT a.bill_month, a.category_detail, {r("a.percent", 4)} AS percent, count(*) AS n_series
FROM adj_all a JOIN stats s ON a.category_detail = s.category_detail GROUP BY ALL""")
def _(ws):
    p = ws.params.tariff
    a = covariates.agg_expand_all(covariates.adjustments(ws.spark, p), covariates.details(ws.spark, p))
    n = st.stats(ws).groupBy("category_detail").agg(F.count("*").alias("n_series"))
    return out(F.broadcast(a).join(n, "category_detail"))


@query("jn_calendar", f"""
SELECT g.ibge_code, CAST(m AS DATE) AS period, {r("stock", 2)} AS stock
FROM (SELECT DISTINCT ibge_code FROM stage4) g
CROSS JOIN (SELECT unnest(generate_series({lit(P.base.calendar_start)}, (SELECT max(period) FROM stage4), INTERVAL 1 MONTH)) AS m)
LEFT JOIN jobs j ON j.ibge_code = g.ibge_code AND j.period = m""")
def _(ws):
    b = st.stage4(ws)
    grid = covariates.jn_calendar(
        b.select("ibge_code").distinct(), territory.last_period(b), st.jobs(ws), ws.params.base
    )
    return out(grid.select("ibge_code", "period", "stock"), 2)


@query("win_locf", f"SELECT ibge_code, period, {r('jobs', 2)} AS jobs FROM jobs_filled")
def _(ws):
    return out(st.jobs_filled(ws), 2)


@query("prj_key", f"""
SELECT region || '_' || municipality || '_' || office || '_' || category_detail || '_' || territory AS series_key, count(*) AS n FROM stage4 GROUP BY 1""")
def _(ws):
    return covariates.prj_key(st.stage4(ws)).groupBy("series_key").agg(F.count("*").alias("n"))


BASE_DBL = [*o.ORDER, "prec_tot", "temp_med", "jobs", "real_tariff"]


@query("jn_cov", f"SELECT * {rounded(BASE_DBL)} FROM base")
def _(ws):
    b = covariates.jn_cov(st.stage4(ws), st.abc(ws), st.climate(ws), st.jobs_filled(ws), st.tariff(ws))
    return out(b)


@query("flagship", f"""
SELECT region, category_detail, size_class, "year", "month", CAST(sum(conns) AS BIGINT) AS conns, CAST(sum(units) AS BIGINT) AS units,
  {r("sum(vol_meas_water)", 4)} AS vol_meas_water, {r("sum(vol_bill_water)", 4)} AS vol_bill_water,
  {r("sum(vol_meas_water_raw)", 4)} AS vol_meas_water_raw FROM hist GROUP BY ALL""")
def _(ws):
    g = st.hist(ws).groupBy("region", "category_detail", "size_class", "year", "month").agg(
        F.sum("conns").alias("conns"), F.sum("units").alias("units"),
        *[F.sum(c).alias(c) for c in ("vol_meas_water", "vol_bill_water", "vol_meas_water_raw")],
    )
    return out(g)
