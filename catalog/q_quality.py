"""Queries: data-quality reports and the joins, tops and set operations they use."""

from pyspark.sql import functions as F

from metermill.operators import accounts, covariates, facts, quality
from metermill.operators.rebalance import _month
from metermill.schemas import SERIES
from metermill.sources import driver_tables as src
from metermill.streaming import incremental

from . import oracle_series as o
from . import stages as st
from .oracle_bills import SCOPE
from .registry import out, query
from .sqlkit import P, big, cte, d, lit, r, values

B, S, A = P.base, P.size, P.absurd


@query("dq_d1", f"""
SELECT "year", "month", count(*) FILTER (n_bills > 1) AS rows_multi,
  {r("100.0 * count(*) FILTER (n_bills > 1) / count(*)", 2)} AS pct_rows,
  {r("100 * CAST(sum(vol_meas_water) FILTER (n_bills > 1) AS DOUBLE) / nullif(CAST(sum(vol_meas_water) AS DOUBLE), 0)", 2)} AS pct_volume
FROM fact GROUP BY 1, 2""")
def _(ws):
    return quality.dq_d1(st.fact(ws))


cte("multi", 'SELECT DISTINCT account, "year", "month" FROM fact WHERE n_bills > 1')
cte("multi_bills", 'SELECT b.* FROM clean_bills b JOIN multi m ON b.account = m.account AND b."year" = m."year" AND b."month" = m."month"')
cte("bill_order", """
SELECT *, bill_water_pos + bill_water_neg AS vb, CAST(row_number() OVER (PARTITION BY account, "year", "month"
  ORDER BY CASE WHEN bill_water_pos + bill_water_neg < 0 THEN 1 ELSE 0 END, issue_date DESC, contract DESC, meas_water DESC) AS INTEGER) AS bill_order
FROM multi_bills""")


@query("win_bill_order", f'SELECT account, "year", "month", issue_date, contract, {r("meas_water", 4)} AS meas_water, bill_order FROM bill_order')
def _(ws):
    rows = quality.win_bill_order(st.multi_bills(ws))
    return out(rows.select("account", "year", "month", "issue_date", "contract", "meas_water", "bill_order"))


@query("dq_d1b", f"""
SELECT CASE WHEN nc > 0 THEN '1. com estorno (refaturamento)' WHEN dt <= dm * 1.2 THEN '2. mesmo período repetido'
  WHEN dt BETWEEN 25 AND 40 THEN '3. períodos complementares (~1 mês)' ELSE '4. períodos somando > 40 dias' END AS kind,
  count(*) AS account_months, {big("sum(n)")} AS bills, {r("sum(vs)", 4)} AS vol_sum, {r("sum(vl)", 4)} AS vol_last,
  {r("sum(vbb)", 4)} AS vol_bill, {r("sum(vn)", 4)} AS vol_neg
FROM (SELECT account, "year", "month", count(*) AS n, sum(days) AS dt, max(days) AS dm, sum(meas_water) AS vs,
        max(CASE WHEN bill_order = 1 THEN meas_water END) AS vl, sum(vb) AS vbb, sum(bill_water_neg) AS vn,
        count(*) FILTER (vb < 0 OR bill_water_neg < 0) AS nc FROM bill_order GROUP BY 1, 2, 3) GROUP BY 1""")
def _(ws):
    return out(quality.dq_d1b(st.multi_bills(ws)))


cte("top30", f"""
SELECT account, "year", "month", sum(vol_meas_water) AS vol_account_month FROM fact WHERE n_bills > 1 GROUP BY ALL
ORDER BY 4 DESC NULLS LAST, account NULLS FIRST, "year", "month" LIMIT {B.top_n}""")


@query("top_n", f'SELECT account, "year", "month", {r("vol_account_month", 4)} AS vol_account_month FROM top30')
def _(ws):
    return out(quality.top_n(st.fact(ws), ws.params.base.top_n))


D1C = f"""
SELECT DISTINCT {r("vol_account_month", 4)} AS vol_account_month, b.account, b."year", b."month", office, contract, issue_date, days, units,
  {r("meas_water", 4)} AS meas_water, {r("bill_water_pos", 4)} AS bill_water_pos, {r("bill_water_neg", 4)} AS bill_water_neg
FROM bills b JOIN top30 t ON b.account = t.account AND b."year" = t."year" AND b."month" = t."month" WHERE processed = 'S'"""


@query("jn_topk_back", D1C)
def _(ws):
    return out(quality.jn_topk_back(quality.top_n(st.fact(ws), ws.params.base.top_n), st.bills(ws)))


@query("dq_d1c", D1C)
def _(ws):
    return out(quality.dq_d1c(st.fact(ws), st.bills(ws), ws.params.base.top_n))


@query("srt_order", f"""
SELECT category_detail, "year", {r("sum(vol_meas_water)", 3)} AS vol FROM hist GROUP BY ALL ORDER BY 1, 2""")
def _(ws):
    g = st.hist(ws).groupBy("category_detail", "year").agg(F.sum("vol_meas_water").alias("vol"))
    return out(g, 3).orderBy("category_detail", "year")


@query("jn_anti_cat", f"""
SELECT account, category_code, count(*) AS n FROM fact WHERE category_code IS NULL OR category_code NOT IN (SELECT category_code FROM category_map) GROUP BY ALL""")
def _(ws):
    return quality.jn_anti_cat(st.fact(ws), st.cmap(ws)).groupBy("account", "category_code").agg(F.count("*").alias("n"))


@query("dq_d2", f"""
SELECT f.category_code, item_code, count(*) AS n_rows, {r("sum(vol_meas_water)", 4)} AS vol_meas_water
FROM fact f ANTI JOIN category_map m ON f.category_code = m.category_code GROUP BY ALL""")
def _(ws):
    return out(quality.dq_d2(st.fact(ws), st.cmap(ws)))


def geo_raw(ws):
    return src.geo_map_raw(ws.spark, ws.source)


@query("jn_anti_geo", "SELECT account, office, count(*) AS n FROM fact f ANTI JOIN geo_raw g ON f.office = g.office GROUP BY ALL")
def _(ws):
    return quality.jn_anti_geo(st.fact(ws), geo_raw(ws)).groupBy("account", "office").agg(F.count("*").alias("n"))


@query("dq_d3", f"""
SELECT office, {r("CAST(sum(vol_meas_water) AS DOUBLE)", 4)} AS value, 'sem_ibge' AS problem FROM fact f ANTI JOIN geo_raw g ON f.office = g.office GROUP BY 1
UNION ALL SELECT office, CAST(count(*) AS DOUBLE), 'duplicada' FROM geo_raw GROUP BY 1 HAVING count(*) > 1""")
def _(ws):
    return out(quality.dq_d3(st.fact(ws), geo_raw(ws)))


cte("grid", "SELECT share_min, v_min FROM " + values("a", "share_min", [(x,) for x in S.grid_share]) + ", " + values("b", "v_min", [(x,) for x in S.grid_volume]))


@query("src_grid", f"""
SELECT {r("share_min", 4)} AS share_min, {r("v_min", 4)} AS v_min, count(*) FILTER (share_series >= share_min AND vol_median_ref >= v_min) AS n_accounts
FROM size_cls, grid GROUP BY share_min, v_min""")
def _(ws):
    g = quality.src_grid(ws.spark, ws.params.size)
    p = ws.params.size
    cells = st.size(ws).groupBy(
        sum((F.col("share_series") >= F.lit(t)).cast("int") for t in p.grid_share).alias("si"),
        sum((F.col("vol_median_ref") >= F.lit(t)).cast("int") for t in p.grid_volume).alias("vj"),
    ).agg(F.count("*").alias("n"))
    hit = (F.col("si") >= F.col("i")) & (F.col("vj") >= F.col("j"))
    return out(cells.crossJoin(F.broadcast(g)).groupBy("share_min", "v_min").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_accounts")
    ))


@query("dq_d4", f"""
WITH per AS (SELECT account, category_detail, region, coalesce(sum(vol_meas_water) FILTER ("year" = {S.eval_year}), 0)::DOUBLE AS v0,
    coalesce(sum(vol_meas_water) FILTER ("year" = {S.eval_year + 1}), 0)::DOUBLE AS v1
  FROM fact JOIN category_map USING (category_code) LEFT JOIN geo USING (office)
  WHERE {SCOPE} AND "month" <= {S.eval_last_month} AND "year" IN ({S.eval_year}, {S.eval_year + 1}) GROUP BY ALL),
ser AS (SELECT p.category_detail, p.region, g.share_min, g.v_min,
    coalesce(z.share_series, 0) >= g.share_min AND coalesce(z.vol_median_ref, 0) >= g.v_min AND coalesce(z.months_ref, 0) >= {S.min_months} AS big,
    sum(v0) AS v0, sum(v1) AS v1
  FROM per p LEFT JOIN size_cls z USING (account, category_detail, region) CROSS JOIN grid g GROUP BY ALL)
SELECT category_detail, CAST(share_min AS DOUBLE) AS share_min, CAST(v_min AS DOUBLE) AS v_min,
  {r("100 * sum(v0) FILTER (big) / nullif(sum(v0), 0)", 1)} AS pct_volume_large,
  {r("100 * sum(abs(v1 - v0)) FILTER (big) / nullif(sum(v0) FILTER (big), 0)", 2)} AS var_abs_large,
  {r("100 * sum(abs(v1 - v0)) FILTER (NOT big) / nullif(sum(v0) FILTER (NOT big), 0)", 2)} AS var_abs_others,
  {r("100 * sum(abs(v1 - v0)) FILTER (big) / nullif(sum(abs(v1 - v0)), 0)", 1)} AS pct_var_large
FROM ser GROUP BY ALL""")
def _(ws):
    p = ws.params.size
    return quality.dq_d4(st.fact(ws), st.cmap(ws), st.geo(ws), st.size(ws), quality.src_grid(ws.spark, p), p)


# an earlier run: raw volumes, fewer months, one category under another name
cte("snapshot", """
SELECT * REPLACE (CASE category WHEN 'Outras' THEN 'Diversas' ELSE category END AS category,
  vol_meas_water_raw AS vol_meas_water, vol_bill_water_raw AS vol_bill_water) FROM hist WHERE "year" < 2001""")


def snapshot(ws):
    h = st.hist(ws).where("year < 2001")
    return h.withColumns({
        "category": F.when(F.col("category") == "Outras", "Diversas").otherwise(F.col("category")),
        "vol_meas_water": F.col("vol_meas_water_raw"), "vol_bill_water": F.col("vol_bill_water_raw"),
    })


def _tot(tag):
    return f"""(SELECT "year", "month", category, sum(vol_meas_water) AS {tag}m, sum(vol_bill_water) AS {tag}b,
      sum(vol_meas_water_raw) AS {tag}r, CAST(sum(units_water) AS BIGINT) AS {tag}u FROM {'hist' if tag == 'n' else 'snapshot'} GROUP BY ALL)"""


FULL = f"FROM {_tot('n')} n FULL JOIN {_tot('o')} o USING (\"year\", \"month\", category)"


@query("jn_full", f'SELECT "year", "month", category, {r("nm", 4)} AS new_vol, {r("om", 4)} AS old_vol {FULL}')
def _(ws):
    j = quality.jn_full(st.hist(ws), snapshot(ws))
    return out(j.select("year", "month", "category", F.col("new_vol_meas_water").alias("new_vol"), F.col("old_vol_meas_water").alias("old_vol")))


def _chg(a, b):
    return r(f"100 * ({a} / nullif({b}, 0) - 1)", 3)


@query("dq_d5", f"""
SELECT "year", "month", category, {r("om", 4)} AS vol_meas_before, {r("nm", 4)} AS vol_meas_new, {_chg("nm", "om")} AS pct_change_meas,
  {_chg("nr", "om")} AS pct_change_meas_raw, {r("ob", 4)} AS vol_bill_before, {r("nb", 4)} AS vol_bill_new, {_chg("nb", "ob")} AS pct_change_bill,
  ou AS units_before, nu AS units_new {FULL}""")
def _(ws):
    return quality.dq_d5(st.hist(ws), snapshot(ws))


@query("dq_d6", f"""
WITH d6 AS (SELECT account, "year", "month", CAST(sum(vol_meas_water) AS DOUBLE) AS vol, CAST(sum(vol_bill_water) AS DOUBLE) AS vol_bill, max(office) AS office,
    max(category_code) AS category_code, max(units_water) AS units, {big("sum(n_bills)")} AS bills
  FROM fact WHERE account IS NOT NULL AND account <> '-1' GROUP BY 1, 2, 3 HAVING sum(vol_meas_water) >= {A.floor}),
med AS (SELECT account, quantile_cont(meas_water, 0.5) AS median, count(*) AS months FROM acc_month WHERE account IN (SELECT account FROM d6) GROUP BY 1),
tot AS (SELECT "year", "month", CAST(sum(vol_meas_water) AS DOUBLE) AS t FROM fact GROUP BY 1, 2)
SELECT c."year", c."month", account, office, category_code, units, bills, {r("vol", 4)} AS vol, {r("vol_bill", 4)} AS vol_bill, {r("median", 4)} AS median, months,
  {r("vol / greatest(median, 1)", 1)} AS ratio_median, {r("vol - median", 4)} AS excess, {r("100 * (vol - median) / t", 2)} AS pct_excess_month
FROM d6 c JOIN med USING (account) JOIN tot USING ("year", "month") WHERE vol >= {A.ratio} * greatest(median, 1)""")
def _(ws):
    return quality.dq_d6(st.fact(ws), ws.params.absurd)


cte("cycle", f"""
SELECT account, make_date("year", "month", 1) AS period, {big("sum(n_bills)")} AS bills, max(days) AS days,
  CAST(sum(vol_meas_water) AS DOUBLE) AS vol, CAST(sum(vol_bill_water) AS DOUBLE) AS vol_bill FROM fact
WHERE "year" * 100 + "month" BETWEEN {B.cycle_from} AND {B.cycle_to} AND account IS NOT NULL AND account <> '-1' GROUP BY 1, 2""")


@query("dq_d7a", f"""
SELECT period, count(*) AS accounts, {r("sum(vol)", 0)} AS vol_meas, {d("quantile_cont(days, 0.5)")} AS days_median,
  {r("100 * avg(CASE WHEN bills > 1 THEN 1 ELSE 0 END)", 2)} AS pct_two_bills, {r("100 * avg(CASE WHEN days > 45 THEN 1 ELSE 0 END)", 2)} AS pct_over_45_days,
  {r("100 * sum(vol) FILTER (days > 45) / nullif(sum(vol), 0)", 2)} AS pct_vol_over_45_days,
  {r("100 * avg(CASE WHEN vol = 0 AND vol_bill > 0 THEN 1 ELSE 0 END)", 2)} AS pct_unread FROM cycle GROUP BY 1""")
def _(ws):
    return quality.dq_d7a(st.fact(ws), ws.params.base)


cte("holes", """
SELECT a.account, CAST(a.period + INTERVAL 1 MONTH AS DATE) AS hole_month, a.vol AS vol_before, c.vol AS vol_after, c.bills AS bills_after, c.days AS days_after
FROM cycle a JOIN cycle c ON c.account = a.account AND c.period = a.period + INTERVAL 2 MONTH
ANTI JOIN cycle m ON m.account = a.account AND m.period = a.period + INTERVAL 1 MONTH""")


@query("jn_hole", f"SELECT account, hole_month, {r('vol_before', 4)} AS vol_before, {r('vol_after', 4)} AS vol_after, bills_after, days_after FROM holes")
def _(ws):
    return out(quality.account_holes(st.fact(ws), ws.params.base))


@query("dq_d7b", f"""
SELECT hole_month, count(*) AS accounts, {r("sum(vol_before)", 0)} AS vol_month_before, {r("sum(vol_after) / nullif(sum(vol_before), 0)", 2)} AS ratio_next_before,
  {r("avg(bills_after)", 2)} AS bills_next_month, {d("quantile_cont(days_after, 0.5)")} AS days_next_median,
  {r("100 * avg(CASE WHEN days_after > 45 THEN 1 ELSE 0 END)", 1)} AS pct_long_bill FROM holes GROUP BY 1""")
def _(ws):
    return quality.dq_d7b(st.fact(ws), ws.params.base)


@query("dq_c1", f"""
WITH h AS (SELECT make_date("year", "month", 1) AS period, sum(vol_meas_water) AS total,
    sum(CASE WHEN category_detail IN ('Atacado', 'Outras', 'Industrial - DF', 'Comercial - DF') THEN vol_meas_water ELSE 0 END) AS exc FROM hist GROUP BY 1),
e AS (SELECT period, sum(vol_meas_water) AS s1, sum(vol_meas_water_imputed) AS imp, sum(CASE WHEN reason IS NOT NULL THEN vol_meas_water ELSE 0 END) AS inv
  FROM stage1 JOIN stats USING ({o.S7}) GROUP BY 1),
f AS (SELECT period, sum(vol_meas_water) AS fin FROM base GROUP BY 1)
SELECT period, {r("total", 0)} AS total, {r("100 * exc / total", 2)} AS pct_excluded, {r("100 * inv / total", 3)} AS pct_invalid,
  {r("100 * imp / total", 3)} AS pct_imputed, {r("total - exc - s1", 0)} AS diff_stage1, {r("fin", 0)} AS final
FROM h JOIN e USING (period) LEFT JOIN f USING (period)""")
def _(ws):
    return quality.dq_c1(st.hist(ws), st.stage1(ws), st.stats(ws), st.base(ws))


@query("dq_c2", "SELECT series_key, size_class, period, count(*) AS n FROM base GROUP BY ALL HAVING count(*) > 1")
def _(ws):
    return quality.dq_c2(st.base(ws))


@query("dq_c3", """
SELECT * FROM (SELECT period, count(*) AS n_rows, count(*) FILTER (prec_tot IS NULL) AS no_prec_tot, count(*) FILTER (temp_med IS NULL) AS no_temp_med,
  count(*) FILTER (jobs IS NULL) AS no_jobs, count(*) FILTER (real_tariff IS NULL) AS no_real_tariff, count(*) FILTER (abc_class IS NULL) AS no_abc_class
FROM base GROUP BY 1) WHERE no_prec_tot + no_temp_med + no_jobs + no_real_tariff + no_abc_class > 0""")
def _(ws):
    return quality.dq_c3(st.base(ws))


@query("dq_c4", f"""
WITH a AS (SELECT category_detail, period, sum(vol_meas_water) AS va, sum(units_water) AS ua FROM valid WHERE period BETWEEN {lit(o.NB)} AND {lit(o.NA)} GROUP BY 1, 2),
b AS (SELECT category_detail, period, sum(vol_meas_water) AS vb, sum(units_water) AS ub FROM base WHERE period BETWEEN {lit(o.NB)} AND {lit(o.NA)} GROUP BY 1, 2)
SELECT category_detail, period, {r("va", 0)} AS vol_before, {r("vb", 0)} AS vol_after, {r("ua", 0)} AS units_before, {r("ub", 0)} AS units_after,
  {r("vb / nullif(ub, 0)", 2)} AS consumption FROM a JOIN b USING (category_detail, period)""")
def _(ws):
    return quality.dq_c4(st.valid(ws), st.base(ws), o.NB, o.NA)


C5_OLD = "SELECT category_detail, period, sum(vol_meas_water) AS vo, sum(units_water) AS uo FROM valid WHERE period < DATE '2001-06-01' GROUP BY 1, 2"


@query("dq_c5", f"""
SELECT category_detail, period, {r("100 * (vn / nullif(vo, 0) - 1)", 2)} AS pct_change_volume, {r("100 * (un / nullif(uo, 0) - 1)", 2)} AS pct_change_units
FROM ({C5_OLD}) FULL JOIN (SELECT category_detail, period, sum(vol_meas_water) AS vn, sum(units_water) AS un FROM base GROUP BY 1, 2) USING (category_detail, period)""")
def _(ws):
    old = st.valid(ws).where("period < DATE'2001-06-01'")
    return quality.dq_c5(old, st.base(ws))


# -- set operations ---------------------------------------------------------


@query("set_bind", f"""
SELECT 'hist' AS origin, "year", category_detail, {r("sum(vol_meas_water)", 3)} AS vol, NULL::DOUBLE AS removed FROM hist GROUP BY ALL
UNION ALL SELECT 'factors', "year", NULL, NULL, {r("sum(meas_water * (1 - f_meas_water))", 3)} FROM factors GROUP BY ALL""")
def _(ws):
    a = st.hist(ws).groupBy("year", "category_detail").agg(F.sum("vol_meas_water").alias("vol"))
    b = st.factors(ws).groupBy("year").agg(F.sum(F.col("meas_water") * (1 - F.col("f_meas_water"))).alias("removed"))
    both = a.withColumn("origin", F.lit("hist")).unionByName(b.withColumn("origin", F.lit("factors")), allowMissingColumns=True)
    return out(both, 3)


@query("set_distinct", "SELECT DISTINCT ibge_code, municipality, region FROM stage1")
def _(ws):
    return st.stage1(ws).select("ibge_code", "municipality", "region").distinct()


@query("set_subset", """
SELECT count(*) AS missing, count(*) = 0 AS is_subset FROM (SELECT DISTINCT office FROM fact) ANTI JOIN geo USING (office)""")
def _(ws):
    return incremental.set_subset(st.fact(ws), st.geo(ws), "office")
