"""Oracle relations: series, ABC, validity, rebalancing, covariates, base."""

from metermill import rules
from metermill.operators.rebalance import _month
from metermill.sources import driver_tables as dt

from .sqlkit import P, big, cte, d, inlist, lit, r, values

B, T, C = P.base, P.tariff, P.covariates
S7 = "region, municipality, ibge_code, office, category, category_detail, territory"
S8 = S7 + ", size_class"
VOL4 = ["vol_meas_water", "vol_meas_sewage", "vol_bill_water", "vol_bill_sewage"]
STK = ["units_water", "units_sewage", "conns_water", "conns_sewage"]
SUMS = [*VOL4, *STK, "n_bills", "days", "vol_meas_water_raw", "vol_bill_water_raw"]
W1, W2 = B.window_start, _month(B.window_start, 1)
NB, NA = _month(B.window_start, -1), _month(B.window_start, 2)

cte("overrides", "SELECT * FROM " + values("t", "ibge_code, o_region, o_municipality, o_office", B.overrides))
cte("hist_dated", f"""
SELECT coalesce(o_region, region) AS region, coalesce(o_municipality, municipality) AS municipality,
  CAST(coalesce(o_office, office) AS INTEGER) AS office, substr(ibge_full, 1, 6) AS ibge_code, h.* EXCLUDE (region, municipality, office, territory),
  make_date("year", "month", 1) AS period,
  CASE WHEN trim(territory) IN ('', 'null', 'NULL', '0') THEN NULL ELSE trim(territory) END AS t0
FROM hist h LEFT JOIN overrides a ON substr(h.ibge_full, 1, 6) = a.ibge_code
WHERE make_date("year", "month", 1) >= {lit(B.first_period)} AND category_detail NOT IN {inlist(rules.EXCLUDED_DETAILS)}
""")
cte("recoded", f"""
SELECT h.*, CASE WHEN category <> 'Residencial' THEN 'Total' WHEN t0 IS NULL THEN {lit(B.default_territory)}
   WHEN category_detail LIKE 'Residencial Social%' AND t0 = 'Rural' THEN CASE WHEN has_informal THEN 'Informal' ELSE 'Urbano' END
   ELSE t0 END AS territory, category = 'Residencial' AND t0 IS NULL AS territory_filled
FROM hist_dated h JOIN (SELECT municipality, bool_or(t0 = 'Informal') AS has_informal FROM hist_dated GROUP BY 1) USING (municipality)
""")
cte("stage1", f"""
SELECT {S8}, period, {", ".join((big(f"sum({c})") if not c.startswith("vol") else f"sum({c})") + f" AS {c}" for c in SUMS)},
  sum(CASE WHEN territory_filled THEN vol_meas_water ELSE 0 END) AS vol_meas_water_imputed
FROM recoded GROUP BY {S8}, period
""")
cte("mun_vol", f"""
SELECT municipality, sum(vol_meas_water) AS vol FROM stage1
WHERE period > (SELECT max(period) FROM stage1) - INTERVAL {B.abc_months} MONTH GROUP BY 1
""")
cte("cum", "SELECT municipality, vol, sum(vol) OVER (ORDER BY vol DESC, municipality ROWS UNBOUNDED PRECEDING) / sum(vol) OVER () AS cum_share FROM mun_vol")
cte("abc", f"SELECT municipality, vol AS vol_abc, cum_share, CASE WHEN cum_share <= {B.abc_cut_a} THEN 'A' WHEN cum_share <= {B.abc_cut_b} THEN 'B' ELSE 'C' END AS abc_class FROM cum")
cte("stats", f"""
SELECT {S7}, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period,
  avg(u) AS mean_units, avg(v) AS mean_volume,
  CASE WHEN max(period) < (SELECT max(period) FROM stage1) - INTERVAL {B.tolerance_months} MONTH THEN 'encerrada'
       WHEN coalesce(avg(u), 0) < {B.min_units} THEN 'poucas economias'
       WHEN coalesce(avg(v), 0) < {B.min_volume} THEN 'pouco volume' END AS reason
FROM (SELECT {S7}, period, sum(units_water) AS u, sum(vol_meas_water) AS v FROM stage1 GROUP BY {S7}, period) GROUP BY {S7}
""")
cte("valid", f"SELECT b.* FROM stage1 b JOIN stats USING ({S7}) WHERE reason IS NULL")
cte("share_year", f"""
SELECT {S8}, year(period) AS yr, sum(CASE WHEN month(period) = {W1.month} THEN vol_meas_water END) / nullif(sum(vol_meas_water), 0) AS s
FROM valid WHERE month(period) IN ({W1.month}, {W2.month}) AND year(period) < {W1.year} GROUP BY {S8}, yr
""")
cte("share_med", f"SELECT {S8}, quantile_cont(s, 0.5) AS s FROM share_year GROUP BY {S8}")
BIM = [*VOL4, "vol_meas_water_raw", "vol_bill_water_raw", "vol_meas_water_imputed", *STK, "n_bills", "days"]
cte("bim", f"SELECT {S8}, {', '.join(f'sum({c}) AS {c}' for c in BIM)} FROM valid WHERE period IN ({lit(W1)}, {lit(W2)}) GROUP BY {S8}")
cte("near", f"""
SELECT {S8}, {", ".join(f"sum({v}) AS near_{v}" for v in VOL4)},
  {", ".join(f"sum({c}) FILTER (period = {lit(NB)}) AS before_{c}, sum({c}) FILTER (period = {lit(NA)}) AS after_{c}" for c in STK)}
FROM valid WHERE period IN ({lit(NB)}, {lit(NA)}) GROUP BY {S8}
""")
N8 = ", ".join(f"near_{v}" for v in VOL4) + ", " + ", ".join(f"before_{c}, after_{c}" for c in STK)
cte("bim_near", f"""
SELECT bim.*, CASE WHEN s BETWEEN {B.share_min} AND {B.share_max} THEN s ELSE {B.share_default} END AS s, {N8}
FROM bim LEFT JOIN share_med USING ({S8}) LEFT JOIN near USING ({S8})
""")
G = "region, municipality, ibge_code, office, category, territory, size_class"
cte("bim_group", f"""
SELECT b.*, {", ".join(f"sum({v}) FILTER (near_{v} > 0) OVER g AS group_{v}, sum(near_{v}) FILTER (near_{v} > 0) OVER g AS group_near_{v}" for v in VOL4)}
FROM bim_near b WINDOW g AS (PARTITION BY {G})
""")
_new = {v: f"CASE WHEN near_{v} > 0 THEN group_{v} * near_{v} / group_near_{v} END" for v in VOL4}
_fm = f"coalesce(({_new['vol_meas_water']}) / nullif(vol_meas_water, 0), 1)"
_fb = f"coalesce(({_new['vol_bill_water']}) / nullif(vol_bill_water, 0), 1)"
cte("bim_new", f"""
SELECT {S8}, s, {", ".join(f"coalesce({e}, {v}) AS {v}" for v, e in _new.items())},
  vol_meas_water_raw * {_fm} AS vol_meas_water_raw, vol_bill_water_raw * {_fb} AS vol_bill_water_raw,
  vol_meas_water_imputed * {_fm} AS vol_meas_water_imputed, {", ".join(STK)}, n_bills, days,
  {", ".join(f"before_{c}, after_{c}" for c in STK)}
FROM bim_group
""")
cte("bim_k", f"""
SELECT * REPLACE ({", ".join(f"coalesce(before_{c} + (after_{c} - before_{c}) * k / 3.0::DOUBLE, {c} / 2.0::DOUBLE) AS {c}" for c in STK)})
FROM bim_new, (SELECT unnest([1, 2]) AS k)
""")
VOL7 = [*VOL4, "vol_meas_water_raw", "vol_bill_water_raw", "vol_meas_water_imputed"]
ORDER = [*VOL4, *STK, "n_bills", "days", "vol_meas_water_raw", "vol_bill_water_raw", "vol_meas_water_imputed"]
cte("stage4", f"""
SELECT {S8}, period, {", ".join(d(c) + f" AS {c}" for c in ORDER)}, FALSE AS rebalanced FROM valid WHERE period NOT IN ({lit(W1)}, {lit(W2)})
UNION ALL BY NAME
SELECT {S8}, CASE k WHEN 1 THEN {lit(W1)} ELSE {lit(W2)} END AS period,
  {", ".join(f"{v} * CASE k WHEN 1 THEN s ELSE 1 - s END AS {v}" for v in VOL7)}, {", ".join(STK)},
  n_bills / 2.0::DOUBLE AS n_bills, days / 2.0::DOUBLE AS days, TRUE AS rebalanced FROM bim_k
""")

# -- covariates -------------------------------------------------------------
cte("nation_orders", f"""
SELECT o_orderkey, o_totalprice, c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period
FROM orders JOIN customer ON o_custkey = c_custkey
""")
cte("climate", f"""
SELECT CAST(350000 + c_nationkey AS VARCHAR) AS ibge_code, period,
  {r("20 + 10 * CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*)", 6)} AS temp_med,
  {r("CAST(0.1 AS DOUBLE) + 100 * CAST(sum(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) / count(*)", 6)} AS prec_tot
FROM lineitem JOIN nation_orders ON l_orderkey = o_orderkey GROUP BY c_nationkey, period
""")
cte("jobs", f"""
SELECT CAST(350000 + c_nationkey AS VARCHAR) AS ibge_code, period,
  {r("CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / 1000", 2)} AS stock
FROM nation_orders GROUP BY c_nationkey, period
""")
cte("ipca", f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
  {r("20 * CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) - CAST(0.5 AS DOUBLE)", 2)} AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
cte("ipca_index", "SELECT period, value AS monthly, 100 * exp(sum(ln(1 + value / 100)) OVER (ORDER BY period)) AS index FROM ipca")
cte("adj", "SELECT bill_month, valid_from, category_detail, CAST(percent AS DOUBLE) AS percent FROM " + values(
    "t", "bill_month, valid_from, category_detail, percent", T.adjustments))
cte("cats", "SELECT * FROM " + values("t", "category_detail", [(x,) for x in T.details]))
cte("adj_all", "SELECT bill_month, c.category_detail, percent FROM adj JOIN cats c ON adj.category_detail IS NULL OR adj.category_detail = c.category_detail")
cte("tariff_grid", f"""
SELECT category_detail, CAST(m AS DATE) AS period, coalesce((SELECT product(1 + percent / 100) FROM adj_all a
    WHERE a.category_detail = c.category_detail AND a.bill_month <= CAST(m AS DATE)), 1) AS nominal
FROM cats c, (SELECT unnest(generate_series({lit(T.base_month)}, {lit(T.last_month)}, INTERVAL 1 MONTH)) AS m)
""")
cte("tariff", f"""
SELECT category_detail, period, nominal, f.index, estimated,
  100 * nominal / n0 * i0 / f.index AS real_tariff
FROM (SELECT g.*, last_value(i.index IGNORE NULLS) OVER (PARTITION BY category_detail ORDER BY period) AS index,
        i.index IS NULL AS estimated FROM tariff_grid g LEFT JOIN ipca_index i USING (period)) f
JOIN (SELECT category_detail, nominal AS n0, index AS i0 FROM tariff_grid LEFT JOIN ipca_index USING (period)
      WHERE period = {lit(T.base_month)}) b USING (category_detail)
""")
cte("jobs_filled", f"""
SELECT g.ibge_code, CAST(m AS DATE) AS period, last_value(stock IGNORE NULLS) OVER (PARTITION BY g.ibge_code ORDER BY m) AS jobs
FROM (SELECT DISTINCT ibge_code FROM stage4) g
CROSS JOIN (SELECT unnest(generate_series({lit(B.calendar_start)}, (SELECT max(period) FROM stage4), INTERVAL 1 MONTH)) AS m)
LEFT JOIN jobs j ON j.ibge_code = g.ibge_code AND j.period = m
""")
cte("base", f"""
SELECT region || '_' || b.municipality || '_' || office || '_' || b.category_detail || '_' || b.territory AS series_key,
  b.*, a.abc_class, cl.prec_tot, cl.temp_med, jf.jobs, t.real_tariff
FROM stage4 b LEFT JOIN abc a ON a.municipality = b.municipality
LEFT JOIN climate cl ON cl.ibge_code = b.ibge_code AND cl.period = b.period
LEFT JOIN jobs_filled jf ON jf.ibge_code = b.ibge_code AND jf.period = b.period
LEFT JOIN tariff t ON t.category_detail = b.category_detail AND t.period = b.period
""")
