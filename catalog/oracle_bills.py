"""Oracle relations: inputs, bills, the account-month fact, account rules."""

from metermill import rules
from metermill.sources import driver_tables as dt

from .sqlkit import P, big, cte, d, inlist, lit, r, values

S, A, B = P.size, P.absurd, P.base


def _arr(items):
    return "[" + ", ".join(lit(x) for x in items) + "]"


def _case(col, table):
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


cte("x_account", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN '-1' WHEN c_custkey % 101 = 1 THEN NULL
       ELSE CAST(c_custkey AS VARCHAR) END AS account,
       CAST(c_nationkey * 10 + c_custkey % 3 AS INTEGER) AS office, c_mktsegment AS seg,
       c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') AS resid, c_nationkey AS nation
FROM customer
""")
cte("x_part", "SELECT p_partkey AS pk, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand, p_type AS kind FROM part")
cte("x_lines", f"""
SELECT x_account.*, x_part.*, l_orderkey, l_partkey, l_suppkey % 11 AS supp, l_linenumber AS line,
       l_returnflag <> 'N' AS w, l_linestatus = 'O' AS s, l_returnflag AS rf,
       CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
       CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_shipdate AS DATE) AS ship, o_orderdate, o_orderstatus, o_custkey,
       CASE seg {" ".join(f"WHEN {lit(k)} THEN ({_arr(v)})[brand]" for k, v in dt.ITEMS_BY_SEGMENT.items())} END AS item
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN x_account ON o_custkey = k JOIN x_part ON l_partkey = pk
""")
V7 = "DECIMAL(18,7)"
POS = f"CAST(price * CAST(0.001 AS DECIMAL(4,3)) AS {V7})"
NEG = f"CAST(-price * disc * CAST(0.001 AS DECIMAL(4,3)) AS {V7})"
cte("bills", f"""
SELECT account, l_orderkey AS contract, ship AS issue_date, CAST(year(o_orderdate) AS INTEGER) AS "year",
  CAST(month(o_orderdate) AS INTEGER) AS "month", office,
  CASE WHEN resid THEN ({_arr(dt.BENEFIT_BY_LINE)})[line] ELSE '0' END AS benefit_type,
  CASE WHEN resid THEN CASE supp WHEN 0 THEN 'SB_SOCIAL_2_SR' WHEN 1 THEN 'SB_SOCIAL_1' WHEN 2 THEN 'SB_SOCIAL_1'
       WHEN 3 THEN 'SB_FAVELAS_N' ELSE 'SB_RES_N' END
       WHEN seg = 'AUTOMOBILE' THEN CASE supp WHEN 0 THEN 'SB_PUBLICA_MUN_O' WHEN 1 THEN 'SB_PREDIO' ELSE 'SB_NORMAL' END
       ELSE 'SB_NORMAL' END AS product_code,
  CASE WHEN resid AND kind = 'ECONOMY' THEN CASE WHEN line = 5 THEN 'SB_SOC_50_4' ELSE 'SB_SOC_50_1' END
       WHEN resid THEN {_case("kind", dt.CLASS_BY_SEGMENT["RES"])}
       WHEN seg = 'BUILDING' THEN {_case("kind", dt.CLASS_BY_SEGMENT["BUILDING"])}
       WHEN seg = 'MACHINERY' THEN {_case("kind", dt.CLASS_BY_SEGMENT["MACHINERY"])}
       WHEN seg = 'AUTOMOBILE' THEN {_case("kind", dt.CLASS_BY_SEGMENT["AUTOMOBILE"])} END AS class_code,
  CASE WHEN resid THEN '1' WHEN seg = 'BUILDING' THEN CASE WHEN brand = 17 THEN '5' ELSE '2' END
       WHEN seg = 'MACHINERY' THEN CASE WHEN brand IN (19, 21) THEN '9' ELSE '3' END ELSE '4' END AS usage_code,
  CASE WHEN w AND item IS NOT NULL THEN CASE WHEN item = 'SB_REUSO' THEN item ELSE 'SB_AGUA_' || item END END AS water_item,
  CASE WHEN s AND item IS NOT NULL THEN CASE WHEN brand = 25 THEN 'SB_ESG_ND_ESP_4F'
       ELSE 'SB_ESGOTO_' || item || CASE WHEN kind = 'PROMO' THEN '_D' ELSE '' END END END AS sewage_item,
  CAST(1 + o_custkey % 4 AS INTEGER) AS units, CAST(20 + l_partkey % 25 AS INTEGER) AS days,
  CAST(CASE WHEN w THEN qty ELSE 0 END AS {V7}) AS meas_water,
  CAST(CASE WHEN s THEN qty * CAST(0.8 AS DECIMAL(2,1)) ELSE 0 END AS {V7}) AS meas_sewage,
  CAST(CASE line WHEN 7 THEN NULL WHEN 6 THEN qty * CAST(0.1 AS DECIMAL(2,1)) ELSE 0 END AS {V7}) AS meas_effluent,
  CAST(CASE WHEN w THEN {POS} ELSE 0 END AS {V7}) AS bill_water_pos,
  CAST(CASE WHEN w AND rf = 'R' AND line = 5 THEN {POS} * -2 WHEN w THEN {NEG} ELSE 0 END AS {V7}) AS bill_water_neg,
  CAST(CASE WHEN s THEN {POS} * CAST(0.8 AS DECIMAL(2,1)) ELSE 0 END AS {V7}) AS bill_sewage_pos,
  CAST(CASE WHEN s THEN {NEG} * CAST(0.8 AS DECIMAL(2,1)) ELSE 0 END AS {V7}) AS bill_sewage_neg,
  CAST(0 AS {V7}) AS bill_effluent_pos, CAST(0 AS {V7}) AS bill_effluent_neg,
  CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE 'S' END AS processed
FROM x_lines JOIN (SELECT unnest([1, 2]) AS n) ON n = 1 OR l_partkey % 50 = 0
""")
cte("registry", """
SELECT CAST(o_custkey AS VARCHAR) AS account,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Urbano' WHEN '2-HIGH' THEN 'Rural' WHEN '3-MEDIUM' THEN 'Informal'
       WHEN '5-LOW' THEN ' Urbano ' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '0' END END AS territory,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS end_date,
  o_orderkey AS registry_id
FROM orders
""")
cte("category_map", "SELECT * FROM " + values("t", "category_code, category_name, category_detail, category", rules.CATEGORY_MAP))
cte("munis", """
SELECT CAST(3500007 + n_nationkey * 10 AS VARCHAR) AS ibge_full, n_name AS municipality, r_name AS region, n_nationkey AS nk
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
cte("geo_raw", """
SELECT CAST(nk * 10 + j AS INTEGER) AS office, region, municipality, ibge_full
FROM munis, (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([1, 2]) AS copy_no)
WHERE (nk * 10 + j) % 37 <> 5 AND (copy_no = 1 OR (nk * 10 + j) % 50 = 0)
""")
cte("geo", "SELECT DISTINCT * FROM geo_raw")

# -- fact -------------------------------------------------------------------
cte("clean_bills", """
SELECT DISTINCT * EXCLUDE (processed) REPLACE (coalesce(water_item, '-1') AS water_item, coalesce(sewage_item, '-1') AS sewage_item)
FROM bills WHERE processed = 'S'
""")
cte("latest", """
SELECT account, territory FROM registry
QUALIFY row_number() OVER (PARTITION BY account ORDER BY end_date DESC NULLS LAST, registry_id DESC) = 1
""")
cte("flagged", """
SELECT *, CASE WHEN water_item = 'SB_REUSO' THEN water_item
     WHEN water_item <> '-1' THEN replace(water_item, 'SB_AGUA_', '')
     WHEN sewage_item LIKE 'SB\\_ESGOTO\\_%' ESCAPE '\\' THEN replace(sewage_item, 'SB_ESGOTO_', '')
     WHEN sewage_item <> '-1' THEN sewage_item END AS item_code,
  water_item <> '-1' AS is_water, sewage_item <> '-1' AS is_sewage,
  sewage_item <> '-1' AND sewage_item LIKE '%\\_D' ESCAPE '\\' AS is_avail
FROM clean_bills
""")


def _rule_rows():
    for i, x in enumerate(rules.CODE_RULES):
        yield (i, x.code, "|".join(x.items) or None, x.no_item, x.product, x.product_prefix, x.benefit,
               "|".join(x.class_in) or None, "|".join(x.class_has) or None, x.usage)


# the rule list as a relation; each distinct combination takes the lowest matching number
cte("rule_list", "SELECT * FROM " + values(
    "t", "prio, code, items, no_item, product, prefix, benefit, klasses, fragments, usage", _rule_rows()))
cte("combos", "SELECT DISTINCT item_code, product_code, benefit_type, class_code, usage_code FROM flagged")
cte("combo_code", """
SELECT c.*, arg_min(code, prio) AS category_code
FROM combos c LEFT JOIN rule_list q ON
  (q.items IS NULL OR coalesce(list_contains(string_split(q.items, '|'), c.item_code), q.no_item))
  AND (q.product IS NULL OR q.product = c.product_code)
  AND (q.prefix IS NULL OR starts_with(c.product_code, q.prefix))
  AND (q.benefit IS NULL OR q.benefit = c.benefit_type)
  AND (q.klasses IS NULL OR list_contains(string_split(q.klasses, '|'), c.class_code))
  AND (q.fragments IS NULL OR regexp_matches(c.class_code, q.fragments))
  AND (q.usage IS NULL OR q.usage = c.usage_code)
GROUP BY ALL
""")
cte("coded", """
SELECT f.*, m.category_code FROM flagged f JOIN combo_code m
  ON f.item_code IS NOT DISTINCT FROM m.item_code AND f.product_code IS NOT DISTINCT FROM m.product_code
 AND f.benefit_type IS NOT DISTINCT FROM m.benefit_type AND f.class_code IS NOT DISTINCT FROM m.class_code
 AND f.usage_code IS NOT DISTINCT FROM m.usage_code
""")
M, BW = "meas_sewage + meas_effluent", "bill_water_pos + bill_water_neg"
BS = "bill_sewage_pos + bill_sewage_neg + bill_effluent_pos + bill_effluent_neg"
cte("fact", f"""
SELECT c.account, category_code, item_code, office, l.territory, "year", "month",
  count(*) AS n_bills, {big("sum(days)")} AS days, max(units) AS units,
  max(CASE WHEN is_water THEN units ELSE 0 END) AS units_water, max(CASE WHEN is_sewage THEN units ELSE 0 END) AS units_sewage,
  max(CASE WHEN is_sewage AND NOT is_avail THEN units ELSE 0 END) AS units_sewage_real,
  max(CASE WHEN is_avail THEN units ELSE 0 END) AS units_sewage_avail,
  max(CAST(is_water AS INTEGER)) AS has_water, max(CAST(is_sewage AS INTEGER)) AS has_sewage,
  max(CAST(is_sewage AND NOT is_avail AS INTEGER)) AS has_sewage_real, max(CAST(is_avail AS INTEGER)) AS has_sewage_avail,
  sum(meas_water) AS vol_meas_water, sum({M}) AS vol_meas_sewage,
  sum(CASE WHEN NOT is_avail THEN {M} ELSE 0 END) AS vol_meas_sewage_real,
  sum(CASE WHEN is_avail THEN {M} ELSE 0 END) AS vol_meas_sewage_avail,
  sum({BW}) AS vol_bill_water, sum({BS}) AS vol_bill_sewage,
  sum(CASE WHEN NOT is_avail THEN {BS} ELSE 0 END) AS vol_bill_sewage_real,
  sum(CASE WHEN is_avail THEN {BS} ELSE 0 END) AS vol_bill_sewage_avail
FROM coded c LEFT JOIN latest l ON c.account = l.account
GROUP BY c.account, category_code, item_code, office, l.territory, "year", "month"
""")

# -- accounts ---------------------------------------------------------------
SCOPE = f"category IN {inlist(rules.SIZE_CATEGORIES)} AND category_detail NOT LIKE '%DF%'"
REAL_ACCOUNT = "account IS NOT NULL AND account <> '-1'"
cte("vol_month", f"""
SELECT account, category_detail, region, "year" * 100 + "month" AS yyyymm, sum(vol_meas_water) AS vol
FROM fact JOIN category_map USING (category_code) LEFT JOIN geo USING (office)
WHERE {SCOPE} AND "year" * 100 + "month" BETWEEN {S.ref_from} AND {S.ref_to} AND {REAL_ACCOUNT}
GROUP BY ALL
""")
cte("acc_ref", """
SELECT account, category_detail, region, quantile_cont(CAST(vol AS DOUBLE), 0.5) AS vol_median_ref,
       CAST(max(vol) AS DOUBLE) AS vol_max_ref, count(*) AS months_ref
FROM vol_month GROUP BY ALL
""")
cte("acc_total", "SELECT category_detail, region, sum(vol_median_ref) AS vol_series_ref FROM acc_ref GROUP BY ALL")
cte("acc_limits", "SELECT * FROM " + values("t", "category_detail, share_min, v_min", S.thresholds))
cte("acc_size", f"""
SELECT account, category_detail, region, vol_median_ref, vol_max_ref, months_ref, vol_series_ref,
  vol_median_ref / nullif(vol_series_ref, 0) AS share_series,
  CASE WHEN vol_median_ref / nullif(vol_series_ref, 0) >= share_min AND vol_median_ref >= v_min AND months_ref >= {S.min_months}
       THEN 'Grande' ELSE 'Demais' END AS size_class
FROM acc_ref JOIN acc_total USING (category_detail, region) LEFT JOIN acc_limits USING (category_detail)
""")
cte("size_cls", """
SELECT * FROM acc_size QUALIFY row_number() OVER (PARTITION BY account ORDER BY vol_median_ref DESC, category_detail, region) = 1
""")
cte("acc_month", f"""
SELECT account, "year", "month", CAST(sum(vol_meas_water) AS DOUBLE) AS meas_water, CAST(sum(vol_meas_sewage) AS DOUBLE) AS meas_sewage,
       CAST(sum(vol_bill_water) AS DOUBLE) AS bill_water, CAST(sum(vol_bill_sewage) AS DOUBLE) AS bill_sewage
FROM fact WHERE {REAL_ACCOUNT} GROUP BY ALL
""")
cte("absurd_cand", f"SELECT * FROM acc_month WHERE greatest(meas_water, meas_sewage, bill_water, bill_sewage) >= {A.floor}")
VS = ("meas_water", "meas_sewage", "bill_water", "bill_sewage")
cte("absurd_med", "SELECT account, " + ", ".join(f"quantile_cont({v}, 0.5) AS median_{v}" for v in VS) + """
FROM acc_month WHERE account IN (SELECT account FROM absurd_cand) GROUP BY account""")
cte("factors", "SELECT * FROM (SELECT c.*, m.* EXCLUDE (account), " + ", ".join(
    f"CASE WHEN {v} >= {A.floor} AND {v} >= {A.ratio} * greatest(median_{v}, 1) "
    f"THEN greatest(median_{v}, 0) / {v} ELSE CAST(1 AS DOUBLE) END AS f_{v}" for v in VS
) + " FROM absurd_cand c JOIN absurd_med m USING (account)) WHERE " + " OR ".join(f"f_{v} < 1" for v in VS))
_F = {"vol_meas_water": "f_meas_water", "vol_meas_sewage": "f_meas_sewage", "vol_meas_sewage_real": "f_meas_sewage",
      "vol_meas_sewage_avail": "f_meas_sewage", "vol_bill_water": "f_bill_water", "vol_bill_sewage": "f_bill_sewage",
      "vol_bill_sewage_real": "f_bill_sewage", "vol_bill_sewage_avail": "f_bill_sewage"}
FL = ("water", "sewage", "sewage_real", "sewage_avail")
cte("hist", f"""
SELECT dp.category_code, category_name, dp.category_detail, category, coalesce(pt.size_class, 'Demais') AS size_class,
  g.region, municipality, ibge_full, f.office, territory, f."year", f."month",
  count(DISTINCT f.account) AS conns,
  {", ".join(f"count(DISTINCT CASE WHEN has_{x} = 1 THEN f.account END) AS conns_{x}" for x in FL)},
  {big("sum(n_bills)")} AS n_bills, {big("sum(days)")} AS days, {big("sum(units)")} AS units,
  {", ".join(big(f"sum(units_{x})") + f" AS units_{x}" for x in FL)},
  {", ".join(f"sum(CAST({v} AS DOUBLE) * coalesce({k}, 1)) AS {v}" for v, k in _F.items())},
  CAST(sum(vol_meas_water) AS DOUBLE) AS vol_meas_water_raw, CAST(sum(vol_bill_water) AS DOUBLE) AS vol_bill_water_raw
FROM fact f JOIN category_map dp ON f.category_code = dp.category_code LEFT JOIN geo g ON f.office = g.office
LEFT JOIN size_cls pt ON f.account = pt.account
LEFT JOIN factors c ON f.account = c.account AND f."year" = c."year" AND f."month" = c."month"
GROUP BY ALL
""")
