"""Queries: landed files derived from the test tables, and the sinks."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from metermill import rules
from metermill.functions.dates import PT_MONTHS, month_index
from metermill.functions.numeric import snap_round
from metermill.operators import accounts, covariates
from metermill.sources import driver_tables as src
from metermill.sources import landing, sinks
from metermill.sources.published import PublishedTable, Refused
from metermill.streaming import incremental

from . import oracle_series as o
from . import stages as st
from .q_series import BASE_DBL, rounded
from .registry import out, query
from .sqlkit import P, cte, d, lit, r

C = P.covariates
FIRST = date(1995, 1, 1)


def land_json(ws, name, df):
    path = ws.output(f"landing/{name}")
    df.write.mode("overwrite").json(path)
    return path


def price_json(ws):
    """Blocks of the first provider; January comes in two blocks."""
    rows = st.price_index(ws).select(
        F.date_format("period", "dd/MM/yyyy").alias("data"), F.format_string("%.2f", "value").alias("valor")
    )
    return land_json(ws, "price", rows.unionByName(rows.where(F.col("data").startswith("01/01/"))))


def price_alt_json(ws):
    rows = st.price_index(ws).select(
        F.date_format("period", "yyyyMM").alias("D3C"),
        F.when(month_index("period") % 7 == 0, "...").when(month_index("period") % 11 == 0, "-")
        .otherwise(F.format_string("%.2f", "value")).alias("V"),
    )
    head = rows.limit(1).select(F.lit("Mês (Código)").alias("D3C"), F.lit("Valor").alias("V"))
    return land_json(ws, "price_alt", rows.unionByName(head))


@query("src_json_series", "SELECT period, value FROM ipca")
def _(ws):
    return landing.src_json_series(ws.spark, price_json(ws))


ALT = "(year(period) * 12 + month(period) - 1)"
ALT_WHERE = f"{ALT} % 7 <> 0 AND {ALT} % 11 <> 0"


@query("src_json_alt", f"SELECT period, value FROM ipca WHERE {ALT_WHERE}")
def _(ws):
    return landing.src_json_alt(ws.spark, price_alt_json(ws))


@query("src_priority", f"SELECT period, value, 1 AS priority FROM ipca WHERE {ALT_WHERE}")
def _(ws):
    first = landing.src_json_series(ws.spark, price_json(ws)).where("value > 1000")  # down today
    return landing.src_priority([first, landing.src_json_alt(ws.spark, price_alt_json(ws)), st.price_index(ws)])


@query("src_survey", f"""
WITH raw AS (SELECT CAST(o_orderdate AS DATE) AS published, CAST(year(o_orderdate) + 1 AS VARCHAR) AS ref_year,
  {r("CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 1000", 2)} AS median, {r("max(o_totalprice) / 1000", 2)} AS mean
  FROM orders WHERE day(o_orderdate) % 5 <> 0 GROUP BY 1, 2)
SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY ref_year ORDER BY published DESC, median DESC, mean DESC) = 1""")
def _(ws):
    o_ = src.read(ws.spark, ws.source, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double")
    rows = o_.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        snap_round(total / F.count("*") / 1000, 2).alias("Mediana"), snap_round(F.max("o_totalprice") / 1000, 2).alias("Media")
    ).select(
        F.lit("IPCA").alias("Indicador"), F.col("day").cast("string").alias("Data"),
        (F.year("day") + 1).cast("string").alias("DataReferencia"), "Media", "Mediana",
        F.when(F.dayofmonth("day") % 5 == 0, 1).otherwise(0).alias("baseCalculo"),
    )
    return landing.src_survey(ws.spark, land_json(ws, "survey", rows))


def daily_sql():
    mean, high, low = ("CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)", "CAST(max(CAST(value AS DECIMAL(12,2))) AS DOUBLE)", "CAST(min(CAST(value AS DECIMAL(12,2))) AS DOUBLE)")
    cells = {
        "T2M": (97, mean), "T2M_MAX": (101, high), "T2M_MIN": (103, low), "PRECTOTCORR": (107, f"{mean} / 10"), "RH2M": (109, f"100 - {low} / 10"),
        "T2MDEW": (113, f"{mean} - 5"), "WS2M": (127, f"({high} - {low}) / 20"),
    }
    return ", ".join(f"CASE WHEN min(event_id) % {k} = 0 THEN NULL ELSE {r(e, 4)} END AS {name}" for name, (k, e) in cells.items())


cte("daily", f"SELECT CAST(user_id AS VARCHAR) AS ibge_code, CAST(ts AS DATE) AS day, {daily_sql()} FROM events GROUP BY 1, 2")


def daily(ws):
    path = land_json(ws, "daily", src.climate_daily(ws.spark, ws.source))
    return landing.src_daily(ws.spark, path, ws.params.covariates)


@query("src_daily", "SELECT * FROM daily")
def _(ws):
    return daily(ws)


@query("agg_climate_month", f"""
SELECT * FROM (SELECT ibge_code, CAST(date_trunc('month', day) AS DATE) AS period, {", ".join(f"{r(f'avg({v})', 4)} AS {n}" for v, n in rules.CLIMATE.items())},
  least({", ".join(f"count({v})" for v in rules.CLIMATE)}) AS valid_days FROM daily GROUP BY 1, 2)
WHERE valid_days >= ceil({C.min_coverage} * day(last_day(period))) AND period < {lit(C.current_month)}""")
def _(ws):
    return out(covariates.agg_climate_month(daily(ws), rules.CLIMATE, ws.params.covariates))


cte("jobs_cells", f"""
SELECT CASE WHEN nk % 10 = 9 THEN 'RJ' ELSE 'SP' END AS uf, CAST(350000 + nk AS VARCHAR) AS ibge_code, CAST(m AS DATE) AS period, stock,
  {r("stock - lag(stock) OVER (PARTITION BY nk ORDER BY m) + CASE WHEN nk % 7 = 3 THEN 5 ELSE 0 END", 2)} AS balance
FROM munis CROSS JOIN (SELECT unnest(generate_series((SELECT min(period) FROM jobs), (SELECT max(period) FROM jobs), INTERVAL 1 MONTH)) AS m)
LEFT JOIN jobs ON ibge_code = CAST(350000 + nk AS VARCHAR) AND period = m""")


def published(ws):
    """The first month of the jobs, and all up to the last."""
    first, last = st.jobs(ws).agg(F.min("period"), F.max("period")).first()
    return first, [o._month(first, k) for k in range((last.year - first.year) * 12 + last.month - first.month + 1)]


def jobs_sheet(ws):
    """The wide sheet: three ids, 4 columns, then 5 per month from the first to the last of the jobs, 8 at the end."""
    months = published(ws)[1]
    munis = src.municipalities(ws.spark, ws.source).select(
        (F.lit(350000) + F.col("nation_key")).cast("string").alias("ibge_code"), "municipality", "nation_key"
    )
    wide = munis.join(
        st.jobs(ws).groupBy("ibge_code").pivot("period", months).agg(F.first("stock")), "ibge_code", "left"
    )
    shift = F.when(F.col("nation_key") % 7 == 3, 5.0).otherwise(0.0)
    names = [str(x) for x in months]
    none = F.lit(None).cast("string")
    cols = [F.when(F.col("nation_key") % 10 == 9, "RJ").otherwise("SP"), F.col("ibge_code"), F.col("municipality")]
    for k, n in enumerate(names):
        bal = none if k == 0 else snap_round(F.col(n) - F.col(names[k - 1]) + shift, 2).cast("string")
        block = [F.col(n).cast("string"), none, none, bal] + ([none] if k else [])
        cols += block
    cols += [none] * 8
    labels = landing.jobs_sheet_columns(len(names))
    sheet = wide.select(*[c.alias(l) for c, l in zip(cols, labels)])
    head = sheet.limit(1).select(*[F.lit("UF" if i == 0 else "Estoque").alias(l) for i, l in enumerate(labels)])
    path = ws.output("landing/jobs")
    sheet.unionByName(head).write.mode("overwrite").csv(path)
    return ws.spark.read.schema(", ".join(f"{l} string" for l in labels)).csv(path)


def jobs_long(ws):
    return ws.stage("jobs_long", lambda: landing.src_wide_jobs(jobs_sheet(ws), published(ws)[0], ws.params.covariates))


@query("src_wide_jobs", "SELECT uf, ibge_code, period, stock, balance FROM jobs_cells")
def _(ws):
    return landing.src_wide_jobs(jobs_sheet(ws), published(ws)[0], ws.params.covariates)


@query("prj_jobs_scope", "SELECT j.ibge_code, municipality, period, stock FROM jobs_cells j JOIN (SELECT DISTINCT ibge_code, municipality FROM stage1) USING (ibge_code) WHERE uf = 'SP'")
def _(ws):
    served = st.stage1(ws).select("ibge_code", "municipality").distinct()
    return covariates.prj_jobs_scope(jobs_long(ws), served, ws.params.covariates)


@query("dq_jobs", f"""
SELECT count(ok) AS cells, {r("avg(CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0.0 END)", 4)} AS share_ok,
  {r("avg(CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0.0 END)", 4)} >= {C.min_alignment} AS aligned
FROM (SELECT abs(stock - lag(stock) OVER (PARTITION BY ibge_code ORDER BY period) - balance) <= 1 AS ok FROM jobs_cells)""")
def _(ws):
    return covariates.dq_jobs(jobs_long(ws), ws.params.covariates)


BASE_CHECK = f"SELECT * {rounded(BASE_DBL)} FROM base"


@query("src_csv_base", BASE_CHECK)
def _(ws):
    path = ws.output("landing/base_csv")
    st.base(ws).write.mode("overwrite").option("header", True).csv(path)
    return out(landing.src_csv_base(ws.spark, path))


@query("src_csv_infer", f"""
SELECT category_detail, CAST("year" AS INTEGER) AS "year", {r("sum(vol_meas_water)", 3)} AS vol FROM hist GROUP BY ALL""")
def _(ws):
    path = ws.output("landing/hist_csv")
    st.hist(ws).write.mode("overwrite").option("header", True).csv(path)
    old = landing.src_csv_infer(ws.spark, path)
    return out(old.groupBy("category_detail", "year").agg(F.sum("vol_meas_water").alias("vol")), 3)


# -- premise of new connections --------------------------------------------

cte("conn_plan", """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Rural' ELSE 'Tarifa Social' END AS usage,
  replace(upper(n_name[1]) || lower(n_name[2:]), '_', '-') AS municipality,
  CASE WHEN c_custkey % 5 = 0 THEN 'A/E' WHEN c_custkey % 5 < 3 THEN 'Água' ELSE 'Esgoto' END AS type,
  make_date(2002, CAST(c_custkey % 12 + 1 AS INTEGER), 1) AS period, CAST(count(*) AS DOUBLE) AS increment
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
cte("premise", """
SELECT 'Residencial' AS category, usage, municipality, 'P1' AS project, type, period, increment, replace(upper(municipality), '-', ' ') AS municipality_norm,
  upper(usage) AS usage_norm, replace(replace(upper(type), 'Á', 'A'), '/', ' ') AS type_norm FROM conn_plan""")


def premise(ws):
    """The sheet with its example, repeated header and total rows, then read back."""
    plan = src.new_connections(ws.spark, ws.source)
    labels = {n: f"{m}/02" for n, m in enumerate(PT_MONTHS, 1)}
    wide = plan.groupBy("usage", "municipality", "type").pivot("month_no", list(labels)).agg(F.first("increment"))
    sheet = wide.select(
        F.lit("Residencial").alias("Categoria"), F.col("usage").alias("Utilização"), F.col("municipality").alias("Município"),
        F.lit("P1").alias("Projeto"), F.col("type").alias("Tipo"),
        *[F.col(str(n)).cast("string").alias(l) for n, l in labels.items()], F.lit(None).cast("string").alias("Nota"),
    )
    keep = [F.col(f"`{c}`") for c in sheet.columns]
    example = sheet.limit(1).select(*keep[:-1], F.lit("Exemplo de preenchimento").alias("Nota"))
    total = sheet.limit(1).select(F.lit("Total").alias("Categoria"), *keep[1:])
    head = sheet.limit(1).select(*[F.lit(c).alias(c) for c in sheet.columns])
    path = ws.output("landing/premise")
    sheet.unionByName(example).unionByName(total).unionByName(head).write.mode("overwrite").option("header", True).csv(path)
    return landing.src_premise(ws.spark.read.option("header", True).csv(path))


def premise_stage(ws):
    return ws.stage("premise", lambda: premise(ws))


@query("src_premise", "SELECT * FROM premise")
def _(ws):
    return premise(ws)


# -- external forecast ------------------------------------------------------

EXT_SQL = f"""
SELECT CASE WHEN period >= DATE '2001-01-01' THEN 'PROJ' ELSE 'REAL' END AS tp, strftime(period, '%Y%m') AS periodo,
  CASE WHEN category_detail LIKE 'Residencial Social%' THEN 'RESIDENCIAL SOCIAL' ELSE category_detail END AS categoria,
  CASE WHEN municipality = {lit(P.grouping.capital)} THEN 'M' ELSE region END AS regiao, var, value AS valor FROM (
    SELECT period, category_detail, municipality, region, sum(vol_meas_water) AS vol_med_agua, sum(units_water) * 1.1 AS econ_agua FROM stage4 GROUP BY ALL)
  UNPIVOT (value FOR var IN (vol_med_agua, econ_agua))"""
cte("ext_raw", EXT_SQL)
cte("ext", """
SELECT strptime(periodo || '01', '%Y%m%d')::DATE AS period, regiao AS ext_region, categoria AS ext_category,
  sum(valor) FILTER (var = 'vol_med_agua') AS vol, sum(valor) FILTER (var = 'econ_agua') AS units
FROM ext_raw WHERE tp = 'PROJ' GROUP BY 1, 2, 3""")


def ext_cells(ws):
    g = st.stage4(ws).groupBy("period", "category_detail", "municipality", "region").agg(
        F.sum("vol_meas_water").alias("vol_med_agua"), (F.sum("units_water") * 1.1).alias("econ_agua")
    )
    social = F.col("category_detail").startswith("Residencial Social")
    return g.select(
        F.when(F.col("period") >= F.lit(date(2001, 1, 1)), "PROJ").otherwise("REAL").alias("tp"),
        F.date_format("period", "yyyyMM").alias("periodo"),
        F.when(social, "RESIDENCIAL SOCIAL").otherwise(F.col("category_detail")).alias("categoria"),
        F.when(F.col("municipality") == ws.params.grouping.capital, "M").otherwise(F.col("region")).alias("regiao"),
        "vol_med_agua", "econ_agua",
    )


def landed_csv(ws, name, df):
    path = ws.output(f"landing/{name}")
    df.write.mode("overwrite").option("header", True).csv(path)
    return ws.spark.read.option("header", True).csv(path)


def ext_raw(ws):
    return landed_csv(ws, "external", ext_cells(ws).unpivot(["tp", "periodo", "categoria", "regiao"], ["vol_med_agua", "econ_agua"], "var", "valor"))


def ext_paired(ws):
    """The same forecast with volume and units side by side, under the other names, dates as days."""
    day = F.concat_ws("-", F.substring("periodo", 1, 4), F.substring("periodo", 5, 2), F.lit("01"))
    return landed_csv(ws, "external_paired", ext_cells(ws).select(
        day.alias("Periodo"), F.col("regiao").alias("cd_regiao_adj"), F.col("categoria").alias("categoria_detalhe"), F.col("econ_agua").alias("n_economias"),
        F.col("vol_med_agua").alias("vol_med"), F.col("tp").alias("TP"),
    ))


def external(ws):
    return ws.stage("external", lambda: landing.src_extforecast(ext_raw(ws)))


@query("src_extforecast", f"""
SELECT * {rounded(['vol', 'units'])} FROM ext CROSS JOIN (VALUES ('raw'), ('paired')) AS l(layout)""")
def _(ws):
    """Both layouts of one forecast give the same rows."""
    rows = None
    for layout, sheet in (("raw", ext_raw(ws)), ("paired", ext_paired(ws))):
        found = landing.src_extforecast(sheet).select(F.lit(layout).alias("layout"), "*")
        rows = found if rows is None else rows.unionByName(found)
    return out(rows)


# -- increments and sinks ---------------------------------------------------

cte("climate_old", "SELECT ibge_code, period, temp_med, prec_tot FROM climate WHERE period < DATE '2001-05-01' AND CAST(ibge_code AS INTEGER) % 5 <> 0")


def climate_old(ws):
    return st.climate(ws).where((F.col("period") < F.lit(date(2001, 5, 1))) & (F.col("ibge_code").cast("int") % 5 != 0))


def table_of(ws, name, partition, keys, **state):
    """A new published table of this run's own."""
    return PublishedTable(ws.spark, ws.output(f"tables/{name}-{uuid.uuid4().hex}"), partition, keys, **state)


CLIMATE = ["ibge_code", "period", "temp_med", "prec_tot"]


def climate_table(ws):
    """The climate of the first months, published."""
    table = table_of(ws, "climate", "period", ["ibge_code", "period"], point="ibge_code", period="period")
    table.upsert(climate_old(ws).select(*CLIMATE))
    return table


@query("src_watermark", f"""
SELECT ibge_code, CASE WHEN ibge_code IN (SELECT ibge_code FROM climate_old)
  THEN CAST((SELECT max(period) FROM climate_old) - INTERVAL {C.reread_months} MONTH AS DATE) ELSE DATE '1995-01-01' END AS read_from
FROM (SELECT DISTINCT ibge_code FROM stage1)""")
def _(ws):
    points = st.stage1(ws).select("ibge_code").distinct()
    return incremental.src_watermark(climate_table(ws).watermarks(), points, FIRST, ws.params.covariates)


@query("snk_upsert", f"""
SELECT ibge_code, period, CASE WHEN period >= DATE '2001-01-01' THEN {r("temp_med + 1", 6)} ELSE temp_med END AS temp_med, prec_tot
FROM (SELECT * FROM climate_old UNION SELECT ibge_code, period, temp_med, prec_tot FROM climate WHERE period >= DATE '2001-01-01')""")
def _(ws):
    new = st.climate(ws).where(F.col("period") >= F.lit(date(2001, 1, 1))).select(
        "ibge_code", "period", snap_round(F.col("temp_med") + 1, 6).alias("temp_med"), "prec_tot"
    )
    return incremental.snk_upsert(climate_table(ws), new)


FACT_MONTH = f'SELECT "year", "month", count(*) AS n, {r("sum(vol_meas_water)", 3)} AS vol FROM hist GROUP BY 1, 2'


def by_month(df):
    return out(df.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("vol_meas_water").alias("vol")), 3)


@query("snk_replace", FACT_MONTH)
def _(ws):
    return by_month(sinks.snk_replace(st.hist(ws), ws.output("tables/hist")))


@query("snk_overwrite", FACT_MONTH)
def _(ws):
    return by_month(sinks.snk_overwrite(st.hist(ws), ws.output("tables/hist_overwrite")))


@query("snk_snapshot", f"""
WITH h AS (SELECT "year", "month", vol_meas_water AS v, CASE WHEN "month" <= 3 THEN 2 ELSE 1 END * vol_meas_water AS w FROM hist)
SELECT "year", "month", count(*) AS n, {r("sum(v)", 3)} AS vol, {r("sum(w)", 3)} AS vol_changed, {r("sum(v)", 3)} AS vol_restored FROM h GROUP BY 1, 2""")
def _(ws):
    """A snapshot, a change of the first three months of each year, and the table restored."""
    keys = ["category", "category_code", "office", "territory", "size_class", "year", "month"]
    rows = st.hist(ws).withColumn("period", F.make_date("year", "month", F.lit(1)))
    table = table_of(ws, "hist", "period", [c for c in rows.columns if c in keys or rows.schema[c].dataType.typeName() == "string"])
    table.upsert(rows)
    before = sinks.snk_snapshot(table, "before")
    table.upsert(rows.where("month <= 3").withColumn("vol_meas_water", F.col("vol_meas_water") * 2))
    changed = table.read()
    table.restore("before")

    def vol(df, name):
        return df.groupBy("year", "month").agg(F.sum("vol_meas_water").alias(name))

    found = by_month(before).join(vol(changed, "vol_changed"), ["year", "month"]).join(vol(table.read(), "vol_restored"), ["year", "month"])
    return out(found, 3)


@query("snk_csv", BASE_CHECK)
def _(ws):
    path = sinks.snk_csv(st.base(ws), ws.output("export"), ["series_key", "size_class", "period"])
    return out(landing.src_csv_base(ws.spark, path))


@query("snk_sample", BASE_CHECK + " WHERE CAST('0x' || substr(md5(series_key), 1, 8) AS BIGINT) % 100 < 50")
def _(ws):
    return out(sinks.snk_sample(st.base(ws)))


@query("snk_bundle", """
SELECT 'abc' AS name, count(*) AS n FROM abc UNION ALL SELECT 'stats', count(*) FROM stats UNION ALL SELECT 'factors', count(*) FROM factors""")
def _(ws):
    paths = sinks.snk_bundle({"abc": st.abc(ws), "stats": st.stats(ws), "factors": st.factors(ws)}, ws.output("bundle"))
    res = None
    for name, p in paths.items():
        row = ws.spark.read.parquet(p).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        res = row if res is None else res.unionByName(row)
    return res


@query("snk_params", f"""
SELECT 'Meses do histórico' AS premise, CAST(count(DISTINCT period) AS VARCHAR) AS value FROM base
UNION ALL SELECT 'Histórico até', CAST(max(period) AS VARCHAR) FROM base
UNION ALL SELECT 'Reajuste nominal', '{P.projection.adjustment}' UNION ALL SELECT 'IPCA projetado (a.a.)', '{P.projection.inflation}'
UNION ALL SELECT 'Cenário principal', '{P.projection.main_scenario}'""")
def _(ws):
    p = ws.params.projection
    n, last = st.base(ws).agg(F.countDistinct("period"), F.max("period")).first()
    rows = [("Meses do histórico", str(n)), ("Histórico até", str(last)), ("Reajuste nominal", str(p.adjustment)),
            ("IPCA projetado (a.a.)", str(p.inflation)), ("Cenário principal", p.main_scenario)]
    return sinks.snk_params(ws.spark, rows, ws.output("params"))


@query("snk_nan", f"""
SELECT account, {r("avg(CASE WHEN meas_water > 0 THEN bill_water / meas_water END)", 4)} AS mean_price FROM acc_month GROUP BY account""")
def _(ws):
    m = accounts.account_months(st.fact(ws).where("account IS NOT NULL AND account <> '-1'"))
    price = F.when(F.col("meas_water") > 0, F.col("bill_water") / F.col("meas_water")).otherwise(F.lit(float("nan")))
    clean = sinks.snk_overwrite(m.withColumn("price", price), ws.output("tables/prices"))
    return out(clean.groupBy("account").agg(F.avg("price").alias("mean_price")))


@query("dq_compare", f"""
WITH n AS (SELECT ibge_code, period, temp_med * 1.01 AS temp_med, prec_tot + 0.5 AS prec_tot FROM climate),
j AS (SELECT n.temp_med AS tn, o.temp_med AS tp, n.prec_tot AS pn, o.prec_tot AS pp FROM climate_old o JOIN n USING (ibge_code, period))
SELECT 'temp_med' AS variable, 'climate' AS "table", count(*) AS common_keys, {r("avg(abs(tn - tp))", 6)} AS mean_diff, {r("max(abs(tn - tp))", 6)} AS max_diff, {r("corr(tp, tn)", 6)} AS corr FROM j
UNION ALL SELECT 'prec_tot', 'climate', count(*), {r("avg(abs(pn - pp))", 6)}, {r("max(abs(pn - pp))", 6)}, {r("corr(pp, pn)", 6)} FROM j""")
def _(ws):
    new = st.climate(ws).withColumns({"temp_med": F.col("temp_med") * 1.01, "prec_tot": F.col("prec_tot") + 0.5})
    return out(covariates.dq_compare(climate_old(ws), new, ["ibge_code", "period"], ["temp_med", "prec_tot"], "climate"), 6)


@query("dq_range", """
SELECT 'climate' AS "table", min(period) AS first, max(period) AS last, count(*) AS n FROM climate
UNION ALL SELECT 'jobs', min(period), max(period), count(*) FROM jobs UNION ALL SELECT 'price_index', min(period), max(period), count(*) FROM ipca
UNION ALL SELECT 'tariff', min(period), max(period), count(*) FROM tariff""")
def _(ws):
    return covariates.dq_range({"climate": st.climate(ws), "jobs": st.jobs(ws), "price_index": st.price_index(ws), "tariff": st.tariff(ws)})


LEAST_DAYS = 28
#: Deliveries of daily readings: the days up to the 10th, all days of all points, all days of the points that are complete.
DELIVERIES = ("first", "all", "complete")


@query("dq_failrate", f"""
WITH n AS (SELECT ibge_code, count(T2M) AS n FROM daily GROUP BY 1),
gate AS (SELECT 'first' AS delivery, count(*) AS points, count(*) FILTER (n < 1) AS failures FROM (SELECT ibge_code, count(T2M) AS n FROM daily WHERE day(day) <= 10 GROUP BY 1)
  UNION ALL SELECT 'all', count(*), count(*) FILTER (n < {LEAST_DAYS}) FROM n UNION ALL SELECT 'complete', count(*), 0 FROM n WHERE n >= {LEAST_DAYS}),
gates AS (SELECT *, failures <= {C.max_fail_rate} * greatest(points, 1) AS may_write FROM gate),
ok AS (SELECT bool_or(may_write) FILTER (delivery = 'first') AS a, bool_or(may_write) FILTER (delivery = 'all') AS b, bool_or(may_write) FILTER (delivery = 'complete') AS c FROM gates),
held AS (SELECT v.delivery, x.ibge_code, x.T2M FROM (VALUES ('first'), ('all'), ('complete')) AS v(delivery), daily x JOIN n USING (ibge_code), ok
  WHERE (a AND day(x.day) <= 10) OR (v.delivery <> 'first' AND b) OR (v.delivery = 'complete' AND c AND n.n >= {LEAST_DAYS}))
SELECT g.delivery, points, failures, may_write, count(h.ibge_code) AS stored, count(DISTINCT h.ibge_code) AS stored_points, {r("sum(T2M)", 3)} AS stored_sum
FROM gates g LEFT JOIN held h ON h.delivery = g.delivery GROUP BY 1, 2, 3, 4""")
def _(ws):
    """Write, audit, publish: what each delivery's gate says, and what the published table holds after it."""
    p = ws.params.covariates
    rows = ws.stage("daily", lambda: daily(ws))
    table = table_of(ws, "daily", "day", ["ibge_code", "day"])
    complete = rows.groupBy("ibge_code").agg(F.count("T2M").alias("n")).where(F.col("n") >= LEAST_DAYS)
    batches = {"first": (rows.where(F.dayofmonth("day") <= 10), 1), "all": (rows, LEAST_DAYS), "complete": (rows.join(complete.select("ibge_code"), "ibge_code", "left_semi"), LEAST_DAYS)}
    found = None
    for name in DELIVERIES:
        batch, least = batches[name]
        try:
            table.upsert(batch, covariates.failing_points("ibge_code", F.col("T2M"), least, p))
        except Refused:
            pass  # the row below shows what is still published
        gate = covariates.dq_failrate(batch.groupBy("ibge_code").agg(F.count("T2M").alias("n")), F.col("n") < least, p)
        now = table.read()
        held = (now if now is not None else rows.limit(0)).agg(F.count("*").alias("stored"), F.countDistinct("ibge_code").alias("stored_points"), F.sum("T2M").alias("stored_sum"))
        row = gate.crossJoin(held).select(F.lit(name).alias("delivery"), "points", "failures", "may_write", "stored", "stored_points", "stored_sum")
        found = row if found is None else found.unionByName(row)
    return out(found, 3)
