"""Readers of landed files: JSON payloads, CSV sheets, decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.dates import parse_period, parse_pt_month
from ..functions.text import normalise_name
from ..params import CovariateParams, ProjectionParams
from ..rules import CLIMATE, MEASURED_SIBLING, TARGETS, VOLUME_MODELS
from .values import relation

MISSING_MARKS = ("...", "-", "")  # fixed values: how the second provider writes "no value"


def src_json_series(spark: SparkSession, path: str) -> DataFrame:
    """Price index from landed JSON blocks: merged, one row per month."""
    raw = spark.read.schema(schemas.PRICE_INDEX_RAW).json(path)
    period = F.to_date("data", "dd/MM/yyyy")
    rows = raw.select(period.alias("period"), F.col("valor").cast("double").alias("value"))
    return rows.groupBy("period").agg(F.min("value").alias("value"))


def src_json_alt(spark: SparkSession, path: str) -> DataFrame:
    """Second provider: other field names, marks for missing values, a header row."""
    raw = spark.read.schema(schemas.PRICE_INDEX_ALT_RAW).json(path)
    period = F.try_to_date(F.concat(F.col("D3C"), F.lit("01")), "yyyyMMdd")
    return raw.where(~F.col("V").isin(*MISSING_MARKS) & period.isNotNull()).select(
        period.alias("period"), F.col("V").try_cast("double").alias("value")
    )


def src_priority(sources: Sequence[DataFrame]) -> DataFrame:
    """The first source that has rows: provider, second provider, last table.

    Raises inside the job if none has any.
    """
    tagged = None
    for i, s in enumerate(sources):
        t = s.select("period", "value").withColumn("priority", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    best = tagged.agg(F.min("priority").alias("best"))
    best = best.select(
        F.when(F.col("best").isNull(), F.raise_error(F.lit("no source of the price index has data")).cast("int"))
        .otherwise(F.col("best")).alias("best")
    )
    return tagged.join(F.broadcast(best), F.col("priority") == F.col("best")).select("period", "value", "priority")


def src_survey(spark: SparkSession, path: str) -> DataFrame:
    """Market expectations: latest publication of each reference year."""
    raw = spark.read.schema(schemas.SURVEY_RAW).json(path)
    rows = raw.where((F.col("Indicador") == "IPCA") & (F.col("baseCalculo") == 0)).select(
        F.to_date("Data").alias("published"), F.col("DataReferencia").alias("ref_year"),
        F.col("Mediana").alias("median"), F.col("Media").alias("mean"),
    )
    w = Window.partitionBy("ref_year").orderBy(F.desc("published"), F.desc("median"), F.desc("mean"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def src_daily(spark: SparkSession, path: str, p: CovariateParams, variables: Sequence[str] = tuple(CLIMATE)) -> DataFrame:
    """Daily readings per point, all variables of the provider; fill values become NULL."""
    raw = spark.read.schema(schemas.CLIMATE_DAILY_RAW).json(path)

    def clean(c: str) -> Column:
        x = F.col(c)
        return F.when((x == p.fill_value) | (x <= p.fill_cut), None).otherwise(x).alias(c)

    return raw.select(F.col("cd_ibge").alias("ibge_code"), F.to_date("day", "yyyyMMdd").alias("day"), *map(clean, variables))


def jobs_sheet_columns(n_months: int) -> list[str]:
    return [f"c{i}" for i in range(5 * n_months + 10)]


def src_wide_jobs(wide: DataFrame, first_month, p: CovariateParams) -> DataFrame:
    """Wide monthly sheet to rows, by column position.

    Three identifying columns, four for the first month, five for each later
    one, eight unused at the end; stock is the first of each block and the
    balance the fourth.
    """
    n_col = len(wide.columns)
    if (n_col - 10) % 5:
        raise ValueError(f"sheet with {n_col} columns: expected 5 x months + 10")
    n = (n_col - 10) // 5
    cols = wide.columns
    stock = [cols[3]] + [cols[7 + 5 * (k - 1)] for k in range(1, n)]
    balance = [cols[6]] + [cols[10 + 5 * (k - 1)] for k in range(1, n)]
    uf, code = F.trim(F.col(cols[0])), F.col(cols[1]).try_cast("double").cast("int")
    rows = wide.where(uf.rlike("^[A-Z]{2}$") & code.between(p.code_min, p.code_max))
    cells = F.posexplode(
        F.array(*[F.struct(F.col(s).try_cast("double").alias("stock"), F.col(b).try_cast("double").alias("balance"))
                  for s, b in zip(stock, balance)])
    ).alias("k", "cell")
    return rows.select(uf.alias("uf"), code.cast("string").alias("ibge_code"), cells).select(
        "uf", "ibge_code", F.add_months(F.lit(first_month), F.col("k")).alias("period"), "cell.stock", "cell.balance"
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The relation itself; the job fails if a key repeats or nothing is there.

    The check is one aggregate joined back as a single row.
    """
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("worst"))
    bad = F.col("worst").isNull() | (F.col("worst") > 1)
    ok = dup.select(F.when(bad, F.raise_error(F.lit(f"empty or repeated key {list(keys)}"))).alias("_ok"))
    return df.crossJoin(F.broadcast(ok)).where(F.col("_ok").isNull()).drop("_ok")


def src_csv_base(spark: SparkSession, path: str, keys: Sequence[str] = ("series_key", "size_class", "period")) -> DataFrame:
    """Analytic base from CSV: columns by their header name, in any order, with the types of the base.

    The tariff may have its older name and the size class may be absent (then null); any other missing column is
    an error, and so are files with different headers, an empty base and a repeated key.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    for old, new in schemas.BASE_ALIASES.items():
        if old in raw.columns and new not in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    wanted = spark.createDataFrame([], schemas.BASE).schema
    missing = [f.name for f in wanted if f.name not in raw.columns and f.name not in schemas.BASE_OPTIONAL]
    if missing:
        raise ValueError(f"the base lacks {missing}")
    cols = [(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return check_unique(raw.select(*cols), list(keys))


def src_csv_infer(spark: SparkSession, path: str) -> DataFrame:
    """Older files: header and inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def src_premise(sheet: DataFrame, category: str = "Residencial") -> DataFrame:
    """Sheet of new connections to rows: month columns by their 'jan/27' name,
    example, repeated header and total rows dropped."""
    month_cols = [c for c in sheet.columns if len(c) == 6 and c[3] == "/"]
    first, *_ = sheet.columns
    note = F.col(sheet.columns[-1])
    rows = sheet.where((F.col(first) == category) & (note.isNull() | ~F.lower(note).contains("exemplo")))
    ids = sheet.columns[:5]
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").try_cast("double").alias("increment")) for c in month_cols])
    ).alias("cell")
    long = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(ids, ("category", "usage", "municipality", "project", "type"))], cells)
    return long.where(F.col("cell.increment").isNotNull() & (F.col("cell.increment") != 0)).select(
        "category", "usage", "municipality", "project", "type", parse_pt_month("cell.label").alias("period"),
        F.col("cell.increment").alias("increment"),
        normalise_name("municipality").alias("municipality_norm"),
        normalise_name("usage").alias("usage_norm"),
        normalise_name("type").alias("type_norm"),
    )


# fixed values: columns of the external forecast.  Raw: one measure a row.  Paired: the measures of a row side by side, by these names.
EXT_RAW = ("regiao", "categoria", "var", "valor")
EXT_PAIRED = {"vol_med_agua": ("vol_med_agua", "vol_med", "vol"), "econ_agua": ("econ_agua", "n_economias", "economias", "econ")}
EXT_KEYS = {"regiao": ("regiao", "cd_regiao_adj", "cd_regiao"), "categoria": ("categoria", "categoria_detalhe")}


def ext_layout(columns: Sequence[str]) -> str:
    """raw or paired, by the header."""
    names = {c.strip().lower() for c in columns}
    if set(EXT_RAW) <= names:
        return "raw"
    if all(names & set(v) for v in (*EXT_PAIRED.values(), *EXT_KEYS.values())):
        return "paired"
    raise ValueError(f"an external forecast has the columns {EXT_RAW}, or keys with volume and units, not {sorted(columns)}")


def ext_rows(sheet: DataFrame) -> DataFrame:
    """Either layout as raw rows: tp, periodo, categoria, regiao, var, valor (typed).

    The paired layout may have several pairs of columns, one a scenario or block, told apart by a suffix (``vol_med_2``, ``n_economias_2``):
    every pair becomes rows.  A missing ``tp`` is null; header names count without case and outer blanks.
    """
    by_name = {c.strip().lower(): F.col(f"`{c}`") for c in sheet.columns}
    layout = ext_layout(sheet.columns)

    def text(*names: str) -> Column:
        found = next((by_name[n] for n in names if n in by_name), F.lit(None))
        return found.cast("string")

    ids = [text("tp").alias("tp"), text("periodo").alias("periodo"), text(*EXT_KEYS["categoria"]).alias("categoria"), text(*EXT_KEYS["regiao"]).alias("regiao")]
    if layout == "raw":
        return sheet.select(*ids, text("var").alias("var"), by_name["valor"].try_cast("double").alias("valor"))
    cells = []
    for var, aliases in EXT_PAIRED.items():
        for name, c in by_name.items():
            stem = name.rstrip("0123456789").rstrip("_")
            if name in aliases or stem in aliases:
                cells.append(F.struct(F.lit(var).alias("var"), c.try_cast("double").alias("valor")))
    return sheet.select(*ids, F.explode(F.array(*cells)).alias("c")).select("tp", "periodo", "categoria", "regiao", "c.var", "c.valor")


def src_extforecast(sheet: DataFrame) -> DataFrame:
    """External forecast in either layout, recognised by its header: projection rows if any are marked, volume and units side by side."""
    rows = ext_rows(sheet).withColumn("period", parse_period("periodo"))
    has_proj = rows.agg(F.coalesce(F.bool_or(F.col("tp") == "PROJ"), F.lit(False)).alias("_p"))
    rows = rows.crossJoin(F.broadcast(has_proj)).where(~F.col("_p") | (F.col("tp") == "PROJ"))
    wide = rows.groupBy("period", "categoria", "regiao").pivot("var", list(EXT_PAIRED)).agg(F.sum("valor"))
    return wide.select(
        "period", F.col("regiao").alias("ext_region"), F.col("categoria").alias("ext_category"),
        F.col("vol_med_agua").alias("vol"), F.col("econ_agua").alias("units"),
    )


def src_decision(
    spark: SparkSession, decision: DataFrame, categories: DataFrame, segment: str, p: ProjectionParams
) -> DataFrame:
    """Grouping and model per target x category: own backtest, measured sibling,
    default; a manual line wins over all."""
    targets = relation(
        spark, [("target", "string"), ("sibling", "string")], [(t, MEASURED_SIBLING.get(t, t)) for t in TARGETS]
    )
    dec = decision.where(F.col("segment") == segment).select("target", "category_detail", "grouping", "model")
    ref = dec.select(
        F.col("target").alias("sibling"), "category_detail", F.col("grouping").alias("ref_grouping"),
        F.col("model").alias("ref_model"),
    )
    rows = (
        categories.crossJoin(F.broadcast(targets))
        .join(dec, ["target", "category_detail"], "left")
        .join(ref, ["sibling", "category_detail"], "left")
    )
    source = (
        F.when(F.col("model").isNotNull(), "backtest")
        .when(F.col("ref_model").isNotNull(), F.concat(F.lit("backtest ("), F.col("sibling"), F.lit(")")))
        .otherwise("padrão")
    )
    auto = rows.select(
        F.lit(segment).alias("segment"), "target", "category_detail",
        F.coalesce("grouping", "ref_grouping", F.lit(p.default_choice[0])).alias("grouping"),
        F.coalesce("model", "ref_model", F.lit(p.default_choice[1])).alias("model"),
        source.alias("source"),
    )
    return jn_override(auto, manual_choices(spark, p))


def manual_choices(spark: SparkSession, p: ProjectionParams) -> DataFrame:
    ddl = [(c, "string") for c in ("segment", "target", "category_detail", "m_grouping", "m_model")]
    return relation(spark, ddl, p.manual_choice)


def jn_override(choice: DataFrame, manual: DataFrame) -> DataFrame:
    """Update by key; manual lines without a match are ignored."""
    rows = choice.join(F.broadcast(manual), ["segment", "target", "category_detail"], "left")
    hit = F.col("m_model").isNotNull()
    model = F.when(hit, F.col("m_model")).otherwise(F.col("model"))
    return rows.select(
        "segment", "target", "category_detail",
        F.when(hit, F.col("m_grouping")).otherwise(F.col("grouping")).alias("grouping"),
        model.alias("model"),
        F.when(hit, "manual").otherwise(F.col("source")).alias("source"),
        F.when(model.isin(*VOLUME_MODELS), "volume").otherwise("consumo/economia").alias("model_kind"),
    )
