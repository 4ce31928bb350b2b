"""The TPC-H-like test tables read as utility billing inputs.

Line items are bills, customers are accounts, nations are municipalities.  The
code strings are spread so that every classification rule has rows.  Volumes
are decimals: their sums do not depend on the order of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import snap_round
from ..rules import CATEGORY_MAP, NO_ACCOUNT
from .values import relation

RESIDENTIAL_A = (
    ["RES"] * 8 + ["V_RES", "RES_D"] + ["SOC"] * 4 + ["SOC_2"] * 2 + ["FAV"] * 4 + [None, "NOR_1F", "CAM", "EMB", "PER"]
)
RESIDENTIAL_B = ["RES"] * 12 + ["SOC"] * 4 + ["FAV"] * 5 + ["RES_D", "MIN", "V_RES", None]
COMMERCIAL = ["COM"] * 14 + ["COM_D"] * 2 + ["CIP"] * 2 + ["DF", "DFN", "PERS_M", "NOR_5F", None, "COM", "SB_REUSO"]
INDUSTRIAL = ["IND"] * 16 + ["CIP"] * 3 + ["DF"] * 2 + [None] + ["IND"] * 3
PUBLIC = ["PUB"] * 12 + ["PUB_M"] * 6 + [None] * 2 + ["XYZ"] + ["PUB"] * 4
ITEMS_BY_SEGMENT = {
    "HOUSEHOLD": RESIDENTIAL_A,
    "FURNITURE": RESIDENTIAL_B,
    "BUILDING": COMMERCIAL,
    "MACHINERY": INDUSTRIAL,
    "AUTOMOBILE": PUBLIC,
}
CLASS_BY_SEGMENT = {
    "RES": {"SMALL": "SB_R_SOC_75", "MEDIUM": "SB_R_ESPECIAL", "PROMO": "SB_LINS_ESPECIAL", "STANDARD": "SB_RES"},
    "BUILDING": {
        "ECONOMY": "SB_COM_AS_1", "SMALL": "SB_COM_ESPECIAL", "MEDIUM": "SB_COM", "PROMO": "SB_C_INDUS",
        "STANDARD": "SB_C_COMER_2",
    },
    "MACHINERY": {
        "ECONOMY": "SB_C_INDUS", "SMALL": "SB_C_COMER", "MEDIUM": "SB_IND", "PROMO": "SB_IND", "STANDARD": "SB_IND",
    },
    "AUTOMOBILE": {
        "ECONOMY": "SB_PUB_PROG", "SMALL": "SB_PUB_CON_PURA", "MEDIUM": "SB_PUB_CON_PR_1", "PROMO": "SB_PUBPROG",
        "STANDARD": "SB_PUB",
    },
}
BENEFIT_BY_LINE = ["-1", "0", "16", "17", "19", "0", "0"]
UNKNOWN_OFFICE = 5  # offices with office % 37 = 5 are missing from the geography


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), position)


def account_id(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.when(k % 97 == 0, NO_ACCOUNT).when(k % 101 == 1, None).otherwise(k.cast("string"))


def office_id() -> Column:
    return (F.col("c_nationkey") * 10 + F.col("c_custkey") % 3).cast("int")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"
    )
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    # the order comes last and brings its customer along: the rows then lie by order, where copies of a bill meet
    # without another shuffle, and line items are shuffled twice at most
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(
        o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")
    )
    # code strings come from two small VALUES lists instead of long CASE chains
    items = relation(
        spark, [("i_segment", "string"), ("i_brand", "string"), ("item", "string")],
        [(k, f"Brand#{n}", code) for k, codes in ITEMS_BY_SEGMENT.items() for n, code in enumerate(codes, 1)],
    )
    classes = relation(
        spark, [("k_segment", "string"), ("k_type", "string"), ("k_class", "string")],
        [(k, t, v) for k in ITEMS_BY_SEGMENT for t, v in CLASS_BY_SEGMENT.get(k, CLASS_BY_SEGMENT["RES"]).items()],
    )
    j = j.join(
        F.broadcast(items), (F.col("c_mktsegment") == F.col("i_segment")) & (F.col("p_brand") == F.col("i_brand")), "left"
    ).join(
        F.broadcast(classes), (F.col("c_mktsegment") == F.col("k_segment")) & (F.col("p_type") == F.col("k_type")), "left"
    )
    seg, kind, line, item = F.col("c_mktsegment"), F.col("p_type"), F.col("l_linenumber"), F.col("item")
    brand = F.col("p_brand")
    residential = seg.isin("HOUSEHOLD", "FURNITURE")
    class_code = F.when(
        residential & (kind == "ECONOMY"), F.when(line == 5, "SB_SOC_50_4").otherwise("SB_SOC_50_1")
    ).otherwise(F.col("k_class"))
    supp = F.col("l_suppkey") % 11
    product = (
        F.when(residential & (supp == 0), "SB_SOCIAL_2_SR")
        .when(residential & supp.isin(1, 2), "SB_SOCIAL_1")
        .when(residential & (supp == 3), "SB_FAVELAS_N")
        .when(residential, "SB_RES_N")
        .when((seg == "AUTOMOBILE") & (supp == 0), "SB_PUBLICA_MUN_O")
        .when((seg == "AUTOMOBILE") & (supp == 1), "SB_PREDIO")
        .otherwise("SB_NORMAL")
    )
    usage = (
        F.when(residential, "1")
        .when((seg == "BUILDING") & (brand == "Brand#17"), "5")
        .when(seg == "BUILDING", "2")
        .when((seg == "MACHINERY") & brand.isin("Brand#19", "Brand#21"), "9")
        .when(seg == "MACHINERY", "3")
        .otherwise("4")
    )
    water, sewage = F.col("l_returnflag") != "N", F.col("l_linestatus") == "O"
    water_item = F.when(
        water & item.isNotNull(), F.when(item == "SB_REUSO", item).otherwise(F.concat(F.lit("SB_AGUA_"), item))
    )
    sewage_item = F.when(
        sewage & item.isNotNull(),
        F.when(brand == "Brand#25", "SB_ESG_ND_ESP_4F").otherwise(
            F.concat(F.lit("SB_ESGOTO_"), item, F.when(kind == "PROMO", "_D").otherwise(""))
        ),
    )
    qty = F.col("l_quantity").cast("decimal(12,2)")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    milli = F.lit("0.001").cast("decimal(4,3)")
    zero = F.lit(0).cast("decimal(18,7)")

    def vol(x: Column) -> Column:
        return x.cast("decimal(18,7)")

    pos = vol(price * milli)
    neg = vol(-price * disc * milli)
    credit = (F.col("l_returnflag") == "R") & (line == 5)
    eight = F.lit("0.8").cast("decimal(2,1)")
    tenth = F.lit("0.1").cast("decimal(2,1)")
    out = j.select(
        account_id("o_custkey").alias("account"),
        F.col("l_orderkey").alias("contract"),
        F.to_date("l_shipdate").alias("issue_date"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        office_id().alias("office"),
        F.when(residential, _pick(BENEFIT_BY_LINE, line)).otherwise("0").alias("benefit_type"),
        product.alias("product_code"),
        class_code.alias("class_code"),
        usage.alias("usage_code"),
        water_item.alias("water_item"),
        sewage_item.alias("sewage_item"),
        (1 + F.col("o_custkey") % 4).cast("int").alias("units"),
        (20 + F.col("l_partkey") % 25).cast("int").alias("days"),
        F.when(water, vol(qty)).otherwise(zero).alias("meas_water"),
        F.when(sewage, vol(qty * eight)).otherwise(zero).alias("meas_sewage"),
        F.when(line == 7, None).when(line == 6, vol(qty * tenth)).otherwise(zero).alias("meas_effluent"),
        F.when(water, pos).otherwise(zero).alias("bill_water_pos"),
        F.when(water & credit, vol(pos * -2)).when(water, neg).otherwise(zero).alias("bill_water_neg"),
        F.when(sewage, vol(pos * eight)).otherwise(zero).alias("bill_sewage_pos"),
        F.when(sewage, vol(neg * eight)).otherwise(zero).alias("bill_sewage_neg"),
        zero.alias("bill_effluent_pos"),
        zero.alias("bill_effluent_neg"),
        F.when(F.col("o_orderstatus") == "P", "N").otherwise("S").alias("processed"),
        F.when(F.col("l_partkey") % 50 == 0, 2).otherwise(1).alias("_copies"),
    )
    # one bill in fifty arrives twice, as an exact copy
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return out.select("*", copies.alias("_copy")).drop("_copy", "_copies")


def bill_rows(spark: SparkSession, sf_dir: str) -> int:
    """Number of line items, from the files' own counts."""
    return read(spark, sf_dir, "lineitem").count()


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    prio, key = F.col("o_orderpriority"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("account"),
        F.when(prio == "1-URGENT", "Urbano")
        .when(prio == "2-HIGH", "Rural")
        .when(prio == "3-MEDIUM", "Informal")
        .when(prio == "5-LOW", " Urbano ")
        .when(key % 3 == 0, "null")
        .when(key % 3 == 1, "0")
        .alias("territory"),
        F.when((F.col("o_orderstatus") == "P") & (key % 2 == 0), None)
        .otherwise(F.to_date("o_orderdate"))
        .alias("end_date"),
        key.alias("registry_id"),
    )


def category_map(spark: SparkSession) -> DataFrame:
    ddl = [(c, "string") for c in ("category_code", "category_name", "category_detail", "category")]
    return relation(spark, ddl, CATEGORY_MAP)


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.lit(3500007) + F.col("n_nationkey") * 10).cast("string").alias("ibge_full"),
        F.col("n_name").alias("municipality"),
        F.col("r_name").alias("region"),
        F.col("n_nationkey").alias("nation_key"),
    )


def geo_map_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geography as delivered: some offices missing, some listed twice."""
    m = municipalities(spark, sf_dir)
    part = F.explode(F.sequence(F.lit(0), F.lit(2)))
    g = m.select("*", part.alias("k")).select(
        (F.col("nation_key") * 10 + F.col("k")).cast("int").alias("office"), "region", "municipality", "ibge_full"
    )
    g = g.where(F.col("office") % 37 != UNKNOWN_OFFICE)
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("office") % 50 == 0, 2).otherwise(1)))
    return g.select("*", times.alias("_t")).drop("_t")


def geo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_map_raw(spark, sf_dir).distinct()


def _orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn(
        "period", F.to_date(F.trunc("o_orderdate", "month"))
    )


def _code(nation) -> Column:
    return (F.lit(350000) + F.col(nation)).cast("string")


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, taxes and discounts per month and municipalities of the customer, the source of climate and prices.

    An order's line items are summed before they are shuffled.  ``nations`` has an entry for each row of the
    customer (NULL: no such customer), so that orders are not multiplied.
    """
    tax, disc = F.col("l_tax").cast("decimal(4,2)"), F.col("l_discount").cast("decimal(4,2)")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(tax).alias("tax"), F.sum(disc).alias("disc"), F.count("*").alias("n")
    )
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.to_date(F.trunc("o_orderdate", "month")).alias("period")
    )
    c = read(spark, sf_dir, "customer").groupBy("c_custkey").agg(F.collect_list(F.struct("c_nationkey")).alias("nations"))
    j = sums.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("nations", "period").agg(*[F.sum(x).alias(x) for x in ("tax", "disc", "n")])


def climate_monthly(months: DataFrame) -> DataFrame:
    """Monthly climate per municipality, from ``order_months``."""
    tax, disc, n = F.sum("tax").cast("double"), F.sum("disc").cast("double"), F.sum("n")
    return months.select(F.explode("nations").alias("_at"), "period", "tax", "disc", "n").groupBy("_at.c_nationkey", "period").agg(
        snap_round(F.lit(20.0) + F.lit(10.0) * disc / n, 6).alias("temp_med"),
        snap_round(F.lit(0.1) + F.lit(100.0) * tax / n, 6).alias("prec_tot"),
    ).select(_code("c_nationkey").alias("ibge_code"), "period", "temp_med", "prec_tot")


def jobs_monthly(spark: SparkSession, sf_dir: str, with_balance: bool = False) -> DataFrame:
    """Stock of formal jobs."""
    j = _orders_by_nation(spark, sf_dir)
    total = F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double")
    out = j.groupBy("c_nationkey", "period").agg(snap_round(total / 1000, 2).alias("stock"))
    return out.select(_code("c_nationkey").alias("ibge_code"), "period", "stock")


def price_index_monthly(months: DataFrame) -> DataFrame:
    """Monthly inflation in percent, from ``order_months``."""
    disc = F.sum("disc").cast("double")
    return months.groupBy("period").agg(snap_round(F.lit(20.0) * disc / F.sum("n") - F.lit(0.5), 2).alias("value"))


#: Daily variables of the test tables: where -999 stands for no value (event id modulo), digits, and the value from the day's events.
def daily_variables() -> dict[str, tuple[int, int, Column]]:
    value = F.col("value").cast("decimal(12,2)")
    mean = F.sum(value).cast("double") / F.count("*")
    high, low = F.max(value).cast("double"), F.min(value).cast("double")
    return {
        "T2M": (97, 4, mean), "T2M_MAX": (101, 4, high), "T2M_MIN": (103, 4, low), "PRECTOTCORR": (107, 4, mean / 10),
        "RH2M": (109, 4, 100 - low / 10), "T2MDEW": (113, 4, mean - 5), "WS2M": (127, 4, (high - low) / 20),
    }


def climate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings per day, -999 where a variable is missing."""
    e = read(spark, sf_dir, "events")
    first = F.min("event_id")
    cells = [F.when(first % k == 0, -999.0).otherwise(snap_round(v, digits)).alias(name) for name, (k, digits, v) in daily_variables().items()]
    return e.groupBy(F.col("user_id").cast("string").alias("cd_ibge"), F.date_format("ts", "yyyyMMdd").alias("day")).agg(*cells)


def new_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned connections: one row per category x usage x municipality x type x month."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    usage = F.when(k % 3 == 0, "Normal").when(k % 3 == 1, "Rural").otherwise("Tarifa Social")
    kind = F.when(k % 5 == 0, "A/E").when(k % 5 < 3, "Água").otherwise("Esgoto")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(
        usage.alias("usage"),
        F.regexp_replace(F.initcap(F.lower("n_name")), "_", "-").alias("municipality"),
        kind.alias("type"),
        (k % 12 + 1).cast("int").alias("month_no"),
    ).agg(F.count("*").cast("double").alias("increment"))
