"""Bills to the account-month fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.dates import yyyymm
from ..rules import (
    AVAILABILITY_SUFFIX, CODE_RULES, NO_ACCOUNT, NO_ITEM, REUSE_ITEM, SEWAGE_PREFIX, WATER_PREFIX, CodeRule,
)

BILL_COLUMNS = [
    "account", "contract", "issue_date", "year", "month", "office", "benefit_type", "product_code", "class_code",
    "usage_code", "water_item", "sewage_item", "units", "days", "meas_water", "meas_sewage", "meas_effluent",
    "bill_water_pos", "bill_water_neg", "bill_sewage_pos", "bill_sewage_neg", "bill_effluent_pos",
    "bill_effluent_neg",
]


def src_bills(bills: DataFrame) -> DataFrame:
    """Processed bills only."""
    return bills.where(F.col("processed") == "S")


def prj_dedup(bills: DataFrame) -> DataFrame:
    """Exact copies removed; a missing item is '-1'.

    Copies share every column: rows that lie by contract stay there, others
    are shuffled by the whole row, so a hot account spreads evenly.
    """
    item = {c: F.coalesce(F.col(c), F.lit(NO_ITEM)) for c in ("water_item", "sewage_item")}
    return src_bills(bills).withColumns(item).select(*BILL_COLUMNS).distinct()


def win_latest(registry: DataFrame) -> DataFrame:
    """Latest territory of each account: newest end date, open dates last."""
    w = Window.partitionBy("account").orderBy(F.col("end_date").desc_nulls_last(), F.col("registry_id").desc())
    ranked = registry.withColumn("rn", F.row_number().over(w))
    return ranked.where("rn = 1").select("account", "territory")


def jn_latest(rows: DataFrame, latest: DataFrame) -> DataFrame:
    return rows.join(latest, "account", "left")


def prj_item(bills: DataFrame) -> DataFrame:
    """Billable item without its service prefix."""
    water, sewage = F.col("water_item"), F.col("sewage_item")
    code = (
        F.when(water == REUSE_ITEM, water)
        .when(water != NO_ITEM, F.replace(water, F.lit(WATER_PREFIX), F.lit("")))
        .when(sewage.startswith(SEWAGE_PREFIX), F.replace(sewage, F.lit(SEWAGE_PREFIX), F.lit("")))
        .when(sewage != NO_ITEM, sewage)
    )
    return bills.withColumn("item_code", code)


def prj_flags(bills: DataFrame) -> DataFrame:
    water, sewage = F.col("water_item"), F.col("sewage_item")
    return bills.withColumns(
        {
            "is_water": water != NO_ITEM,
            "is_sewage": sewage != NO_ITEM,
            "is_avail": (sewage != NO_ITEM) & sewage.endswith(AVAILABILITY_SUFFIX),
        }
    )


def _matches(rule: CodeRule) -> Column:
    item, klass = F.col("item_code"), F.col("class_code")
    parts: list[Column] = []
    if rule.items:
        hit = item.isin(*rule.items)
        parts.append(item.isNull() | hit if rule.no_item else hit)
    if rule.product:
        parts.append(F.col("product_code") == rule.product)
    if rule.product_prefix:
        parts.append(F.col("product_code").startswith(rule.product_prefix))
    if rule.benefit:
        parts.append(F.col("benefit_type") == rule.benefit)
    if rule.class_in:
        parts.append(klass.isin(*rule.class_in))
    if len(rule.class_has) == 1:
        parts.append(klass.contains(rule.class_has[0]))
    elif rule.class_has:
        parts.append(klass.rlike("(" + "|".join(rule.class_has) + ")"))
    if rule.usage:
        parts.append(F.col("usage_code") == rule.usage)
    return reduce(lambda a, b: a & b, parts)


def prj_classify(bills: DataFrame) -> DataFrame:
    """Category code of the first rule that matches, NULL if none does."""
    first, *rest = CODE_RULES
    code = F.when(_matches(first), first.code)
    for rule in rest:
        code = code.when(_matches(rule), rule.code)
    return bills.withColumn("category_code", code)


def flt_pattern(bills: DataFrame) -> DataFrame:
    """Pattern predicates of the classification, as flags on distinct codes."""
    klass = F.col("class_code")
    return bills.groupBy("class_code").agg(F.count("*").alias("n_bills")).select(
        "class_code",
        klass.like(r"%SOC\_50%").alias("is_soc_50"),
        (~klass.like(r"%\_COMER%")).alias("not_comer"),
        klass.rlike("(_PRO|CON_PR|PUB_PR)").alias("is_program"),
        "n_bills",
    )


def agg_account_month(coded: DataFrame, latest: DataFrame) -> DataFrame:
    """The account-month fact.

    Units are a stock of the account, so several bills of a month keep the
    largest value.  Volumes add per row: a NULL part drops that row's pair.
    Bills are summed before the territory is attached (one territory per
    account), so a hot account is already small when it reaches the join.
    """
    units, water, sewage, avail = F.col("units"), F.col("is_water"), F.col("is_sewage"), F.col("is_avail")
    real = sewage & ~avail
    zero = F.lit(0)
    meas = F.col("meas_sewage") + F.col("meas_effluent")
    bill_water = F.col("bill_water_pos") + F.col("bill_water_neg")
    bill_sewage = (
        F.col("bill_sewage_pos") + F.col("bill_sewage_neg") + F.col("bill_effluent_pos") + F.col("bill_effluent_neg")
    )

    def best(flag: Column) -> Column:
        return F.max(F.when(flag, units).otherwise(zero))

    def part(flag: Column, v: Column) -> Column:
        return F.sum(F.when(flag, v).otherwise(zero))

    agg = coded.groupBy("account", "category_code", "item_code", "office", "year", "month").agg(
        F.count("*").alias("n_bills"),
        F.sum("days").alias("days"),
        F.max(units).alias("units"),
        best(water).alias("units_water"),
        best(sewage).alias("units_sewage"),
        best(real).alias("units_sewage_real"),
        best(avail).alias("units_sewage_avail"),
        F.max(water.cast("int")).alias("has_water"),
        F.max(sewage.cast("int")).alias("has_sewage"),
        F.max(real.cast("int")).alias("has_sewage_real"),
        F.max(avail.cast("int")).alias("has_sewage_avail"),
        F.sum("meas_water").alias("vol_meas_water"),
        F.sum(meas).alias("vol_meas_sewage"),
        part(~avail, meas).alias("vol_meas_sewage_real"),
        part(avail, meas).alias("vol_meas_sewage_avail"),
        F.sum(bill_water).alias("vol_bill_water"),
        F.sum(bill_sewage).alias("vol_bill_sewage"),
        part(~avail, bill_sewage).alias("vol_bill_sewage_real"),
        part(avail, bill_sewage).alias("vol_bill_sewage_avail"),
    )
    return jn_latest(agg, latest)


def fact_by_account(clean: DataFrame, latest: DataFrame) -> DataFrame:
    """The fact of deduplicated bills, dealt out by account.

    Bills of real accounts are shuffled once, after their codes have become a
    category and an item: they are summed and get their territory in that place.
    The others, a few accounts of very many bills, are dealt out by all their keys.
    """
    mine = classified(clean.where(has_account())).repartition("account")
    others = classified(clean.where(~has_account()))
    return agg_account_month(mine, latest).unionByName(agg_account_month(others, latest.where(~has_account())))


def coded_bills(bills: DataFrame) -> DataFrame:
    return classified(prj_dedup(bills))


def classified(clean: DataFrame) -> DataFrame:
    """The same from bills that are deduplicated already."""
    return prj_classify(prj_flags(prj_item(clean)))


def has_account() -> Column:
    """Rows of a real account.  The others can be a third of the fact and match no size class or factor."""
    return F.coalesce(F.col("account") != NO_ACCOUNT, F.lit(False))


def flt_account(fact: DataFrame) -> DataFrame:
    """Bills without an account are not a customer."""
    return fact.where(F.col("account").isNotNull() & (F.col("account") != NO_ACCOUNT))


def prj_yyyymm(fact: DataFrame, first: int, last: int) -> DataFrame:
    key = yyyymm("year", "month")
    return fact.withColumn("yyyymm", key).where(key.between(first, last))
