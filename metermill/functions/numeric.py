"""Numeric expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def as_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def snap_round(x, digits: int) -> Column:
    """Round half up after snapping floating noise away.

    Sums of doubles depend on partition order in the last bits.  Snapping to
    ``digits + 4`` decimals first keeps a printed digit from flipping when a
    task is retried elsewhere.  NaN and infinities become NULL.
    """
    snapped = as_column(x).try_cast(f"decimal(38,{digits + 4})")
    return F.round(snapped, digits).cast("double")


def ratio(num, den) -> Column:
    """Division giving NULL for a zero or NULL denominator."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def percent(num, den, digits: int) -> Column:
    return snap_round(F.lit(100.0) * ratio(num, den), digits)


def finite(x) -> Column:
    """NULL for NaN and infinities."""
    c = as_column(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes NULL (Spark keeps them apart)."""
    fixed = {
        f.name: F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fixed) if fixed else df


def weighted_mean(x, w) -> Column:
    """Aggregate: mean of x weighted by w over the rows where x is present."""
    x, w = as_column(x), as_column(w)
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def product(x) -> Column:
    """Aggregate: product of positive factors as exp(sum(ln))."""
    return F.exp(F.sum(F.ln(as_column(x))))


def median(x) -> Column:
    """Aggregate: exact interpolated median, for groups of a bounded size."""
    return F.percentile(as_column(x), F.lit(0.5))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles, all in one aggregation.

    One row per key, one column per entry of ``probs``.  A group's buffer holds its distinct values with their
    counts; the groups here are the series of a model term, so it is bounded by the number of series.
    """
    q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
    found = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("_q"))
    return found.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
