"""Window patterns over month series and ordered totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from .dates import month_index
from .numeric import as_column

UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)
FROM_NOW = (Window.currentRow, Window.unboundedFollowing)


def over_time(keys: Sequence[str], period: str = "period") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(period)


def carry_forward(x, w: WindowSpec) -> Column:
    return F.last(as_column(x), ignorenulls=True).over(w.rowsBetween(*UP_TO_NOW))


def carry_back(x, w: WindowSpec) -> Column:
    return F.first(as_column(x), ignorenulls=True).over(w.rowsBetween(*FROM_NOW))


def fill_both(x, w: WindowSpec) -> Column:
    """Down first, then up."""
    return F.coalesce(carry_forward(x, w), carry_back(x, w))


def interpolate(x, w: WindowSpec, position) -> Column:
    """Linear between known points, constant outside them.

    ``position`` is the numeric abscissa (a month index).
    """
    x, t = as_column(x), as_column(position)
    known_t = F.when(x.isNotNull(), t)
    x0, t0 = carry_forward(x, w), carry_forward(known_t, w)
    x1, t1 = carry_back(x, w), carry_back(known_t, w)
    inside = x0 + (x1 - x0) * (t - t0) / (t1 - t0)
    return (
        F.when(x.isNotNull(), x.cast("double"))
        .when(x0.isNotNull() & x1.isNotNull(), inside)
        .otherwise(F.coalesce(x0, x1).cast("double"))
    )


def interpolate_months(df: DataFrame, keys: Sequence[str], cols: Sequence[str], period: str = "period") -> DataFrame:
    w = over_time(keys, period)
    t = month_index(period).cast("double")
    return df.withColumns({c: interpolate(c, w, t) for c in cols})


def run_id(flag, w: WindowSpec) -> Column:
    """Number of changes of a flag so far: equal inside a run (NULL = false)."""
    f = F.coalesce(as_column(flag), F.lit(False))
    changed = f != F.lag(f, 1, False).over(w)
    return F.sum(changed.cast("int")).over(w.rowsBetween(*UP_TO_NOW))


def complete_months(df: DataFrame, keys: Sequence[str], period: str = "period") -> DataFrame:
    """Every month between the first and last of each key; new rows are NULL."""
    span = df.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias(period))
    return grid.join(df, [*keys, period], "left")


def running_share(df: DataFrame, value: str, name: str, out: str, buckets: int = 64) -> DataFrame:
    """Cumulative share of the grand total, largest first, ties by name.

    The order is split into ``buckets`` ranges of the value, so no task sorts
    the whole relation: each range keeps its own running sum and adds the total
    of the ranges above it.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(value, cuts, 10_000).alias("_e"))
    cut = df.crossJoin(F.broadcast(edges)).withColumn(
        "_b", F.size(F.filter("_e", lambda e: e > F.col(value)))
    ).drop("_e")
    per_bucket = cut.groupBy("_b").agg(F.sum(value).alias("_s"))  # at most `buckets` rows
    w = Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        "_b",
        (F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_o"),
        F.sum("_s").over(w).alias("_t"),
    )
    run = F.sum(value).over(
        Window.partitionBy("_b").orderBy(F.col(value).desc(), F.col(name)).rowsBetween(*UP_TO_NOW)
    )
    return (
        cut.join(F.broadcast(offsets), "_b")
        .withColumn(out, F.try_divide((F.col("_o") + run).cast("double"), F.col("_t").cast("double")))
        .drop("_b", "_o", "_t")
    )


def rank_by_cells(
    df: DataFrame, keys: Sequence[str], cells: Sequence[Column], ties: Sequence[Column], out: str
) -> DataFrame:
    """row_number over ``keys`` ordered by ``cells`` then ``ties``.

    A hot key is split along its own leading order: rows are numbered inside
    each (key, cell) and shifted by the number of rows in earlier cells.
    """
    names = [f"_cell{i}" for i in range(len(cells))]
    df = df.withColumns(dict(zip(names, cells)))
    counts = df.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(*names)
    counts = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    same = None
    for c in [*keys, *names]:
        eq = F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
        same = eq if same is None else same & eq
    inside = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*ties))
    numbered = df.withColumn("_i", inside)
    joined = numbered.alias("d").join(counts.alias("c"), same)
    keep = [F.col(f"d.{c}") for c in df.columns if c not in names]
    return joined.select(*keep, (F.col("d._i") + F.col("c._before")).cast("int").alias(out))
