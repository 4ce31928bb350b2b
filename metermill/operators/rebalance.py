"""Rebalancing of a two-month window whose split is not reliable."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import median
from ..params import BaseParams
from ..schemas import GROUP_NO_DETAIL, SERIES_SIZE

VOLUMES = ["vol_meas_water", "vol_meas_sewage", "vol_bill_water", "vol_bill_sewage"]
STOCKS = ["units_water", "units_sewage", "conns_water", "conns_sewage"]
SCALED = {
    "vol_meas_water_raw": "vol_meas_water",
    "vol_bill_water_raw": "vol_bill_water",
    "vol_meas_water_imputed": "vol_meas_water",
}
COUNTS = ["n_bills", "days"]


def _month(start: date, k: int) -> date:
    i = start.year * 12 + start.month - 1 + k
    return date(i // 12, i % 12 + 1, 1)


def agg_share_year(valid: DataFrame, p: BaseParams) -> DataFrame:
    """First month's share of the two months per series x year, median over years."""
    first, second = p.window_start.month, _month(p.window_start, 1).month
    past = valid.where(F.month("period").isin(first, second) & (F.year("period") < p.window_start.year))
    v = F.col("vol_meas_water")
    yearly = past.groupBy(*SERIES_SIZE, F.year("period").alias("yr")).agg(
        F.try_divide(F.sum(F.when(F.month("period") == first, v)), F.sum(v)).alias("s")
    )
    return yearly.groupBy(*SERIES_SIZE).agg(median("s").alias("s"))  # one value per year


def rb_share(valid: DataFrame, p: BaseParams) -> DataFrame:
    """Share per series; outside the accepted range, the default."""
    ok = F.col("s").between(p.share_min, p.share_max)
    return agg_share_year(valid, p).withColumn("s", F.when(ok, F.col("s")).otherwise(p.share_default))


def agg_bimester(valid: DataFrame, p: BaseParams) -> DataFrame:
    months = [p.window_start, _month(p.window_start, 1)]
    cols = [*VOLUMES, *SCALED, *STOCKS, *COUNTS]
    return valid.where(F.col("period").isin(*months)).groupBy(*SERIES_SIZE).agg(*[F.sum(c).alias(c) for c in cols])


def agg_neighbours(valid: DataFrame, p: BaseParams) -> DataFrame:
    """Volumes and stocks of the months just before and after the window."""
    before, after = _month(p.window_start, -1), _month(p.window_start, 2)
    at = F.col("period")
    return valid.where(at.isin(before, after)).groupBy(*SERIES_SIZE).agg(
        *[F.sum(v).alias(f"near_{v}") for v in VOLUMES],
        *[F.sum(F.when(at == before, F.col(c))).alias(f"before_{c}") for c in STOCKS],
        *[F.sum(F.when(at == after, F.col(c))).alias(f"after_{c}") for c in STOCKS],
    )


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.join(right, SERIES_SIZE, how)


def jn_using8(bimester: DataFrame, share: DataFrame, near: DataFrame, p: BaseParams) -> DataFrame:
    joined = _null_safe(_null_safe(bimester, share, "left"), near, "left")
    return joined.withColumn("s", F.coalesce("s", F.lit(p.share_default)))


def win_named_group(joined: DataFrame) -> DataFrame:
    """Group totals over category details of the same place, size and territory."""
    w = Window.partitionBy(*GROUP_NO_DETAIL)
    sums: dict[str, Column] = {}
    for v in VOLUMES:
        has = F.col(f"near_{v}") > 0
        sums[f"group_{v}"] = F.sum(F.when(has, F.col(v))).over(w)
        sums[f"group_near_{v}"] = F.sum(F.when(has, F.col(f"near_{v}"))).over(w)
    return joined.withColumns(sums)


def rb_redistribute(joined: DataFrame) -> DataFrame:
    """The group's two-month total split like its neighbour months; series
    without neighbours keep their own.  Group totals do not change."""
    rows = win_named_group(joined)
    new = {}
    for v in VOLUMES:
        split = F.col(f"group_{v}") * F.col(f"near_{v}") / F.col(f"group_near_{v}")
        new[f"new_{v}"] = F.when(F.col(f"near_{v}") > 0, split)
    rows = rows.withColumns(new)
    factor = {
        v: F.coalesce(F.try_divide(F.col(f"new_{v}"), F.col(v)), F.lit(1.0)) for v in ("vol_meas_water", "vol_bill_water")
    }
    rows = rows.withColumns({f"factor_{v}": f for v, f in factor.items()})
    scaled = {c: F.col(c) * F.col(f"factor_{v}") for c, v in SCALED.items()}
    volumes = {v: F.coalesce(F.col(f"new_{v}"), F.col(v)) for v in VOLUMES}
    keep = [*SERIES_SIZE, "s", *VOLUMES, *SCALED, *STOCKS, *COUNTS]
    near = [f"{side}_{c}" for c in STOCKS for side in ("before", "after")]
    return rows.withColumns({**volumes, **scaled}).select(*keep, *near)


def jn_k(bimester: DataFrame) -> DataFrame:
    """One row per month of the window."""
    return bimester.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))


def rb_stock(bimester: DataFrame) -> DataFrame:
    """Stocks interpolated between the neighbours; half of the sum without one."""
    rows = jn_k(bimester)
    new = {}
    for c in STOCKS:
        a, b = F.col(f"before_{c}"), F.col(f"after_{c}")
        new[c] = F.coalesce(a + (b - a) * F.col("k") / F.lit(3.0), F.col(c) / F.lit(2.0))
    return rows.withColumns(new)


def rb_emit(valid: DataFrame, stocked: DataFrame | None, p: BaseParams) -> DataFrame:
    """Untouched months plus the two rebuilt ones (matched by name)."""
    cols = [*SERIES_SIZE, "period", *VOLUMES, *STOCKS, *COUNTS, *SCALED]
    numeric = [c for c in cols if c not in SERIES_SIZE and c != "period"]
    as_double = {c: F.col(c).cast("double") for c in numeric}
    if p.window_start is None:
        return valid.select(*cols).withColumns(as_double).withColumn("rebalanced", F.lit(False))
    first, second = p.window_start, _month(p.window_start, 1)
    rest = valid.where(~F.col("period").isin(first, second)).select(*cols).withColumns(as_double)
    part = F.when(F.col("k") == 1, F.col("s")).otherwise(1 - F.col("s"))
    built = stocked.withColumns(
        {
            **{c: F.col(c) * part for c in [*VOLUMES, *SCALED]},
            **{c: F.col(c) / F.lit(2.0) for c in COUNTS},
            "period": F.when(F.col("k") == 1, F.lit(first)).otherwise(F.lit(second)),
        }
    ).select(*cols).withColumns(as_double)
    return rest.withColumn("rebalanced", F.lit(False)).unionByName(built.withColumn("rebalanced", F.lit(True)))


def rebalance(valid: DataFrame, p: BaseParams) -> DataFrame:
    if p.window_start is None:
        return rb_emit(valid, None, p)
    joined = jn_using8(agg_bimester(valid, p), rb_share(valid, p), agg_neighbours(valid, p), p)
    return rb_emit(valid, rb_stock(rb_redistribute(joined)), p)
