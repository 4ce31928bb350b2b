"""Versions of a table: what a batch touches, what an audit refuses, what a snapshot brings back."""

import glob
import hashlib
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from metermill.operators.covariates import failing_points
from metermill.operators.quality import dq_d5
from metermill.params import CovariateParams
from metermill.sources.published import Conflict, PublishedTable, Refused
from metermill.sources.sinks import snk_snapshot
from metermill.streaming.incremental import snk_upsert, src_watermark

SCHEMA = "point string, period date, value double"
JAN, FEB, MAR, APR = (date(2020, m, 1) for m in (1, 2, 3, 4))


def table(spark, tmp_path, **more):
    return PublishedTable(spark, f"{tmp_path}/t-{uuid.uuid4().hex}", "period", ["point", "period"], point="point", period="period", **more)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(t):
    """Name and contents of every data file of the published version."""
    found = {}
    for r in t.manifest().collect():
        with open(r.file.removeprefix("file:").replace("///", "/"), "rb") as f:
            found[r.file] = (r.value, hashlib.sha1(f.read()).hexdigest())
    return found


@pytest.fixture
def first(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(p, m, 1.0) for p in "abcdefghij" for m in (JAN, FEB, MAR)], SCHEMA))
    return t


def test_untouched_months_keep_their_files(spark, first):
    before = files(first)
    read = snk_upsert(first, spark.createDataFrame([("a", MAR, 7.0), ("z", APR, 8.0)], SCHEMA))
    after = files(first)
    kept = {f: x for f, x in before.items() if x[0] in (str(JAN), str(FEB))}
    assert kept and {f: x for f, x in after.items() if x[0] in (str(JAN), str(FEB))} == kept
    assert not {f for f, x in before.items() if x[0] == str(MAR)} & set(after)
    got = {(r.point, r.period): r.value for r in read.collect()}
    assert got[("a", MAR)] == 7.0 and got[("z", APR)] == 8.0 and got[("b", MAR)] == 1.0 and len(got) == 31
    assert sum(r["rows"] for r in first.manifest().collect()) == 31


def test_refused_batch_leaves_the_table_byte_for_byte(spark, first):
    """6 % of the points fail: nothing is published; 4 %: the batch is."""
    p = CovariateParams()
    before, version, marks = files(first), first.current(), rows(first.watermarks())

    def batch(failing):
        return spark.createDataFrame([(f"p{i}", APR, None if i < failing else 2.0) for i in range(100)], SCHEMA)

    audit = failing_points("point", F.col("value"), 1, p)
    with pytest.raises(Refused) as refused:
        snk_upsert(first, batch(6), audit)
    assert (refused.value.points, refused.value.failures) == (100, 6)
    assert first.current() == version and files(first) == before and rows(first.watermarks()) == marks
    assert snk_upsert(first, batch(4), audit).count() == 130
    assert set(before) < set(files(first)) and len(first.files.names("commits")) == 2


def test_second_of_two_writers_fails(spark, first):
    other = PublishedTable(spark, first.root, "period", ["point", "period"], point="point", period="period")
    base = other.current()
    first.upsert(spark.createDataFrame([("a", JAN, 3.0)], SCHEMA))
    other.current = lambda: base
    with pytest.raises(Conflict):
        other.upsert(spark.createDataFrame([("a", JAN, 4.0)], SCHEMA))
    assert {r.value for r in first.read().where("point = 'a'").where(F.col("period") == JAN).collect()} == {3.0}


def test_unfinished_commit_does_not_count(first):
    version = first.current()
    first.files.create("commits/00000009", "")
    assert first.current() == version


def test_snapshot_restores_without_a_copy(spark, tmp_path):
    keys = ["category", "period"]
    t = PublishedTable(spark, f"{tmp_path}/h", "period", keys)
    base = spark.createDataFrame(
        [(c, y, m, date(y, m, 1), 10.0 * m, 5.0, 3, 10.0 * m) for c in ("A", "B") for y in (2020, 2021) for m in (1, 2)],
        "category string, year int, month int, period date, vol_meas_water double, vol_bill_water double, units_water int, vol_meas_water_raw double",
    )
    t.upsert(base)
    held = files(t)
    snap = snk_snapshot(t, "before")
    t.upsert(base.where("category = 'A' and month = 1").withColumn("vol_meas_water", F.lit(15.0)))
    change = {(r.year, r.month, r.category): (r.vol_meas_before, r.vol_meas_new, r.pct_change_meas) for r in dq_d5(t.read(), snap).collect()}
    assert change[(2020, 1, "A")] == (10.0, 15.0, 50.0) and change[(2020, 2, "A")] == (20.0, 20.0, 0.0) and change[(2021, 1, "B")] == (10.0, 10.0, 0.0)
    changed = t.current()
    t.restore("before")
    assert files(t) == held and rows(t.read()) == rows(base.select(*t.read().columns))
    assert t.read(changed.number).where("vol_meas_water = 15").count() == 2  # still readable by number
    gone = t.vacuum()
    assert len(gone) == 1 and files(t) == held and rows(t.read_snapshot("before")) == rows(t.read())
    assert all(g not in f for g in gone for f in glob.glob(f"{tmp_path}/h/data/**", recursive=True))


def test_watermarks_follow_the_batches_and_need_no_readings(spark, first):
    p = CovariateParams()
    assert rows(first.watermarks()) == [(x, MAR) for x in "abcdefghij"]
    first.upsert(spark.createDataFrame([("a", JAN, 2.0), ("new", APR, 1.0)], SCHEMA))
    want = rows(first.read().groupBy("point").agg(F.max("period")))
    assert rows(first.watermarks()) == want and ("new", APR) in want and ("a", MAR) in want
    points = spark.createDataFrame([("a",), ("new",), ("unknown",)], "ibge_code string")
    starts = src_watermark(first.watermarks(), points, date(1995, 1, 1), p)
    assert rows(starts) == [("a", JAN), ("new", JAN), ("unknown", date(1995, 1, 1))]
    plan = starts._jdf.queryExecution().optimizedPlan().toString() + str(starts.inputFiles())
    assert "/state/" in plan and "/data/" not in plan
    assert rows(src_watermark(None, points, date(1995, 1, 1), p))[0] == ("a", date(1995, 1, 1))


def test_odd_batches(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.current() is None and t.read() is None and t.watermarks() is None
    t.upsert(spark.createDataFrame([], SCHEMA))
    assert t.read().count() == 0 and t.current().number == 1
    t.upsert(spark.createDataFrame([("a", None, 1.0), (None, JAN, 2.0), ("a", JAN, 5.0), ("a", JAN, 4.0)], SCHEMA))
    assert rows(t.read().where("point is not null and period is not null")) == [("a", JAN, 4.0)]
    t.upsert(spark.createDataFrame([("a", None, 3.0)], SCHEMA))
    assert {(r.point, r.period, r.value) for r in t.read().collect()} == {("a", None, 3.0), (None, JAN, 2.0), ("a", JAN, 4.0)}
    t.upsert(spark.createDataFrame([], SCHEMA))
    assert t.read().count() == 3 and t.current().number == 4


def test_partitions_are_dates_or_numbers(spark, tmp_path):
    t = PublishedTable(spark, f"{tmp_path}/x", "point", ["point"])
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([("a/b", JAN, 1.0)], SCHEMA))
