"""Mixing sources to target weights by entropy balancing, DataFrame functions only.

Each document gets a rate r, the copies it would ideally have.  Among all rates between 0 and ``cap`` that give every
source its target of words, the one nearest to r = 1 in relative entropy has the form ``min(cap, exp(l_s * z))`` with
z the document's size over its source's mean size and one multiplier l_s per source.  Newton iterations on the
convex dual find the multipliers: each is one distributed aggregation over the (source, size) classes, the state
is a stored table with a row per source, and only one number (sources not yet settled) comes to the driver.  A bracket
around each multiplier guards steps that would leave it.

Rates become copies by class: cumulative rounding from large sizes to small, then a few passes that fill or take back
what is missing with the largest documents that fit.  Inside a class a keyed hash of the id picks who gets the extra copy.

Defined results: null and empty texts have size 0, keep one copy and take no words; a null source is a source of its
own, last in order; repeated rows (same id, source and size) share their copies decision; an empty table gives an empty
table; all columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import of_row, packed, stored, unpacked, word_count

#: Relative miss of a source's words at which its multiplier counts as settled, and the most iterations.
TOLERANCE = 1e-9
ITERATIONS = 60
#: Documents of one class that are ranked together.
RANKED = 512
#: Passes that correct the rounding.
PASSES = 5


def _source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins null with null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(classes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Water filling: sources share ``share`` of all words by weight, none above ``cap`` times its own.

    The rows here are sources, not documents.  Sorted by cap/weight, the k smallest are full; the level is then what
    is left over the weights of the others.
    """
    every = Window.orderBy("mix_source")
    by_level = Window.orderBy("mix_level", "mix_source")
    s = classes.groupBy("mix_source").agg(F.sum(F.col("n") * F.col("mix_size")).alias("source_size"), F.sum("n").alias("source_docs"), F.min(F.when(F.col("mix_size") > 0, F.col("mix_size"))).alias("least"))
    place = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    s = s.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("mix_level", F.col("full") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source whose own level is above what it would get sets the level for itself and all after it
    s = s.withColumn("level", F.min(F.when(F.col("mix_level") > F.col("level"), F.struct("mix_level", "level"))).over(all_rows)["level"])
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("weight") * F.col("level")))
    return s.select("mix_source", "source_size", "source_docs", "least", target.alias("target"))


def multipliers(classes: DataFrame, sources: DataFrame, cap: float = 2.0) -> DataFrame:
    """One multiplier per source (null: every rate is ``cap``, or there are no words), by guarded Newton steps."""
    mean = F.col("source_size") / F.col("source_docs")
    z_least = F.col("least") / F.col("mean")
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    state = stored(
        sources.withColumn("mean", mean).withColumn("open", open_)
        .withColumn("lo", F.when(open_, F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / z_least)))
        .withColumn("hi", F.when(open_, F.greatest(F.lit(0.0), F.log(F.lit(cap)) / z_least)))
        .withColumn("multiplier", F.when(open_, F.lit(0.0))),
        "multipliers",
    )
    for _ in range(ITERATIONS):
        z = F.col("mix_size") / F.col("mean")
        rate = F.least(F.lit(cap), F.exp(F.col("multiplier") * z))
        words = F.col("n") * F.col("mix_size") * rate
        sums = (
            classes.join(state.filter("open").select("mix_source", "mean", "multiplier"), "mix_source")
            .groupBy("mix_source").agg(F.sum(words).alias("got"), F.sum(F.when(rate < cap, words * z).otherwise(0.0)).alias("slope"))
        )
        s = state.join(sums, "mix_source", "left")
        over = F.col("got") > F.col("target")
        lo, hi = F.when(F.col("open") & ~over, F.col("multiplier")).otherwise(F.col("lo")), F.when(F.col("open") & over, F.col("multiplier")).otherwise(F.col("hi"))
        settled = F.abs(F.col("got") / F.col("target") - 1) <= TOLERANCE
        step = F.col("multiplier") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        nxt = F.when((F.col("slope") > 0) & (step > F.col("new_lo")) & (step < F.col("new_hi")), step).otherwise((F.col("new_lo") + F.col("new_hi")) / 2)
        s = s.withColumn("new_lo", lo).withColumn("new_hi", hi)
        s = s.select(
            "mix_source", "source_size", "source_docs", "least", "target", "mean", (F.col("open") & ~settled).alias("open"),
            F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"),
            F.when(F.col("open") & ~settled, nxt).otherwise(F.col("multiplier")).alias("multiplier"),
        )
        state = stored(s, "multipliers")
        if state.filter("open").limit(1).count() == 0:
            break
    return state


def class_copies(classes: DataFrame, state: DataFrame, cap: int = 2) -> DataFrame:
    """Copies of each (source, size) class in all: cumulative rounding, then corrections by the largest that fit."""
    rate = F.when(F.col("mix_size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0))
    rate = rate.otherwise(F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("mix_size") / F.col("mean"))))
    down = Window.partitionBy("mix_source").orderBy(F.col("mix_size").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("mix_source")
    c = classes.join(state.select("mix_source", "source_size", "target", "mean", "multiplier"), "mix_source").withColumn("rate", rate)
    c = c.withColumn("upto", F.sum(F.when(F.col("mix_size") > 0, F.col("n") * F.col("rate")).otherwise(0.0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("copies", F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(down), F.lit(0.0)) + 0.5))
    c = c.withColumn("copies", F.when(F.col("mix_size") == 0, F.col("n")).otherwise(F.least(F.greatest(F.col("copies"), F.lit(0)), cap * F.col("n"))).cast("long"))
    for _ in range(PASSES):
        c = c.withColumn("miss", F.col("target") - F.sum(F.col("copies") * F.col("mix_size")).over(whole))
        room = F.when(F.col("miss") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("mix_size") > 0) & (F.col("mix_size") <= F.abs("miss"))
        c = c.withColumn("room", F.when(fits, room).otherwise(0))
        left = F.abs("miss") - F.coalesce(F.sum(F.col("room") * F.col("mix_size")).over(before), F.lit(0))
        moved = F.when(F.col("room") > 0, F.least(F.col("room"), F.greatest(F.floor(left / F.col("mix_size")), F.lit(0)))).otherwise(0)
        c = c.withColumn("copies", (F.col("copies") + F.signum("miss") * moved).cast("long"))
    return c.select("mix_source", "mix_size", "n", "rate", "copies", "source_size", "target")


def decisions(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``sized`` has mix_id, mix_source, mix_size; result: one row per distinct triple with mix_rate and mix_copies."""
    keys = stored(sized.groupBy("mix_id", "mix_source", "mix_size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    classes = stored(keys.groupBy("mix_source", "mix_size").agg(F.sum("rows").alias("n")), "classes")
    state = multipliers(classes, targets(classes, weights, share, float(cap)), float(cap))
    cls = stored(class_copies(classes, state, cap), "copies")
    order = F.xxhash64(F.col("mix_id"), F.lit("mix"))
    k = (
        keys.join(cls, ["mix_source", "mix_size"])
        .withColumn("base", F.floor(F.col("copies") / F.col("n"))).withColumn("extra", F.col("copies") % F.col("n"))
        .withColumn("order", order).withColumn("part", F.pmod(F.shiftright("order", 8), F.greatest(F.lit(1), F.floor(F.col("n") / RANKED))))
    )
    cell = ["mix_source", "mix_size", "part"]
    starts = k.groupBy(*cell).agg(F.sum("rows").alias("cell")).withColumn(
        "start", F.coalesce(F.sum("cell").over(Window.partitionBy("mix_source", "mix_size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = Window.partitionBy(*cell).orderBy("order", "mix_id").rowsBetween(Window.unboundedPreceding, -1)
    k = k.join(starts.drop("cell"), cell).withColumn("place", F.col("start") + F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    return k.select(
        "mix_id", "mix_source", "mix_size", "source_size", "target", F.col("rate").alias("mix_rate"),
        (F.col("base") + (F.col("place") < F.col("extra")).cast("long")).cast("long").alias("mix_copies"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return packed(docs).withColumns({"mix_id": of_row(id_col), "mix_source": _source_key(of_row(source_col).cast("string")), "mix_size": word_count(of_row(text_col))})


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnsRenamed({c: f"r_{c}" for c in ("mix_id", "mix_source", "mix_size")})
    on = F.col("mix_id").eqNullSafe(F.col("r_mix_id")) & (F.col("mix_source") == F.col("r_mix_source")) & (F.col("mix_size") == F.col("r_mix_size"))
    return left.join(r, on).drop("r_mix_id", "r_mix_source", "r_mix_size")


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, rate, copies."""
    sized = stored(_sized(docs, id_col, text_col, source_col).select("mix_id", "mix_source", "mix_size"), "sized")
    return _joined(sized, decisions(sized, **settings)).select(
        F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the columns it came with."""
    with_size = _sized(docs, id_col, text_col, source_col)
    sized = stored(with_size.select("mix_id", "mix_source", "mix_size"), "sized")
    wanted = decisions(sized, **settings).select("mix_id", "mix_source", "mix_size", "mix_copies").filter("mix_copies > 0")
    # texts travel by one kind of join at every size, so what a run shuffles grows with its input
    often = _joined(with_size, stored(wanted, "wanted").hint("merge")).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return unpacked(often, docs.columns)
