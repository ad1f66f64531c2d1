"""Mixing sources to target weights by nested hash thresholds, without a sort.

Every document has a fixed 60-bit hash of its doc_id and text.  A source takes
all its documents as often as its target holds its whole size, and of the rest
those under a hash threshold.  The threshold is found by histograms: the sizes
summed by source and the first 12 bits of the hash give the bucket in which the
remaining target ends; only that bucket is summed by the next 12 bits, and so
on to all 60.  The last boundary group goes in if that brings the source nearer
to its target.  A larger budget keeps what a smaller one took.

Defined results: size is the number of words, 0 for a null text.  A null source
is a source of its own, last in order.  Rows equal in doc_id and text share
their hash and are taken together.  An empty table gives no rows.  Further
columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.tables import fresh
from kpiloom.staging import materialize

WORD = r"[^\x20\x09-\x0D]+"
_BITS, _LEVELS = 12, 5


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources in order of code points, null last, have the weights in turn and
    share ``percent`` % of all sizes; no target exceeds ``most`` times its
    source, and what is over goes to the others by weight.  Sorted by the level
    at which each stops, the stopped ones are a prefix: running sums find it.
    The windows are over sources, not documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    unit = lcm(*weights)
    row = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    row = row.withColumn("stop", F.col("cap") * F.expr(f"{unit} div weight"))
    level, every = Window.orderBy("stop", "rank"), Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    row = (
        row.withColumn("budget", F.sum("source_size").over(every) * percent / 100.0)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stopped", F.col("stop") * F.col("weights") <= F.col("left") * unit)
        .withColumn("open_budget", F.col("budget") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("open_weights", F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every))
    )
    share = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("open_budget") / F.col("open_weights"))
    return row.select("source", "source_size", share.cast("double").alias("target"))


def thresholds(facts: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """Per source: source_size, target, passes over all its documents, and the hash below which one more copy is taken.

    ``facts`` has source, size, hash.
    """
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(materialize(sizes, "sources"), weights, percent, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = materialize(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("last", F.lit(0).cast("long")), "targets")
    for depth in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - depth)
        at = state.select(F.col("source").alias("of"), F.col("prefix"))
        inside = facts.join(at, facts["source"].eqNullSafe(at["of"]) & (F.shiftright(facts["hash"], shift + _BITS) == at["prefix"]))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("held"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("held").over(running)).withColumnRenamed("source", "of")
        ends = sums.join(state, sums["of"].eqNullSafe(state["source"])).where("upto > rest")
        # the first bucket that goes over; with none, all of this bucket is taken
        ends = ends.groupBy("of").agg(F.min(F.struct("bucket", "upto", "held")).alias("end"))
        over = state.join(ends, state["source"].eqNullSafe(ends["of"]), "left")
        none = F.col("end").isNull()
        state = materialize(
            over.select(
                "source", "source_size", "target", "passes",
                F.when(none, F.col("rest")).otherwise(F.col("rest") - (F.col("end.upto") - F.col("end.held"))).alias("rest"),
                F.when(none, F.shiftleft("prefix", _BITS) + (1 << _BITS) - 1).otherwise(F.col("end.bucket")).alias("prefix"),
                F.when(none, F.lit(0)).otherwise(F.col("end.held")).cast("long").alias("last"),
            ),
            "boundary",
        )
    # 60 bits known: the boundary group has one hash; take it if that is nearer
    nearer = (F.col("last") > 0) & (F.col("last") - F.col("rest") < F.col("rest"))
    return state.select("source", "source_size", "target", "passes", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))


def _facts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("hash"))


_COPIES = "passes + if(hash < below, 1, 0)"


def mix(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken words of every document."""
    facts = materialize(_facts(docs), "sizes")
    limits = thresholds(facts, **rule).withColumnRenamed("source", "of")
    rows = facts.join(limits, facts["source"].eqNullSafe(limits["of"]))
    return rows.withColumn("copies", F.expr(_COPIES)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **rule) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay."""
    facts = materialize(_facts(docs).drop("doc_id"), "sizes")
    of, passes, below, place = (fresh(docs, name) for name in ("of", "passes", "below", "place"))
    limits = thresholds(facts, **rule).select(F.col("source").alias(of), F.col("passes").alias(passes), F.col("below").alias(below))
    rows = docs.withColumn(place, _hash(docs["doc_id"], docs["text"])).join(limits, docs["source"].cast("string").eqNullSafe(limits[of]))
    copies = (F.col(passes) + F.when(F.col(place) < F.col(below), 1).otherwise(0)).cast("int")
    return rows.withColumn(place, F.explode(F.array_repeat(F.lit(1), copies))).select(*(docs[c] for c in docs.columns))
