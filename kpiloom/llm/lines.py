"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

Every run of three consecutive lines is hashed (128 bits).  A run that occurs
again, anywhere in the corpus, stays where it comes first by doc_id and
position; the lines that later occurrences cover, merged where they overlap,
go.  Runs are judged on the input, not on what is left.

Only (hash, document, position) is shuffled for the search, combined per task
to the first occurrence of each hash; the occurrences then meet the repeated
hashes in an equi-join, which adaptive execution splits where one run is very
common.  What is gathered per document is at most its own positions.

Defined results: a text is cut at line feeds; one of fewer than three lines,
an empty or a null one keeps all its lines (a null text counts as one empty
line).  A missing doc_id comes first.  Rows with the same doc_id and text are
one document listed more than once and get the same result each; rows of one
doc_id with other texts follow in the order of a text hash.  An empty table
gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns
from kpiloom.staging import materialize

RUN = 3


def _keyed(docs: DataFrame) -> DataFrame:
    rows = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("tie", F.xxhash64("text"))


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, tie, place (of its first line, from 0), hash of every run of three lines."""
    rows = _keyed(docs).withColumn("lines", F.split("text", "\n", -1)).where(F.size("lines") >= RUN)
    # a hash per line, then one over three of them; zipped, as indexing in a lambda
    # would compute the whole array again for each element
    hashes = F.transform("lines", lambda x: F.md5(x.cast("binary")))
    for k in range(1, RUN):
        later = F.transform(F.slice("lines", k + 1, F.size("lines") - k), lambda x: F.md5(x.cast("binary")))
        hashes = F.zip_with(hashes, later, lambda a, b: F.concat(a, b))
    run = F.transform(F.slice(hashes, 1, F.size("lines") - RUN + 1), lambda x: F.unhex(F.md5(x.cast("binary"))))
    return rows.select("doc_id", "tie", F.posexplode(run).alias("place", "hash"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, tie, places: the places of later occurrences of runs in each document."""
    found = runs(docs)
    first = found.groupBy("hash").agg(F.min(F.struct("doc_id", "tie", "place")).alias("first"), F.max(F.struct("doc_id", "tie", "place")).alias("last"))
    # the second key, implied by the first, keeps the planner from joining where the aggregate
    # left its rows: with an exchange on both sides, a very common run is split
    lead = F.substring("hash", 1, 1)
    first = first.where("not first <=> last").select(F.col("hash").alias("of"), "first", lead.alias("of_lead"))
    found = found.withColumn("lead", lead)
    later = found.join(first.hint("merge"), (found["hash"] == first["of"]) & (found["lead"] == first["of_lead"])).where(~F.struct("doc_id", "tie", "place").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("places"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (the lines kept, joined) of every document."""
    # cut before the join: what a lambda indexes must be a column, not an expression
    rows = _keyed(docs).select("doc_id", "tie", F.split("text", "\n", -1).alias("lines"))
    gone = materialize(repeats(docs), "repeats").select(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie"), "places")
    # shuffled whatever the size, so that the plan is the same on any corpus
    rows = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["of"]) & (rows["tie"] == gone["of_tie"]), "left")
    covered = F.expr(f"array_distinct(flatten(transform(places, p -> sequence(p, p + {RUN - 1}))))")
    rows = rows.withColumn("gone", F.when(F.col("places").isNotNull(), covered))
    left = F.expr("transform(array_sort(array_except(sequence(0, size(lines) - 1), gone)), i -> lines[i])")
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left), "\n").alias("text"),
    )
