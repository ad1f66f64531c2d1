"""Connected components of a table of links, by large-star and small-star steps.

Every step is a map-side combined minimum per node and an equi-join, so a node
with very many links is split by adaptive execution and no group is gathered.
The steps end when the links form stars around the smallest node of each
component, after a number of rounds that grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.staging import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Links every node's larger neighbours to the smallest node around it."""
    pairs = _both_ways(links)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    larger = pairs.where("v > u")
    return _meet(larger, "u", least).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _meet(rows: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """``rows`` with the minimum ``m`` around their node.

    The join has a second key, implied by the first: without it the planner would
    join where the aggregate left its rows, and adaptive execution splits a common
    node only if an exchange feeds both sides.
    """
    keyed = least.withColumn("part", F.pmod("k", F.lit(16)))
    rows = rows.withColumn("rows_part", F.pmod(node, F.lit(16)))
    return rows.join(keyed, (rows[node] == keyed["k"]) & (rows["rows_part"] == keyed["part"]))


def _small_star(links: DataFrame) -> DataFrame:
    """Links every node and its smaller neighbours to the smallest of them; a > b on input."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = _meet(links, "a", least).select("a", "b", "m")
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being the smallest node reached.

    Links with a null end and loops are left out; repeated links do not matter.
    """
    state = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        step = _small_star(_large_star(state).where("a != b").distinct()).where("a != b").distinct()
        state = materialize(step, "links")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
