"""Merkle fingerprints of documents, in DataFrame functions alone.

The tree of a text: its lines are the paragraphs; a section is a run of
paragraphs that ends after one whose hash begins with 0 or 1 (one in eight), so
an inserted paragraph changes its own section and not the cut of all others.
The leaves are runs of up to four words with the white space after them, and
together they are the paragraph.  A leaf's node is the SHA-256 of its text, a
paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes,
the root that of its sections' nodes.  The root is the fingerprint: equal texts
have equal roots.

Where roots differ, ``likeness`` is the share of equal nodes of all levels, the
root among them, so it is 1 only for equal roots; an equal branch counts with all
that is below it.  ``first_difference`` descends: to the first section that
differs, and within it to the first paragraph.

``with_next`` gives each row the text of the next by doc_id, the last that of
the first.  Rows are dealt by ranges of doc_id with one copied row at each
border, so no order over the whole table is needed.

Defined results: a null text is empty; an empty text has one empty paragraph
without leaves.  A missing doc_id comes first; rows of one doc_id follow each
other in the order of a text hash; a single row is its own next.  An empty
table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, partitions
from kpiloom.staging import materialize

#: A leaf: up to four words and the white space after them; a word that ends a sentence
#: ends it.  White space that a line begins with is a leaf of its own.
LEAF = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09]+){0,3}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"


def leaves(text: Column) -> Column:
    """Nodes of the leaves of every paragraph, an array for each."""
    each = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n", -1), each)


def paragraphs(leaf_nodes: Column) -> Column:
    return F.transform(leaf_nodes, lambda nodes: F.sha2(F.array_join(nodes, ""), 256))


def sections(nodes: Column) -> Column:
    """(node, size) of the sections over the paragraphs' nodes, size being their number of paragraphs."""
    marked = F.regexp_replace(F.concat(F.lit("<"), F.array_join(nodes, "><"), F.lit(">")), "(<[01][0-9a-f]*>)", "$1|")
    cut = F.split(F.regexp_replace(marked, r"\|$", ""), r"\|", -1)
    # a paragraph's node and its brackets are 66 characters
    return F.transform(cut, lambda s: F.struct(F.sha2(s, 256).alias("node"), (F.length(s) / 66).cast("int").alias("size")))


def root(section_nodes: Column) -> Column:
    return F.sha2(F.array_join(section_nodes, ""), 256)


def nodes(leaf_nodes: Column, paragraph_nodes: Column, section_nodes: Column) -> Column:
    """The distinct nodes of all levels below the root, as 64-bit hashes."""
    every = F.concat(section_nodes, paragraph_nodes, F.flatten(leaf_nodes))
    return F.array_distinct(F.transform(every, lambda x: F.xxhash64(x)))


def likeness(nodes_a: Column, root_a: Column, nodes_b: Column, root_b: Column) -> Column:
    same = F.size(F.array_intersect(nodes_a, nodes_b)) + F.when(root_a == root_b, 1).otherwise(0)
    return (same * 2).cast("double") / (F.size(nodes_a) + F.size(nodes_b) + 2)


def _first_unequal(a: Column, b: Column) -> Column:
    """Place, from 1, of the first elements that differ; 0 if none do."""
    return F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")


def first_difference(sections_a: Column, paragraphs_a: Column, sections_b: Column, paragraphs_b: Column) -> Column:
    """Number, from 1, of the first paragraph whose branch differs; 0 if none does."""
    place = _first_unequal(sections_a["node"], sections_b["node"])
    before = F.aggregate(F.slice(sections_a["size"], F.lit(1), F.greatest(place - 1, F.lit(0))), F.lit(0), lambda total, size: total + size)
    size = F.greatest(*(F.coalesce(F.get(s["size"], place - 1), F.lit(0)) for s in (sections_a, sections_b)))
    branch = lambda nodes_: F.slice(nodes_, before + 1, size)
    return F.when(place == 0, F.lit(0)).otherwise(before + _first_unequal(branch(paragraphs_a), branch(paragraphs_b))).cast("long")


def _tree(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``rows`` with the leaves, paragraphs, sections, fingerprint and nodes of a text."""
    named = lambda name: F.col(f"{prefix}{name}")
    rows = rows.withColumn(f"{prefix}leaves", leaves(F.col(text)))
    rows = rows.withColumn(f"{prefix}paragraphs", paragraphs(named("leaves")))
    rows = rows.withColumn(f"{prefix}sections", sections(named("paragraphs")))
    rows = rows.withColumn(f"{prefix}fingerprint", root(named("sections")["node"]))
    return rows.withColumn(f"{prefix}nodes", nodes(named("leaves"), named("paragraphs"), named("sections")["node"]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, sections, paragraphs, leaves, nodes: the tree of every text."""
    rows = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return _tree(rows, "text").select("doc_id", "fingerprint", "sections", "paragraphs", "leaves", "nodes")


def _range_of(value: Column, edges: list[int]) -> Column:
    """How many edges are below the value, looked up in two steps."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    blocks = [edges[k : k + step] for k in range(0, len(edges), step)]
    numbers = lambda values: F.array(*(F.lit(v).cast("bigint") for v in values))
    block = F.size(F.filter(numbers([b[-1] for b in blocks]), lambda e: e < value))
    inside = F.coalesce(F.get(F.array(*map(numbers, blocks)), block), F.array().cast("array<bigint>"))
    return block * step + F.size(F.filter(inside, lambda e: e < value))


def with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """doc_id, text, next_text of every row; texts are not null."""
    rows = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    count = partitions(docs.sparkSession) * per_partition
    shares = [k / count for k in range(1, count)]
    edges = rows.agg(F.percentile_approx("doc_id", shares, 20 * count)).first()[0] if shares else None
    rows = rows.withColumn("range", _range_of(F.col("doc_id"), sorted(set(edges or []))))
    # the first row of a range follows the last row of the range before: one row per range
    heads = rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    around = Window.orderBy("range")
    last = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("range").over(around), F.max("range").over(last)).alias("before"))
    heads = materialize(heads, "heads").select(F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"), "before")
    rows = rows.join(heads, rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["tie"] == heads["head_tie"]), "left")
    own = F.struct(F.col("range"), F.lit(0).alias("copied"))
    copy = F.struct(F.col("before").alias("range"), F.lit(1).alias("copied"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    dealt = rows.select("doc_id", "tie", "text", F.explode(places).alias("at")).select("doc_id", "tie", "text", "at.range", "at.copied")
    return dealt.repartition(partitions(docs.sparkSession), "range")


def fingerprints_with_edit(docs: DataFrame) -> DataFrame:
    """Trees of every text and of its edited text, whose last quarter is the start of the next document."""
    rows = _tree(with_next(docs), "text")
    order = Window.partitionBy("range").orderBy("copied", F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.select(
        "doc_id", "text", "copied", "paragraphs", "sections", "fingerprint", "nodes",
        *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "nodes", "fingerprint")),
    ).where("copied = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("cast(n_chars div 4 as int)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), substring(next_text, 1, cut))"))
    rows = _tree(rows, "edited", "edited_")
    like = lambda other: likeness(F.col("nodes"), F.col("fingerprint"), F.col(f"{other}_nodes"), F.col(f"{other}_fingerprint"))
    changed = first_difference(F.col("sections"), F.col("paragraphs"), F.col("edited_sections"), F.col("edited_paragraphs"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        like("edited").alias("near_edited"), like("next").alias("near_next"),
        F.size("sections").alias("n_sections"), F.size("paragraphs").alias("n_paragraphs"), changed.alias("first_change"),
    )
