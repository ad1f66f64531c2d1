"""Exact Jaccard join of documents over word shingles, and its groups.

Method: size-banded tiles, hashed bitmap signatures, exact intersection.

* A document's shingles are sorted 64-bit hashes.  Sizes fall into bands of
  ratio 1.5; a document enters the tile of its band and of each higher band
  that a partner can be in.
* A tile of largest size r splits the hash space into more equal parts than two
  linked sets can differ in elements, ``(1-t)/(1+t) * 2r``.  So two linked sets
  agree on a whole part, and each document enters the tile once per part, keyed
  by the part's content.  Only documents with an equal key are compared.  Where
  too many parts of a document are empty for that argument, it also enters
  under its first ``n - ceil(t*n) + 1`` hashes, of which two linked sets share one.
* Documents with equal sets are one from here on; keys under which the same
  documents meet are one key.
* First, each document is compared with the smallest document under its keys;
  the exact links make groups.  Then, under every key that still holds several
  groups, documents of different groups meet in blocks, as bitmaps of a bit per
  hash (parity).  Differing bits are at most the differing elements, so their
  count bounds the overlap from above.
* Of the pairs that pass, a tile returns as many as connect its documents.  These
  are intersected exactly and merge groups.  All pairs that passed lie within the
  families that the returned ones connect; so in each family that still holds
  several groups, blocks of documents are intersected exactly, all against all, as
  products of incidence matrices.

No key's group and no family is gathered: the first comparison streams over sorted
rows, the others work in tiles of two blocks of bounded size.  No list of all
passing pairs is made.

Defined results: a null or empty text, or one without words, has no shingles
and no links.  A document without doc_id has no links and a null group.  Rows
that share a doc_id are one node: they are in one group, each with its own
size.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.components import components
from kpiloom.llm.tables import columns, map_arrow, partitions
from kpiloom.llm.words import U64, mix, shingles, slices, words
from kpiloom.staging import materialize

_BAND_RATIO = 1.5
_BLOCK = 512  # documents in a block of a tile
_BLOCK_SHINGLES = 1 << 19  # shingles in a block of an exact tile, but for a greater document
_COLUMNS = 4096  # shingles in a slice of an incidence matrix
_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] * _BAND_RATIO)))
EDGES = np.array(_EDGES, dtype=np.int64)

_cuts: dict[int, np.ndarray] = {}


def _parts(band: int, percent: int) -> tuple[int, int]:
    """(most elements in which linked sets of this tile differ, number of parts)."""
    largest = int(EDGES[band + 1]) - 1
    most = 2 * largest * (100 - percent) // (100 + percent)
    return most, most + 2 + most // 16


def _cut(parts: int) -> np.ndarray:
    if parts not in _cuts:
        if len(_cuts) > 256:
            _cuts.clear()
        _cuts[parts] = np.array([k * (1 << 64) // parts for k in range(1, parts)], dtype=U64)
    return _cuts[parts]


def keys(sorted_set: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set of hashes (sorted, distinct) meets all its partners."""
    size = len(sorted_set)
    if not size:
        return np.zeros(0, dtype=U64)
    sums = np.zeros(size + 1, dtype=U64)
    np.cumsum(mix(sorted_set + U64(0x51ED270B)), out=sums[1:])
    band = int(np.searchsorted(EDGES, size, side="right")) - 1
    found, weak = [], False
    while EDGES[band] * percent <= size * 100:
        most, parts = _parts(band, percent)
        at = np.concatenate([[0], np.searchsorted(sorted_set, _cut(parts)), [size]])
        full = np.flatnonzero(np.diff(at))
        weak |= len(full) <= most
        found.append(mix(sums[at[full + 1]] - sums[at[full]] + full.astype(U64) * U64(0x9FB21C651E98DF25) + U64(band * 0xD6E8FEB86659FD93 % (1 << 64))))
        band += 1
    if weak:
        first = size - (size * percent + 99) // 100 + 1
        found.append(mix(sorted_set[:first] ^ U64(0x2545F4914F6CDD1D)))
    return np.concatenate(found)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the hashes per bit; at least four bits for each, a power of two."""
    bits = 64
    while bits < 4 * len(hashes):
        bits *= 2
    return np.packbits(np.bincount((mix(hashes) & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], n: int, text: str = "text"):
    """(rows, list of sorted sets) for slices of the batches."""
    for rows, data, offsets in slices(batches, text):
        hashes, _, _, first = words(data, offsets)
        runs, at, _ = shingles(hashes, first, n, whole_short=True)
        yield rows, [np.unique(runs[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def profiles(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its bitmap."""

    def run(batches):
        for rows, sets in _sets(batches, n):
            one = [int(mix(s).sum(dtype=U64).astype(np.int64)) for s in sets]
            two = [int(mix(s ^ U64(0x94D049BB133111EB)).sum(dtype=U64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "one", "two", "bits"],
            )

    return map_arrow(columns(docs, "doc_id", "text"), run, "doc_id long, n_shingles long, one long, two long, bits binary")


def _keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    def run(batches):
        for rows, sets in _sets(batches, n):
            found = [keys(s, percent) for s in sets]
            sizes = [len(k) for k in found]
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, sizes).astype(np.int64))], names=["key", "doc_id"])

    return map_arrow(columns(docs, "doc_id", "text").where("doc_id is not null"), run, "key long, doc_id long")


def _meetings(keyed: DataFrame) -> DataFrame:
    """(key, hub, doc_id) for each document under a key but the smallest, the hub.

    Streams over rows sorted by key; only the key and hub in hand are kept.
    """

    def run(batches):
        key, hub, last = None, None, None
        for batch in batches:
            k, d = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(k):
                continue
            opens = np.empty(len(k), dtype=bool)
            opens[0], opens[1:] = key is None or k[0] != key, k[1:] != k[:-1]
            again = np.empty(len(k), dtype=bool)
            again[0], again[1:] = not opens[0] and d[0] == last, (d[1:] == d[:-1]) & ~opens[1:]
            at = np.maximum.accumulate(np.where(opens, np.arange(len(k)), -1))
            hubs = np.where(at >= 0, d[np.maximum(at, 0)], d[0] if hub is None else hub)
            key, hub, last = k[-1], hubs[-1], d[-1]
            keep = ~opens & ~again
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(hubs[keep]), pa.array(d[keep])], names=["key", "hub", "doc_id"])

    spread = keyed.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key", "doc_id")
    return map_arrow(spread, run, "key long, hub long, doc_id long")


def _similar(pairs: DataFrame, profile: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), by sizes, then equal sets, then intersection of the sorted sets."""
    facts = profile.select("doc_id", "n_shingles", "one", "two")
    sized = (
        pairs.join(facts.toDF("a", "na", "one_a", "two_a"), "a").join(facts.toDF("b", "nb", "one_b", "two_b"), "b")
        .where(f"na > 0 and nb > 0 and least(na, nb) * 100 >= greatest(na, nb) * {percent}")
        .withColumn("equal", F.expr("na = nb and one_a = one_b and two_a = two_b"))
        .select("a", "b", "equal")
    )
    sized = materialize(sized, "pairs")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                left = [s for _, sets in _sets([part], n, "text_a") for s in sets]
                right = [s for _, sets in _sets([part], n, "text_b") for s in sets]
                keep = []
                for x, y in zip(left, right, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    unequal = sized.where("not equal").select("a", "b")
    both = unequal.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return sized.where("equal").select("a", "b").union(map_arrow(both, run, "a long, b long"))


def _distinct_keys(meetings: DataFrame) -> DataFrame:
    """The meetings under one key of those under which the same documents meet."""
    held = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)"))
    each = meetings.groupBy("key").agg(F.min("hub").alias("hub"), F.count("*").alias("n"), held.alias("held"))
    chosen = materialize(each.groupBy("hub", "n", "held").agg(F.min("key").alias("key")).select("key"), "keys")
    return meetings.join(chosen, "key", "left_semi").select("key", "hub", "doc_id")


def _tiles(rows: DataFrame, unit: str, run: Callable, schema: str, *carried: str) -> DataFrame:
    """``run`` over (tile, block, ...) tables: every two of the ``blocks`` of documents of a unit are a tile."""
    rows = rows.withColumn("block", F.expr("int(pmod(xxhash64(doc_id), blocks))"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = rows.select(F.col(unit).alias("unit"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", *carried)

    def stream(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # a tile is bounded, so the rows of the last tile in hand are kept for the next batch
            table = pa.Table.from_batches([*held, batch])
            tile = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("unit", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from run(table.slice(a, b - a))
            held = table.slice(starts[-1]).to_batches()
        if held:
            yield from run(pa.Table.from_batches(held))

    spread = tiles.repartition(partitions(tiles.sparkSession), "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return map_arrow(spread, stream, schema)


def _connecting(meetings: DataFrame, groups: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that sizes and bitmaps admit, as many as connect all such pairs under each key."""
    members = meetings.select("key", "doc_id").union(meetings.select("key", F.col("hub").alias("doc_id")).distinct())
    named = members.join(groups.toDF("doc_id", "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    named = materialize(named, "members")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high").select("key", "size")
    # a key that very many documents have is split: the join reads a written table on both sides
    rows = named.join(materialize(mixed, "mixed"), "key").withColumn("blocks", F.expr(f"int((size + {_BLOCK - 1}) / {_BLOCK})"))
    rows = rows.join(profile.where("bits is not null").select("doc_id", "n_shingles", "bits"), "doc_id")
    return _tiles(rows, "key", lambda tile: _tile(tile, percent), "a long, b long", "component", "n_shingles", "bits").distinct()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class _Union:
    """Groups that grow together."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _ordered(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        pairs = np.array(found, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])


def _tile(tile: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    ids, groups, sizes, block = (tile.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "block"))
    if len(ids) < 2 or (groups == groups[0]).all():
        return
    maps = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in tile.column("bits")]
    # in order of the size of the maps, each is folded to that of the smaller one of a pair
    order = np.argsort([len(m) for m in maps], kind="stable")
    ids, groups, sizes, block, maps = ids[order], groups[order], sizes[order], block[order], [maps[k] for k in order]
    diagonal = bool((block == block[0]).all())
    union, found, bits, width = _Union(), [], None, 0
    for x in range(len(ids) - 1):
        if len(maps[x]) != width:
            width = len(maps[x])
            bits = np.stack([_folded(m, width) for m in maps[x:]])
            first = x
        other = np.arange(x + 1, len(ids))
        other = other[(groups[other] != groups[x]) & (diagonal | (block[other] != block[x]))]
        other = other[np.minimum(sizes[other], sizes[x]) * 100 >= np.maximum(sizes[other], sizes[x]) * percent]
        if not len(other):
            continue
        apart = np.bitwise_count(bits[other - first].view(np.uint64) ^ bits[x - first].view(np.uint64)).sum(axis=1, dtype=np.int64)
        total = sizes[other] + sizes[x]
        most = (total - apart) // 2  # of shared elements
        for y in other[100 * most >= percent * (total - most)].tolist():
            if union.join(int(groups[x]), int(groups[y])):
                found.append((int(ids[x]), int(ids[y])))
    yield from _ordered(found)


def _exact_tile(tile: pa.Table, n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Exact links between different groups of a tile, as many as connect them."""
    ids, groups, block = (tile.column(c).to_numpy() for c in ("doc_id", "component", "block"))
    sets = [s for _, found in _sets(tile.select(["doc_id", "text"]).to_batches(), n) for s in found]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # a shingle of one document is shared with none
    several = times > 1
    column, row = (np.cumsum(several) - 1)[column[several[column]]], row[several[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    # the documents of a diagonal tile meet each other, else those of one block meet the other's
    left = np.flatnonzero(block == block[0])
    diagonal = len(left) == len(ids)
    right = left if diagonal else np.flatnonzero(block != block[0])
    shared = np.zeros((len(left), len(right)), dtype=np.float32)  # whole numbers, exact below 2**24
    edges = np.searchsorted(column, np.arange(0, int(several.sum()) + _COLUMNS, _COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((len(ids), _COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - k * _COLUMNS] = 1
        shared += part[left] @ part[right].T
    linked = (shared > 0) & (100 * shared.astype(np.int64) >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared.astype(np.int64)))
    linked &= groups[left][:, None] != groups[right][None, :]
    union, found = _Union(), []
    for x, y in np.argwhere(linked).tolist():
        if union.join(int(groups[left[x]]), int(groups[right[y]])):
            found.append((int(ids[left[x]]), int(ids[right[y]])))
    yield from _ordered(found)


def _within(families: DataFrame, groups: DataFrame, profile: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links between the groups that each family still holds."""
    sizes = profile.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    named = families.toDF("doc_id", "family").join(groups.toDF("doc_id", "component"), "doc_id", "left").join(sizes, "doc_id")
    named = materialize(named.select("doc_id", "family", F.coalesce("component", "doc_id").alias("component"), "n_shingles"), "families")
    mixed = named.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.expr(f"int((size + {_BLOCK - 1}) / {_BLOCK})"), F.expr(f"int((shingles + {_BLOCK_SHINGLES - 1}) / {_BLOCK_SHINGLES})")).alias("blocks")
    mixed = materialize(mixed.where("low != high").select("family", blocks), "mixed")
    rows = named.join(mixed, "family").join(texts, "doc_id")
    return _tiles(rows, "family", lambda tile: _exact_tile(tile, n, percent), "a long, b long", "component", "text").distinct()


def links(docs: DataFrame, profile: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Links (a, b) between doc_ids whose closure is that of all exact links."""
    same = ["n_shingles", "one", "two"]
    sets = profile.where("doc_id is not null and n_shingles > 0").select("doc_id", *same)
    least = materialize(sets.groupBy(*same).agg(F.min("doc_id").alias("least")), "sets")
    # the second key, implied by the first, lets a set that very many documents have be split
    part = F.pmod("one", F.lit(16)).alias("part")
    equal = sets.select("*", part).join(least.select("*", part), [*same, "part"]).where("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    equal = materialize(equal, "equal")
    own = least.select(F.col("least").alias("own")).distinct()
    distinct = columns(docs, "doc_id", "text").join(own, F.col("doc_id") == F.col("own"), "left_semi")
    meetings = materialize(_meetings(_keyed(distinct, n, percent)), "meetings")
    meetings = materialize(_distinct_keys(meetings), "distinct-meetings")
    met = meetings.select("doc_id").union(meetings.select("hub")).distinct().withColumnRenamed("doc_id", "met")
    texts = columns(docs, "doc_id", "text")
    texts = materialize(texts.join(met, texts["doc_id"] == met["met"], "left_semi"), "texts")
    near = meetings.groupBy("doc_id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    first = materialize(_similar(near, profile, texts, n, percent), "links")
    groups = materialize(components(first), "groups")
    maybe = materialize(_connecting(meetings, groups, profile, percent), "maybe")
    second = materialize(_similar(maybe, profile, texts, n, percent), "links")
    groups = materialize(components(first.union(second)), "groups")
    families = components(first.union(maybe))
    third = _within(families, groups, profile, texts, n, percent)
    return equal.union(first).union(second).union(third)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * shared >= percent * united shingles of ``n``
    words; component_id is the smallest doc_id reachable by links.
    """
    profile = materialize(profiles(docs, n), "profiles")
    groups = components(links(docs, profile, n, percent))
    facts = profile.select("doc_id", "n_shingles")
    return facts.join(groups.toDF("doc_id", "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose group holds a smaller doc_id; all columns stay."""
    gone = near_groups(docs, n, percent).where("component_id != doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
