"""Exact removal of byte strings that repeat, by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else in the corpus is removed; strings never cross documents.

* Dealing out.  For each start of such a string, the 64-byte gram with the least
  hash inside the string is its anchor; equal strings have equal anchors.  The
  starts of a document with one anchor are a run, and the bytes they reach a
  segment, so every start belongs to one segment and equal strings meet under
  one anchor.  Anchors that occur once hold no repeat.
* Segments with equal bytes are sorted once, with their number: if it is two or
  more, all their starts repeat.  An anchor under which all segments are equal
  needs no more.
* The other segments are sorted by two-stage suffix sorting.  A suffix smaller
  than its successor is sorted directly; the rest are induced by scanning the
  buckets of first bytes in order, each suffix found placing its predecessor at
  the head of its bucket.  Only suffixes of starts, and what they are induced
  from, are sorted.  A start repeats if the common prefix with a neighbour
  among the starts in sorted order reaches ``length``.

A task sorts whole anchors, about a megabyte at a time.  An anchor with more
than ``group_limit`` different segments (a passage in very many documents, each
continued differently) is not gathered: its starts are dealt out by a 128-bit
hash of their strings and counted instead, with the same result.

Defined results: a null or empty text has no bytes and keeps none (the SHA-256
is that of no bytes).  Rows with the same doc_id and text are documents like
any others, so each repeats the other.  A missing doc_id is allowed.  Further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, map_arrow, partitions
from kpiloom.llm.words import EXACT, U64, mix, powers, prefix_sums, range_hash, slices, text_bytes
from kpiloom.staging import materialize

GRAM = 64
_SORTED_AT_ONCE = 1 << 20  # bytes
_OTHER = mix(EXACT)  # byte values of a second, independent hash


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from running minima of blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def cut(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of the texts: anchor, body (hash of the bytes), text, first and last start within the text."""
    gram = min(GRAM, length)
    if len(data) < length:
        return {}
    sums = prefix_sums(data)
    inverse = powers(len(sums))[1]
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    # the gram's place breaks ties, so that the leftmost of equal grams is the anchor
    keyed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    anchor = (window_least(keyed, length - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    starts = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[text + 1])
    if not len(starts):
        return {}
    opens = np.empty(len(starts), dtype=bool)
    opens[0] = True
    opens[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (text[starts[1:]] != text[starts[:-1]])
    at = np.flatnonzero(opens)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    return {
        "anchor": grams[anchor[first]].view(np.int64), "body": range_hash(sums, first, last + length).view(np.int64),
        "text": text[first], "first": first - offsets[text[first]], "last": last - offsets[text[first]],
    }


def segments(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, tie (hash of the text), anchor, body, first, last of every segment."""

    def run(batches):
        for rows, data, offsets in slices(batches):
            found = cut(data, offsets, length)
            if found:
                at = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), rows.column(2).take(at), *(pa.array(found[c]) for c in ("anchor", "body")), *(pa.array(found[c].astype(np.int32)) for c in ("first", "last"))],
                    names=["doc_id", "tie", "anchor", "body", "first", "last"],
                )

    rows = columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text")).where(F.octet_length("text") >= length)
    return map_arrow(rows, run, "doc_id long, tie long, anchor long, body long, first int, last int")


def sorted_suffixes(texts: list[bytes], wanted: list[int]) -> np.ndarray:
    """Places, in the texts laid end to end with a mark after each, of the wanted first suffixes of each, sorted.

    ``wanted[k]`` suffixes of text k are sorted among all; the mark after a text
    is smaller than any byte, and an earlier mark smaller than a later.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1  # places of the marks
    begins = ends - sizes
    symbols = np.zeros(ends[-1] + 1, dtype=np.int16)
    body = np.ones(len(symbols), dtype=bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int16) + 1
    # a run of one byte is smaller than its successors if what follows the run is greater
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    run = np.searchsorted(change, np.arange(len(symbols)))
    rises = np.append(symbols[change + 1] > symbols[change], False)
    smaller = rises[run]
    smaller[ends] = False
    # what is wanted, and after it all up to the first suffix that is sorted directly, or the mark
    stops = np.flatnonzero(smaller | ~body)
    needed = np.zeros(len(symbols) + 1, dtype=np.int8)
    reach = np.minimum(stops[np.searchsorted(stops, begins + np.array(wanted) - 1)], ends)
    np.add.at(needed, begins, 1)
    np.add.at(needed, reach + 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    # first stage: the smaller ones, directly
    flat = b"\0".join(texts)
    direct = np.flatnonzero(needed & smaller)
    stop = ends[np.searchsorted(ends, direct)]
    order = sorted(zip((flat[a:b] for a, b in zip(direct.tolist(), stop.tolist(), strict=True)), direct.tolist(), strict=True))
    direct = np.array([place for _, place in order], dtype=np.int64)
    # second stage: the rest, bucket by bucket
    induced = needed & ~smaller & body
    heads: list[list[np.ndarray]] = [[] for _ in range(257)]
    by_symbol = symbols[direct]
    edges = np.searchsorted(by_symbol, np.arange(258))
    result = []

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[(before >= 0) & induced[np.maximum(before, 0)]]
        if len(before):
            of = symbols[before]
            before = before[np.argsort(of, kind="stable")]
            of = symbols[before]
            at = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                heads[of[a]].append(before[a:b])

    induce(ends)
    for symbol in range(1, 257):
        k = 0
        while k < len(heads[symbol]):  # may grow while it is scanned
            result.append(heads[symbol][k])
            induce(heads[symbol][k])
            k += 1
        if edges[symbol + 1] > edges[symbol]:
            result.append(direct[edges[symbol] : edges[symbol + 1]])
            induce(result[-1])
    places = np.concatenate(result) if result else np.zeros(0, np.int64)
    text = np.searchsorted(ends, places)
    return places[places - begins[text] < np.array(wanted)[text]]


def repeated_starts(texts: list[bytes], wanted: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its wanted starts have a string of ``length`` bytes that starts elsewhere among them."""
    order = sorted_suffixes(texts, wanted)
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    alike = _common(data, order[:-1], order[1:], length)
    marked = np.zeros(len(data), dtype=bool)
    marked[order[:-1][alike]] = True
    marked[order[1:][alike]] = True
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return [np.flatnonzero(marked[b : b + n]) for b, n in zip(begins.tolist(), wanted, strict=True)]


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of the suffixes at a and b reaches ``length``; every one has that many bytes."""
    sums = prefix_sums(data)
    alike = range_hash(sums, a, a + length) == range_hash(sums, b, b + length)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    where = np.flatnonzero(alike)
    for k in range(0, len(where), 4096):
        part = where[k : k + 4096]
        alike[part] = (windows[a[part]] == windows[b[part]]).all(axis=1)
    return alike


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the ranges [start, end) cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[opens], ends[np.append(opens[1:], len(starts)) - 1]


_COVER = "anchor long, body long, a int, b int"


def _covers(anchors: list[int], bodies: list[int], starts: list[np.ndarray], length: int):
    rows = [(anchor, body, a, b) for anchor, body, s in zip(anchors, bodies, starts, strict=True) for a, b in zip(*(x.tolist() for x in _merged(s, s + length)), strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "body", "a", "b"])


def _by_sorting(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, body, a, b: covered ranges of the segments, from suffix arrays over whole anchors."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []  # whole anchors, and one that may go on
        size = 0

        def flush(rows):
            texts = [t for *_, t in rows]
            starts = repeated_starts(texts, [len(t) - length + 1 for t in texts], length)
            yield from _covers([a for a, *_ in rows], [b for _, b, _ in rows], starts, length)

        for batch in batches:
            for anchor, body, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size > _SORTED_AT_ONCE and held[-1][0] != anchor:
                    yield from flush(held)
                    held, size = [], 0
                held.append((anchor, body, data))
                size += len(data)
        if held:
            yield from flush(held)

    dealt = pieces.select("anchor", "body", "data").repartition(partitions(pieces.sparkSession), "anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, run, _COVER)


def _by_counting(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many different segments to be sorted in one place."""

    def run(batches):
        for rows, data, offsets in slices(batches, "data"):
            one, two = prefix_sums(data), prefix_sums(data, _OTHER)
            for k in range(rows.num_rows):
                starts = np.arange(offsets[k], offsets[k + 1] - length + 1)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range_hash(s, starts, starts + length).view(np.int64)) for s in (one, two)] + [pa.array(np.repeat(rows.column(i).to_numpy()[k], n)) for i in (0, 1)] + [pa.array((starts - offsets[k]).astype(np.int32))],
                    names=["one", "two", "anchor", "body", "a"],
                )

    each = map_arrow(pieces.select("anchor", "body", "data"), run, "one long, two long, anchor long, body long, a int")
    many = each.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    return each.join(many, ["one", "two"], "left_semi").select("anchor", "body", "a", (F.col("a") + length).alias("b"))


def _pieces(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of one segment of each body: anchor, body, bodies (under its anchor), data."""
    picks = chosen.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "body", "bodies", "first", "last")).alias("picks"))
    picks = picks.select(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie"), "picks")
    rows = columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.join(picks.hint("merge"), rows["doc_id"].eqNullSafe(picks["of"]) & (rows["tie"] == picks["of_tie"])).select("text", "picks")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                data, offsets = text_bytes(part.column(0))
                for k, picks in enumerate(part.column(1).to_pylist()):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    yield pa.RecordBatch.from_pydict({
                        "anchor": [p["anchor"] for p in picks], "body": [p["body"] for p in picks], "bodies": [p["bodies"] for p in picks],
                        "data": [text[p["first"] : p["last"] + length] for p in picks],
                    })

    return map_arrow(rows, run, "anchor long, body long, bodies long, data binary")


def covered(docs: DataFrame, length: int = 400, group_limit: int = 20_000) -> DataFrame:
    """doc_id, tie, a, b: byte ranges, perhaps overlapping, that repeated strings cover."""
    every = materialize(segments(docs, length), "segments")
    bodies = every.groupBy("anchor", "body").agg(F.count("*").alias("n"))
    anchors = bodies.groupBy("anchor").agg(F.count("*").alias("bodies"), F.sum("n").alias("n")).where("n > 1").select("anchor", "bodies")
    # joined as written tables: with an exchange on both sides, a very common anchor or body is split
    anchors = materialize(anchors, "anchors").hint("merge")
    shared = materialize(every.join(anchors, "anchor"), "shared")
    several = shared.where("bodies > 1")
    chosen = several.groupBy("anchor", "body", "bodies").agg(F.min(F.struct("doc_id", "tie", "first", "last")).alias("one"), F.count("*").alias("n"))
    chosen = chosen.select("anchor", "body", "bodies", "n", "one.*")
    pieces = materialize(_pieces(docs, chosen, length), "pieces")
    found = _by_sorting(pieces.where(F.col("bodies") <= group_limit), length)
    found = found.union(_by_counting(pieces.where(F.col("bodies") > group_limit), length))
    found = materialize(found, "covers").hint("merge")
    # segments of one body repeat each other, all of their starts
    twins = several.groupBy("anchor", "body").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "body")
    twins = materialize(twins, "twins").hint("merge")
    whole = shared.where("bodies = 1").select("doc_id", "tie", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    alike = several.join(twins, ["anchor", "body"]).select("doc_id", "tie", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    partly = several.join(found, ["anchor", "body"]).select("doc_id", "tie", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    return whole.union(alike).union(partly)


def without_repeats(docs: DataFrame, length: int = 400, group_limit: int = 20_000, with_data: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the kept bytes where asked for."""
    gone = materialize(covered(docs, length, group_limit).distinct().groupBy("doc_id", "tie").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "covered")
    gone = gone.select(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie"), "a", "b")
    rows = columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["of"]) & (rows["tie"] == gone["of_tie"]), "left").select("doc_id", "text", "a", "b")

    def run(batches):
        for part, data, offsets in slices(batches):
            a, b = (part.column(i).to_pylist() for i in (2, 3))
            counts, digests, kept = [], [], []
            for k in range(part.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                starts, ends = _merged(np.array(a[k] or [], dtype=np.int64), np.array(b[k] or [], dtype=np.int64))
                edges = np.concatenate([[0], np.column_stack([starts, ends]).ravel(), [len(text)]])
                left = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                counts.append((len(text), len(text) - len(left), len(starts)))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            out = [part.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_data, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_data])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_data
    return map_arrow(rows, run, schema)
