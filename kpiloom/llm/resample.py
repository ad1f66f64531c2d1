"""Importance resampling of documents towards a target distribution, over hashed features.

Features are all runs of one and of two consecutive words; a feature's bucket is
the CRC-32 of its bytes modulo the number of buckets.  A document's weight is the
mean of the gains of its features' buckets (how much likelier the target's
features fall there than the corpus').  Documents are drawn by the greatest
weight plus Gumbel noise, a fixed function of doc_id.

Head-tail vocabulary:

* Head: words are counted over all documents, pairs of head words likewise, and
  the most frequent of each (``HEAD_WORDS``, ``HEAD_PAIRS`` at most, of bounded
  length, so the broadcast has a fixed bound) are sent to every task: words with
  the exact CRC state after their bytes, pairs with their bucket.
* Tail: any other word takes the CRC of its bytes, any other pair goes on from the
  state of its first word.  So the head decides the cost, never a result.
* Both feed the exact totals of every bucket, summed per task before the shuffle.

The buckets of a document are computed once and written, two bytes a feature.
Ranks come from a range partitioning by score, with the sizes of the partitions
before as bases, so no task sorts more than one partition.

Defined results: a null or empty text, or one without words, has no features and
weight 0.  A missing doc_id counts as an empty one in the noise, and comes first
among ties.  Rows that share a doc_id are drawn separately.  Without target texts
all features of the target count 0.  An empty table gives no rows.  Further columns
are ignored by ``ranked`` and kept by ``drawn``.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, fresh, map_arrow, partitions
from kpiloom.llm.words import runs, slices, strings, text_bytes
from kpiloom.staging import materialize

HEAD_WORDS = 65_536
HEAD_PAIRS = 131_072
HEAD_BYTES = 64  # a longer word is never in the head
_CLASSES = 16  # of counts in each doubling, when the most frequent are looked for

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x80:] = True
for _first, _last in ("09", "az", "AZ"):
    _IN_WORD[ord(_first) : ord(_last) + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Head(NamedTuple):
    words: pa.Array  # binary
    states: np.ndarray  # CRC-32 after each word
    pairs: np.ndarray  # sorted codes, first * HEAD_WORDS + second
    buckets: np.ndarray  # of the pairs


NO_HEAD = Head(pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _words(batches):
    """(rows, distinct words, number of each word in turn, first word of each text) of slices."""
    for rows, data, offsets in slices(batches):
        start, end, first = runs(_IN_WORD[data], offsets)
        coded = strings(_LOWER[data], start, end).dictionary_encode()
        yield rows, coded.dictionary, coded.indices.to_numpy(), first


def _joined(count: int, first: np.ndarray) -> np.ndarray:
    """Which words have a successor in their text."""
    has = np.ones(count, dtype=bool)
    has[first[1:][np.diff(first) > 0] - 1] = False
    return has


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the greatest ``n``, whole classes of counts at a time, ``most`` at most."""
    counts = materialize(counts.withColumn("class", F.floor(_CLASSES * F.log2("n"))), "counts")
    sizes = counts.groupBy("class").count().orderBy(F.desc("class")).collect()  # 64 doublings at most
    least, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["class"]
    return counts.where(F.col("class") >= least) if least is not None else counts.where("false")


def _frequent_words(docs: DataFrame) -> list[bytes]:
    def run(batches):
        for _, distinct, place, _ in _words(batches):
            short = pc.less_equal(pc.binary_length(distinct), HEAD_BYTES)
            counts = pa.array(np.bincount(place, minlength=len(distinct)))
            yield pa.RecordBatch.from_arrays([distinct.filter(short).cast(pa.binary()), counts.filter(short)], names=["word", "n"])

    counts = map_arrow(docs, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(bytes(row["word"]) for row in _most_frequent(counts, HEAD_WORDS).select("word").collect())


def _frequent_pairs(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Codes of the most frequent pairs of head words, among those that recur in some slice of text."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        head = pa.array(known.value, pa.large_binary())
        for _, distinct, place, first in _words(batches):
            number = pc.index_in(distinct, head).fill_null(-1).to_numpy().astype(np.int64)[place]
            left, right = number[:-1], number[1:]
            both = _joined(len(number), first)[:-1] & (left >= 0) & (right >= 0)
            code, n = np.unique(left[both] * HEAD_WORDS + right[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code[n > 1]), pa.array(n[n > 1])], names=["code", "n"])

    counts = map_arrow(docs, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return np.sort(np.array([row["code"] for row in _most_frequent(counts, HEAD_PAIRS).select("code").collect()], dtype=np.int64))


def head(docs: DataFrame, buckets: int) -> Head:
    """CRC states of the frequent words and buckets of the frequent pairs of the documents."""
    words = _frequent_words(docs)
    states = [zlib.crc32(w) for w in words]
    pairs = _frequent_pairs(docs, words)
    of_pairs = [zlib.crc32(b" " + words[b], states[a]) % buckets for a, b in zip((pairs // HEAD_WORDS).tolist(), (pairs % HEAD_WORDS).tolist(), strict=True)]
    return Head(pa.array(words, pa.large_binary()), np.array(states, dtype=np.int64), pairs, np.array(of_pairs, dtype=np.int64))


def feature_buckets(distinct: pa.Array, place: np.ndarray, first: np.ndarray, known: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features, text after text; first feature of each text)."""
    number = pc.index_in(distinct, known.words).fill_null(-1).to_numpy().astype(np.int64)
    state = known.states[number] if len(known.states) else np.zeros(len(number), np.int64)
    tail = np.flatnonzero(number < 0)
    texts = distinct.to_pylist()
    state[tail] = [zlib.crc32(texts[k]) for k in tail.tolist()]
    out = np.zeros((len(place), 2), dtype=np.int64)
    out[:, 0] = (state % buckets)[place]
    has = _joined(len(place), first)
    at = np.flatnonzero(has)
    # each pair of the slice once
    code, back = np.unique(place[at].astype(np.int64) * len(distinct) + place[at + 1], return_inverse=True)
    left, right = code // max(len(distinct), 1), code % max(len(distinct), 1)
    of_pair = np.full(len(code), -1, dtype=np.int64)
    if len(known.pairs):
        frequent = np.where((number[left] >= 0) & (number[right] >= 0), number[left] * HEAD_WORDS + number[right], -1)
        near = np.minimum(np.searchsorted(known.pairs, frequent), len(known.pairs) - 1)
        hit = known.pairs[near] == frequent
        of_pair[hit] = known.buckets[near[hit]]
    rest = np.flatnonzero(of_pair < 0)
    spaced = [b" " + t for t in texts]
    crc = zlib.crc32
    of_pair[rest] = [crc(spaced[b], a) % buckets for a, b in zip(state[left[rest]].tolist(), right[rest].tolist(), strict=True)]
    out[at, 1] = of_pair[back]
    keep = np.ones((len(place), 2), dtype=bool)
    keep[:, 1] = has
    sizes = np.diff(first)
    return out[keep], np.concatenate([[0], np.cumsum(np.maximum(2 * sizes - 1, 0))])


def features(docs: DataFrame, known: Head, buckets: int) -> DataFrame:
    """doc_id, n_features, buckets (16-bit numbers, little-endian) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((known.words.to_pylist(), *known[1:]))

    def run(batches):
        words, *rest = sent.value
        here = Head(pa.array(words, pa.large_binary()), *rest)
        for rows, distinct, place, first in _words(batches):
            found, at = feature_buckets(distinct, place, first, here, buckets)
            packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(found.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), packed], names=["doc_id", "n_features", "buckets"])

    return map_arrow(docs, run, "doc_id long, n_features long, buckets binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit numbers, first of each row) of a binary column."""
    data, offsets = text_bytes(column)
    return data.view("<u2"), offsets // 2


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: one row per bucket and task is shuffled."""

    def run(batches):
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                sums += np.bincount(_numbers(batch.column(0))[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    rows = map_arrow(found.select("buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, target over source, of each bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight: the floored mean gain."""
    sent = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                numbers, first = _numbers(part.column(2))
                sums = np.concatenate([[0], np.cumsum(gain[numbers])])
                n = np.diff(first)
                weight = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1)  # rounds down
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return map_arrow(found, run, "doc_id long, n_features long, weight long")


def _noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value fixed by doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform)))


def ranked(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Of the N documents of ``least_words`` or more, ``percent`` % of N (rounded
    down) with the greatest scores are drawn; rank counts them from 1 and is null
    for the rest.  ``buckets`` is 65,536 at most.
    """
    spark = docs.sparkSession
    docs = columns(docs, "doc_id", "text")
    known = head(docs, buckets)
    found = materialize(features(docs, known, buckets), "features")
    wanted = features(columns(target, "doc_id", "text"), known, buckets)
    gain = gains(totals(found, buckets), totals(wanted, buckets))
    scored = _weights(found, gain).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
    # a document of n words has 2n - 1 features
    scored = scored.withColumn("eligible", F.col("n_features") >= 2 * least_words - 1)
    order = [F.desc("eligible"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = scored.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "scored")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"))
    # a row for each partition
    sizes = materialize(sizes, "sizes")
    draws = (sizes.agg(F.coalesce(F.sum("eligible"), F.lit(0))).first()[0] * percent) // 100
    base = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", base.alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    every = dealt.join(bases, "part").withColumn("rank", rank)
    return every.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("rank") <= draws), F.col("rank")).cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """The drawn documents with all their columns, and their rank (under a free name like ``rank``).

    Of rows that share a doc_id all are returned if one is drawn, each with the least rank of them.
    """
    rank = ranked(docs, target, percent, least_words, buckets, seed).where("rank is not null")
    rank = rank.groupBy("doc_id").agg(F.min("rank").alias("rank"))
    name, key = fresh(docs, "rank"), fresh(docs, "drawn_id")
    rank = rank.select(F.col("doc_id").alias(key), F.col("rank").alias(name))
    return docs.join(rank, docs["doc_id"].eqNullSafe(rank[key])).drop(key)
