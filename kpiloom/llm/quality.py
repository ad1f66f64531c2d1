"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text are n-grams of its words: the words themselves (folded; one
and two in a row) and their shapes (one to three in a row; a shape tells which
kinds of characters a word has, whether it begins with a capital, and whether
it repeats the word before).  Each is hashed to one of 2**18 weights and counts
by its share of the text's words; the score is the logistic function of their
sparse dot product with the weights.

Training is follow-the-regularised-leader with a rate per weight and L1 and L2
terms.  It uses at most ``most_rows`` labelled rows, chosen by a hash of doc_id
(a documented bound: the model has a fixed number of weights).  These rows are
divided over ``shards`` tasks; the model is the mean of their weights, so only
as many weight vectors as shards reach the driver.

Defined results: a null or empty text, or one without words, has the score of
the bias alone.  A missing or null label, or a missing doc_id, is not learnt
from.  Without any labelled row every score is 0.5.  Rows of equal doc_id are
scored each by its own text.  Further columns are ignored by ``scores`` and
kept by ``good_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, fresh, map_arrow
from kpiloom.llm.words import FOLDED, U64, mix, prefix_sums, range_hash, slices, spans

BITS = 18
_SCALE = 24.0  # of the shares, so that steps are of a useful size
_ALPHA, _BETA, _L1, _L2, _EPOCHS = 0.3, 1.0, 0.02, 0.5, 3

_KINDS = np.full(256, 2, dtype=np.uint16)  # letters, and all bytes of non-ASCII characters
_KINDS[:0x80] = 32  # further signs and control characters
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
for _kind, _signs in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"abcdefghijklmnopqrstuvwxyz"), (4, b"0123456789"), (8, b".,;:?'\"()-"), (16, b"!"), (64, b"|")):
    _KINDS[list(_signs)] = _kind


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weight numbers of every n-gram, one array per kind of n-gram and aligned to words, and the first word of each text."""
    start, end, first = spans(data, offsets)
    if not len(start):
        return [], first
    word = range_hash(prefix_sums(data, FOLDED), start, end)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shape = np.bitwise_or.reduceat(_KINDS[data], start).astype(np.int64)
    shape |= (_KINDS[data[start]] == 1).astype(np.int64) << 7
    joined = np.zeros(len(word), dtype=bool)  # to the word before
    joined[1:] = text[1:] == text[:-1]
    shape[1:] |= ((word[1:] == word[:-1]) & joined[1:]).astype(np.int64) << 8
    shape = np.where(joined, shape, shape | 512).astype(U64)

    def place(salt: int, *parts: np.ndarray) -> np.ndarray:
        total = np.full(len(word), salt, dtype=U64)
        for k, part in enumerate(parts):
            if k:
                part = np.concatenate([np.zeros(k, U64), part[:-k]]) if len(part) > k else np.zeros_like(part)
            total = mix(total + part)
        return (total >> U64(64 - BITS)).astype(np.int64)

    # a run that would reach into the text before is cut to what is joined
    bare = np.where(joined, word, U64(1))
    return [place(11, word), place(12, word, bare), place(13, shape), place(14, shape, shape), place(15, shape, shape, shape)], first


def _sparse(places: list[np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([p[a:b] for p in places])
    where, count = np.unique(every, return_counts=True)
    return where, count * (_SCALE / (b - a))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the bias last) after FTRL passes over (places, values, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(_EPOCHS):
        for where, value, label in examples:
            old, square = z[where], n[where]
            weight = -(old - np.clip(old, -_L1, _L1)) / ((_BETA + np.sqrt(square)) / _ALPHA + _L2)
            step = (1 / (1 + np.exp(-np.clip(weight @ value, -30, 30))) - label) * value
            grown = square + step * step
            z[where] = old + step - (np.sqrt(grown) - np.sqrt(square)) / _ALPHA * weight
            n[where] = grown
    return -(z - np.clip(z, -_L1, _L1)) / ((_BETA + np.sqrt(n)) / _ALPHA + _L2)


def _examples(rows: pa.RecordBatch, data, offsets):
    places, first = features(data, offsets)
    labels = rows.column(rows.schema.get_field_index("label")).to_pylist()
    for k, label in enumerate(labels):
        where, value = _sparse(places, first[k], first[k + 1]) if first[k + 1] > first[k] else (np.zeros(0, np.int64), np.zeros(0))
        yield np.append(where, 1 << BITS), np.append(value, 1.0), label


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", most_rows: int = 12_000, shards: int = 4) -> np.ndarray:
    """Weights from the labelled documents for which ``may_learn`` (of doc_id) holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    if not total:
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 40))
    chosen = known.withColumn("place", place).where(F.col("place") < int((1 << 40) * min(1.0, most_rows / total)))
    rows = columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most_rows numbers at most, but for chance
    rows = rows.repartition(shards, F.pmod("place", F.lit(shards))).sortWithinPartitions("place", F.xxhash64("text"))

    def run(batches):
        found = [e for part, data, offsets in slices(batches) for e in _examples(part, data, offsets)]
        if found:
            yield pa.RecordBatch.from_pydict({"n": [len(found)], "weights": [train(found).astype("<f4").tobytes()]})

    models = map_arrow(rows.select("text", "label"), run, "n long, weights binary").collect()  # one per shard
    if not models:
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    return np.average([np.frombuffer(m.weights, "<f4") for m in models], axis=0, weights=[m.n for m in models]).astype(np.float32)


def _scored(batches, weights: np.ndarray):
    for rows, data, offsets in slices(batches):
        places, first = features(data, offsets)
        words = np.diff(first)
        total = np.zeros(len(words))
        if places:
            each = weights[places[0]].astype(np.float64)
            for p in places[1:]:
                each += weights[p]
            sums = np.concatenate([[0.0], np.cumsum(each)])
            total = (sums[first[1:]] - sums[first[:-1]]) * _SCALE / np.maximum(words, 1)
        yield rows, 1 / (1 + np.exp(-np.clip(total + weights[-1], -30, 30)))


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every document: the likelihood of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2**18 numbers

    def run(batches):
        for rows, score in _scored(batches, model.value):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score)], names=["doc_id", "score"])

    return map_arrow(columns(docs, "doc_id", "text"), run, "doc_id long, score double")


def good_documents(docs: DataFrame, weights: np.ndarray, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; all columns stay."""
    model, place = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            at = 0
            for rows, score in _scored([batch.select([place]).rename_columns(["text"])], model.value):
                yield batch.slice(at, rows.num_rows).filter(pa.array(score >= least))
                at += rows.num_rows

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The rows never learnt from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
