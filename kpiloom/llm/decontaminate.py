"""Test items inside documents: size-partitioned MinHash containment search.

An item is contained where at least ``percent`` % of its distinct shingles of
``n`` words are in the document.

* Items fall into classes by size, up to 2**c shingles.  For each class, a
  document is searched in windows of 2**(c+1) shingles that overlap by half, so
  that a passage of an item's length lies in one window and is no small part of
  it, however long the document.
* Sketch: one-permutation MinHash of 128 bins.  A window and an item are a
  candidate when any bin has the same least hash.  For an item of 50 shingles whose shared
  shingles are together, some 20 bins are expected to agree, and as many if
  they are spread over several windows.  Documents without any hash that is a
  least hash of an item cannot agree in a bin and are not sketched.
* An item of up to SHORT shingles needs no sketch: each of its shingles that
  stands in a document makes it a candidate.
* Every candidate is verified by the exact containment of the shingles in the
  whole document.

Items are the stated query set.  They go to the tasks in blocks of at most
``block`` shingles, one pass over the documents each, so that what is broadcast
is bounded; a usual benchmark is one block.

Defined results: a text of fewer than ``n`` words, an empty or a null one has
no shingles; as an item it is never found, as a document it holds none.  Rows
with equal ids give a row each.  Further columns are ignored, and kept by
``clean_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, map_arrow
from kpiloom.llm.words import U64, shingles, slices, words
from kpiloom.staging import materialize

_BINS_SHIFT = U64(57)  # the first seven bits of a hash: 128 bins
_LOW = 20
SHORT = 8


class Index:
    """Sketches and shingles of one block of items, for use inside tasks."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[tuple[np.ndarray, int]]] = {}
        short = [k for k, items in enumerate(sets) if len(items) <= SHORT]
        values = np.concatenate([sets[k] for k in short]) if short else np.zeros(0, U64)
        order = np.argsort(values, kind="stable")
        self.short = values[order], np.repeat(short, [len(sets[k]) for k in short]).astype(np.int64)[order]
        for k, items in enumerate(sets):
            if len(items) <= SHORT:
                continue
            by_class.setdefault(max(int(len(items) - 1).bit_length(), 3), []).append((least(items), k))
        for c, sketches in by_class.items():
            values = np.concatenate([s for s, _ in sketches])
            owners = np.repeat([k for _, k in sketches], [len(s) for s, _ in sketches])
            order = np.argsort(values, kind="stable")
            self.classes[c] = (values[order], owners[order])
        every = np.unique(np.concatenate([self.short[0], *(v for v, _ in self.classes.values())]))
        self.values = every
        self.low = np.zeros(1 << _LOW, dtype=bool)
        self.low[(every & U64((1 << _LOW) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that are the least of a bin of some item, or of a short item."""
        at = np.flatnonzero(self.low[(hashes & U64((1 << _LOW) - 1)).astype(np.int64)])
        return at[isin_sorted(hashes[at], self.values)]

    def search(self, runs: np.ndarray, hits: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(item, shared, size) of the items contained in a document, given its shingles in order."""
        candidates: set[int] = set()
        values, owners = self.short
        present = np.unique(runs[hits])
        low, high = np.searchsorted(values, present), np.searchsorted(values, present, side="right")
        for a, b in zip(low[high > low], high[high > low], strict=True):
            candidates.update(owners[a:b].tolist())
        for c, (values, owners) in self.classes.items():
            half = 1 << c
            for window in np.unique(np.concatenate([hits // half, np.maximum(hits // half - 1, 0)])):
                sketch = least(runs[window * half : (window + 2) * half])
                low, high = np.searchsorted(values, sketch), np.searchsorted(values, sketch, side="right")
                for a, b in zip(low[high > low], high[high > low], strict=True):
                    candidates.update(owners[a:b].tolist())
        if not candidates:
            return []
        whole, found = np.unique(runs), []
        for k in sorted(candidates):
            shared = int(isin_sorted(self.sets[k], whole).sum())
            if 100 * shared >= percent * len(self.sets[k]):
                found.append((k, shared, len(self.sets[k])))
        return found


def least(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the least hash of every bin that has any."""
    ordered = np.unique(hashes)
    bins = ordered >> _BINS_SHIFT
    return ordered[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(ordered) else ordered


def isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _item_sets(items: DataFrame, n: int) -> DataFrame:
    """item_id and the sorted distinct shingle hashes of each item that has any."""

    def run(batches):
        for rows, data, offsets in slices(batches):
            hashes, _, _, first = words(data, offsets)
            out, at, _ = shingles(hashes, first, n)
            sets = [np.unique(out[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            full = pa.array([len(s) > 0 for s in sets], pa.bool_())
            found = pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["item_id", "hashes", "size"])
            yield found.filter(full)

    return map_arrow(columns(items, "item_id", "text"), run, "item_id long, hashes binary, size long")


def _blocks(items: DataFrame, n: int, block: int):
    """Broadcast indexes of the items, each of about ``block`` shingles (one item at least)."""
    sets = materialize(_item_sets(items, n), "items")
    total = sets.agg(F.sum("size")).first()[0] or 0
    count = -(-2 * total // block)  # hashed into blocks of half the size on average
    for k in range(count):
        rows = sets.where(F.pmod(F.xxhash64("hashes"), F.lit(count)) == k).collect()  # bounded by block
        if rows:
            yield sets.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [np.frombuffer(r.hashes, dtype=U64) for r in rows]))


def _found(batches, index: Index, n: int, percent: int):
    """(rows, [(row, item, shared, size)]) for slices of the batches."""
    for rows, data, offsets in slices(batches):
        hashes, _, _, first = words(data, offsets)
        runs, at, _ = shingles(hashes, first, n)
        hits = index.hits(runs)
        row_of = np.searchsorted(at, hits, side="right") - 1
        found = []
        for row in np.unique(row_of):
            inside = hits[row_of == row] - at[row]
            found += [(int(row), *match) for match in index.search(runs[at[row] : at[row + 1]], inside, percent)]
        yield rows, found


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, block: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every item found in a document."""
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    result = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(items, n, block):

        def run(batches, shared=shared):
            index = Index(*shared.value)
            for rows, found in _found(batches, index, n, percent):
                if found:
                    row, item, same, size = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(row)), pa.array([index.ids[k] for k in item], pa.int64()), pa.array(same, pa.int64()), pa.array(size, pa.int64()), pa.array([s / z for s, z in zip(same, size, strict=True)], pa.float64())],
                        names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        result = result.union(map_arrow(columns(docs, "doc_id", "text"), run, schema))
    return result


def clean_documents(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, block: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns stay."""
    schema, place = docs.schema, docs.columns.index("text")
    for shared in _blocks(items, n, block):

        def run(batches, shared=shared):
            index = Index(*shared.value)
            for batch in batches:
                at = 0
                for rows, found in _found([batch.select([place]).rename_columns(["text"])], index, n, percent):
                    keep = np.ones(rows.num_rows, dtype=bool)
                    keep[[row for row, *_ in found]] = False
                    yield batch.slice(at, rows.num_rows).filter(pa.array(keep))
                    at += rows.num_rows

        docs = map_arrow(docs, run, schema)
    return docs
