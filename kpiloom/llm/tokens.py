"""Token ids as flat binary files with 64-bit document offsets.

A partition of documents (a range of doc_id, in order) becomes two files:

* ``*.bin``: the ids of its documents one after another, little-endian unsigned,
  16 bits each where the vocabulary allows it and 32 otherwise;
* ``*.idx``: int64 number of documents n, int64 offsets of the n+1 boundaries in
  ids from the start of the file, int64 doc_id of each, and a byte each that is
  1 where doc_id is present.

The manifest, one row per partition, is the commit record: a task writes under
a name of its own attempt, so files of a lost or repeated attempt are never in
it.  A file's place in the whole sequence (``base``) is the prefix sum of the
lengths of the files before it.

Byte-level BPE cuts a text before each run of white space that follows another
character, and between a letter and a sign, so units between such cuts are
encoded once and looked up after that.  Where non-ASCII white space stands
before, or a special token's string in the text, it is not cut so.

Defined results: a null or empty text is the end id alone.  A missing doc_id
comes first.  Rows of one doc_id follow each other in the order of a text hash.
Further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, map_arrow, partitions
from kpiloom.llm.words import EXACT, SPACE, U64, prefix_sums, range_hash, slices
from kpiloom.staging import materialize, new_path

_READ_IDS = 1 << 22  # ids read at once, but for a longer document
_CACHE_UNITS = 1_500_000  # memory only: a full cache is emptied
_encoders: dict[int, Encoder] = {}


class Encoder:
    """Encodes batches of texts, each distinct unit once.

    Units are looked up by a 64-bit hash in sorted arrays.  New units are
    encoded many in one string where the ids tell them apart again: units of a
    space and a word begin with the only token that begins with a space, and
    units without white space are joined by line feeds.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.end_id = end_id
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.opens[number] = token.startswith("\u0120")  # how byte-level vocabularies write a space
        feed = self._ids(["\n"])[0]
        self.feed = feed[0] if len(feed) == 1 else None
        self._empty()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _empty(self) -> None:
        self.known, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids = np.array([self.end_id], dtype=self.dtype)
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)  # unit 0 is the end id

    def _encoded(self, texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(the units in the order they come out, their ids laid end to end, the number of ids of each)."""
        spaced = [k for k, t in enumerate(texts) if t[:1] == b" " and len(t) > 1 and not SPACE[t[1]]]
        taken = set(spaced)
        plain = [k for k, t in enumerate(texts) if k not in taken and t.isascii() and not SPACE[np.frombuffer(t, np.uint8)].any()] if self.feed is not None else []
        taken.update(plain)
        order, flat, sizes = [], [], []
        for group, joint in ((spaced, b""), (plain, b"\n")):
            strings = [joint.join(texts[k] for k in group[a : a + 256]) for a in range(0, len(group), 256)]
            for a, ids in zip(range(0, len(group), 256), self._ids([s.decode("utf-8", "replace") for s in strings]), strict=True):
                part, ids = group[a : a + 256], np.array(ids, dtype=np.int64)
                if joint:
                    keep = ids != self.feed
                    bounds = np.cumsum(keep)[np.append(np.flatnonzero(~keep), len(ids) - 1)]
                    counts = np.diff(bounds, prepend=0)
                    ids = ids[keep]
                else:
                    counts = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
                if len(counts) == len(part):
                    order += part
                    flat.append(ids)
                    sizes.append(counts)
                else:  # not told apart after all: one by one
                    taken.difference_update(part)
        rest = [k for k in range(len(texts)) if k not in taken]
        for k, ids in zip(rest, self._ids([texts[k].decode("utf-8", "replace") for k in rest]), strict=True):
            order.append(k)
            flat.append(np.array(ids, dtype=np.int64))
            sizes.append(np.array([len(ids)]))
        return order, np.concatenate(flat).astype(self.dtype), np.concatenate(sizes)

    def _add(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        order, flat, sizes = self._encoded(texts)
        slots = len(self.size) + np.arange(len(order))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, flat])
        hashes = hashes[order]
        rank = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[rank])
        self.known, self.slot = np.insert(self.known, at, hashes[rank]), np.insert(self.slot, at, slots[rank])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their offsets by text) of the texts, each with the end id."""
        raw = data.tobytes()
        start, end, first = units(data, offsets, fine=not any(t in raw for t in self.added))
        every = range_hash(prefix_sums(data, EXACT), start, end)
        order = np.argsort(every)
        ranked = every[order]
        opens = np.ones(len(ranked), dtype=bool)
        opens[1:] = ranked[1:] != ranked[:-1]
        hashes, at = ranked[opens], order[opens]
        if len(self.size) > _CACHE_UNITS:
            self._empty()
        place = np.searchsorted(self.known, hashes)
        missing = np.flatnonzero(np.append(self.known, U64(0))[place] != hashes) if len(self.known) else np.arange(len(hashes))
        missing = np.union1d(missing, np.flatnonzero(place == len(self.known))) if len(self.known) else missing
        if len(missing):
            self._add(hashes[missing], [raw[a:b] for a, b in zip(start[at[missing]].tolist(), end[at[missing]].tolist(), strict=True)])
            place = np.searchsorted(self.known, hashes)
        slots = np.empty(len(every), dtype=np.int64)
        slots[order] = np.repeat(self.slot[place], np.diff(np.append(np.flatnonzero(opens), len(ranked)))) if len(ranked) else 0
        slots = np.insert(slots, first[1:], 0)  # the end id after each text
        first = first + np.arange(len(first))
        sizes = self.size[slots]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.start[slots] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[first]


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = ~_ALNUM[0x21:0x7F]
_SIGN[ord("'")] = False  # may begin a contraction


def units(data: np.ndarray, offsets: np.ndarray, fine: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the units that can be encoded apart, and the first of each text.

    ``fine`` also cuts a sign from the letter or digit before it, and a single
    other white-space character from the character after it.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = space[1:] & ~space[:-1] & (data[:-1] >= 0x20)
    # U+0085, U+00A0, and any character of the three-byte blocks that hold other white space
    cut[2:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
    cut[3:] &= ~((data[2:-1] >= 0x80) & (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
    texts = offsets[:-1][np.diff(offsets) > 0]
    cut[texts] = False
    if fine:
        after = cut[:-1] & (data[:-1] != 0x20) & ~space[1:] & (data[1:] < 0x80)
        cut[1:] |= after | (_ALNUM[data[:-1]] & _SIGN[data[1:]])
    cut[texts] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(data)), np.searchsorted(start, offsets)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes the files and returns the manifest: part, path, width, n_docs, n_ids, base."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())  # a few MB, whatever the corpus

    def run(batches):
        key = hash((tokenizer.value, end_id))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(tokenizer.value, end_id)
        encoder, task = _encoders[key], TaskContext.get()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        sizes, ids, present = [], [], []
        with store.open_output_stream(f"{root}/{name}.bin") as out:
            for rows, data, offsets in slices(batches):
                found, at = encoder.encode(data, offsets)
                out.write(found.tobytes())
                sizes.append(np.diff(at))
                present.append(np.asarray(rows.column(0).is_valid()).astype(np.uint8))
                ids.append(rows.column(0).fill_null(0).to_numpy().astype("<i8"))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            for part in (np.array([len(bounds) - 1]), bounds, *ids):
                out.write(part.astype("<i8").tobytes())
            for part in present:
                out.write(part.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{folder}/{name}"], "width": [encoder.dtype.itemsize], "n_docs": [len(bounds) - 1], "n_ids": [int(bounds[-1])]})

    rows = columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts or partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = materialize(map_arrow(ordered.select("doc_id", "text"), run, "part long, path string, width long, n_docs long, n_ids long"), "manifest")
    # one row per partition of files: a small table, whatever the corpus
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class TokenFile:
    """One file pair, read by ranges: memory-mapped where it is a local file, else by seeking.

    So no more of it is held than what is asked for, wherever it lies.
    """

    def __init__(self, path: str, width: int, mapped: bool | None = None):
        self.dtype = np.dtype(f"<u{width}")
        local = urlparse(path).scheme in ("", "file")
        if local if mapped is None else mapped:
            plain = urlparse(path).path
            maps = {kind: np.memmap(f"{plain}.{kind}", dtype=np.uint8, mode="r") if os.path.getsize(f"{plain}.{kind}") else np.zeros(0, np.uint8) for kind in ("bin", "idx")}
            self._bytes = lambda kind, a, b: maps[kind][a:b]
        else:
            store, plain = _filesystem(path)
            files = {kind: store.open_input_file(f"{plain}.{kind}") for kind in ("bin", "idx")}
            self._bytes = lambda kind, a, b: np.frombuffer(files[kind].read_at(b - a, a), dtype=np.uint8)
        self.n_docs = int(self._bytes("idx", 0, 8).view("<i8")[0])

    def _numbers(self, a: int, b: int) -> np.ndarray:
        return self._bytes("idx", 8 * a, 8 * b).view("<i8")

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where the ids of documents a to b - 1 start, and the last of them ends."""
        return self._numbers(1 + a, 2 + b)

    def doc_ids(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The doc_ids of documents a to b - 1, and whether each is there."""
        after = 2 + self.n_docs
        present = 8 * (after + self.n_docs)
        return self._numbers(after + a, after + b), self._bytes("idx", present + a, present + b)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b - 1 of the file."""
        return self._bytes("bin", a * self.dtype.itemsize, b * self.dtype.itemsize).view(self.dtype)


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids where asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["path"], row["width"])
                a = 0
                while a < row["n_docs"]:
                    # so many documents that their ids have a bounded size, but for one that is longer
                    b = min(a + 4096, row["n_docs"])
                    bounds = file.bounds(a, b)
                    b = a + max(1, int(np.searchsorted(bounds, bounds[0] + _READ_IDS, side="right")) - 1)
                    bounds = bounds[: b - a + 1]
                    doc_ids, present = file.doc_ids(a, b)
                    ids = file.ids(int(bounds[0]), int(bounds[-1]))
                    texts = [ids[x:y] for x, y in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)]
                    out = [
                        pa.array(doc_ids, pa.int64(), mask=present == 0),
                        pa.array(bounds[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in texts], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([x.tolist() for x in texts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
                    a = b

    return map_arrow(manifest.repartition(partitions(manifest.sparkSession), "part"), run, schema)
