"""Groups of spelling variants: words one edit apart, the rarer led to the more frequent.

Words are runs of letters, counted over all documents; some occurrences first lose
a letter, by a fixed function of document and run (``LOSS_ONE_IN``), which plants
variants to find.

Reduced-alphabet generation:

* Letters are hashed to ``SYMBOLS`` symbols.  Words one edit apart have reduced
  words that are equal or one edit apart.
* For every distinct reduced word its one-edit neighbourhood is generated: all
  deletions and all replacements by a smaller symbol, and itself.  Insertions and
  the other replacements are the same pairs seen from the other word, so they
  would find each pair twice.  A reduced word stands as a 64-bit polynomial hash,
  from which any edit's hash follows in constant time, at any length.
* The neighbourhoods are joined with the reduced vocabulary, and the words of
  related reduced words meet if their first or their last letters, half of the
  shorter word, are equal: one edit leaves one of the two halves as it is.  So a
  reduced word that very many words share is split by their own letters.
* What meets is verified on the original strings by edit distance.

No group of words is gathered: all steps are equi-joins whose two sides come out
of an exchange, so adaptive execution can split a common key.  A word has as many
neighbours as its length times the alphabet, and those are counted in an aggregate
with a map-side part.

Defined results: a null or empty text, or one without letters, has no words.  A
missing doc_id counts as an empty one.  Repeated rows count as often as they
stand.  An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, map_arrow
from kpiloom.llm.words import U64, mix, runs, slices, strings, text_bytes
from kpiloom.staging import materialize

SYMBOLS = 8
LOSS_ONE_IN = 31
_EMITTED = 1 << 18  # neighbours in a batch

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LEAD = 0xC3  # the first UTF-8 byte of U+00C0 to U+00FF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Letters by how often they stand in European prose, dealt to the symbols in turn, so that no symbol is much commoner than another; any other letter goes by its number.
_BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqzéäöüàèçñóíáúß"


def _symbol_of() -> np.ndarray:
    out = np.arange(256) % SYMBOLS
    for place, letter in enumerate(_BY_FREQUENCY):
        # out and back through the symbols: the commonest share with the rarest of the next row
        turn, at = divmod(place, SYMBOLS)
        out[ord(letter)] = at if turn % 2 == 0 else SYMBOLS - 1 - at
    return out


SYMBOL = _symbol_of()
_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = U64(pow(_BASE, -1, 1 << 64))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def _lost(word: bytes, doc: int) -> bytes:
    """The word, or without one letter if its hash (from the state after the document's) says so."""
    h = zlib.crc32(word, doc)
    if h % LOSS_ONE_IN:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counts(docs: DataFrame, least_letters: int) -> DataFrame:
    """word, n: the words of every slice of text, after the loss of letters."""

    def run(batches):
        for rows, data, offsets in slices(batches):
            lead = data == _LEAD
            inside = _LETTER[data] | lead
            inside[1:] |= lead[:-1]
            start, end, first = runs(inside, offsets)
            leads = np.concatenate([[0], np.cumsum(lead)])
            long = end - start - (leads[end] - leads[start]) >= least_letters
            if not long.any():
                continue
            text = np.repeat(np.arange(rows.num_rows), np.diff(first))[long]
            coded = strings(_LOWER[data], start[long], end[long]).dictionary_encode()
            words = coded.dictionary.to_pylist()
            # each word of a document once, with its count
            code, n = np.unique(text.astype(np.int64) * len(words) + coded.indices.to_numpy(), return_counts=True)
            states = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in rows.column(0).to_pylist()]
            found: dict[bytes, int] = {}
            for text, word, count in zip((code // len(words)).tolist(), (code % len(words)).tolist(), n.tolist(), strict=True):
                kept = _lost(words[word], states[text])
                found[kept] = found.get(kept, 0) + count
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counts = map_arrow(columns(docs, "doc_id", "text"), run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least_letters: int = 7, least_count: int = 2) -> DataFrame:
    """word, n of the words of ``least_letters`` or more that occur ``least_count`` times or more."""
    counts = _counts(docs, least_letters)
    return counts.where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


def _reduced(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of every letter, first letter of each word) of a column of words; letters are below U+0100."""
    data, offsets = text_bytes(batch_column)
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == _LEAD
    letters = np.where(second, data.astype(np.int64) + 0x40, data)[data != _LEAD]
    leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
    return SYMBOL[letters], offsets - leads[offsets]


def _hashes(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums before each letter within its word, one more at the end of each; sum of each word; place of each letter)."""
    sizes = np.diff(first)
    place = np.arange(len(symbols)) - np.repeat(first[:-1], sizes)
    terms = (symbols + 1).astype(U64) * _powers(int(sizes.max(initial=0)) + 1)[place]
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(terms, dtype=U64)])
    before = sums[:-1] - np.repeat(sums[first[:-1]], sizes)
    return before, sums[first[1:]] - sums[first[:-1]], place


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, size (in letters), key (hash of the reduced word)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                symbols, first = _reduced(batch.column(0))
                key = mix(_hashes(symbols, first)[1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first).astype(np.int32)), pa.array(key)], names=["word", "n", "size", "key"])

    return map_arrow(words, run, "word string, n long, size int, key long")


def neighbours(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reduced word's hash, its number) of the words themselves, their deletions and their replacements by smaller symbols."""
    before, total, place = _hashes(symbols, first)
    sizes = np.diff(first)
    word = np.repeat(np.arange(len(sizes)), sizes)
    power = _powers(int(sizes.max(initial=0)) + 1)[place]
    after = total[word] - before - (symbols + 1).astype(U64) * power
    # of a run of equal symbols, every deletion gives the same word
    last = np.ones(len(symbols), dtype=bool)
    last[:-1] = (symbols[1:] != symbols[:-1]) | (word[1:] != word[:-1])
    found, owner = [total, (before + after * _INVERSE)[last]], [np.arange(len(sizes)), word[last]]
    for less in range(1, SYMBOLS):
        can = symbols >= less
        found.append((total[word] - U64(less) * power)[can])
        owner.append(word[can])
    return mix(np.concatenate(found)), np.concatenate(owner)


def _related(words: DataFrame) -> DataFrame:
    """key, near: reduced words and those in their neighbourhoods, itself included, that the vocabulary has."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, first = _reduced(batch.column(1))
            keys = batch.column(0).to_numpy()
            start = 0
            while start < batch.num_rows:
                room = first[start] + _EMITTED // SYMBOLS
                stop = max(int(np.searchsorted(first, room, side="right")) - 1, start + 1)
                stop = min(stop, batch.num_rows)
                near, owner = neighbours(symbols[first[start] : first[stop]], first[start : stop + 1] - first[start])
                yield pa.RecordBatch.from_arrays([pa.array(keys[start:stop][owner]), pa.array(near.view(np.int64))], names=["key", "near"])
                start = stop

    reduced = materialize(words.groupBy("key").agg(F.min("word").alias("word")), "reduced")
    known = reduced.select(F.col("key").alias("near"))
    return map_arrow(reduced, run, "key long, near long").join(known, "near", "left_semi")


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every unordered pair of different words (word, n, size, key) one edit apart, once."""
    related = materialize(_related(words), "related")
    # near is the reduced word of the shorter one, or of one as long
    meets = F.explode(F.array(
        F.xxhash64(F.col("near"), F.lit(0), F.expr("left(word, half)")),
        F.xxhash64(F.col("near"), F.lit(1), F.expr("right(word, half)")),
    )).alias("meets")
    of_near = words.select(F.col("key").alias("near"), "word", "n", F.expr("int(size / 2)").alias("half"))
    right = of_near.select(F.col("word").alias("b"), F.col("n").alias("n_b"), meets)
    led = related.join(words, "key")
    # the other word may be as long or a letter shorter; both halves differ only if the size is even
    halves = F.expr("if(size % 2 = 0 and key != near, array(int(size / 2), int(size / 2) - 1), array(int(size / 2)))")
    left = led.select("near", "word", "n", F.explode(halves).alias("half")).select(F.col("word").alias("a"), F.col("n").alias("n_a"), meets)
    met = left.join(right, "meets").where("a != b and levenshtein(a, b, 1) = 1")
    # a pair may meet by both halves; within one reduced word, or with replacements, from either side
    pair = met.select(F.when(F.col("a") < F.col("b"), F.struct("a", "n_a", "b", "n_b")).otherwise(F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))).alias("p"))
    return pair.select("p.*").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, in steps that double; a chain is short, as counts grow tenfold along it."""
    state = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        state = materialize(state, "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = state.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))


def variants(docs: DataFrame, least_letters: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    Two words are near if one inserted, deleted or replaced letter tells them
    apart.  A word's form is its most frequent near word (ties: the first in
    code-point order) if that is ``times`` times as frequent or more.
    """
    words = materialize(_keyed(vocabulary(docs, least_letters, least_count)), "vocabulary")
    pairs = materialize(near_words(words), "near")
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n"))))
    best = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other"))).alias("best"))
    facts = words.select("word", "n").join(best, "word", "left")
    strong = -F.col("best.less") >= times * F.col("n")
    facts = facts.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    facts = materialize(facts, "forms")
    roots = _roots(facts.where("form is not null"))
    return facts.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
