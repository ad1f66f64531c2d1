"""Decontamination, the quality classifier, token files, sanitisation and the pipeline."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kpiloom.llm import decontaminate, quality, sanitise, tokens
from kpiloom.llm.words import slices
from tests.llm.conftest import by_id

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# -- decontamination -------------------------------------------------------------


def _shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


@pytest.fixture(scope="module")
def leaks(spark, corpus):
    """Items cut from documents, changed, of all sizes, spread over a document, and none."""
    rng = random.Random(4)
    items = [None, "", "too short", corpus[9][:200]]
    for k in (10, 20, 35, 50, 55):
        words = (corpus[k] or "").split(" ")
        for size in (6, 15, 40, 90):
            part = words[3 : 3 + size]
            items.append(" ".join(part).upper())
            if len(part) > 30:
                part[rng.randrange(len(part))] = "changed"
            items.append(" ".join(part))
    words = corpus[10].split(" ")
    items.append(" ".join(words[5:35] + words[150:180]))
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), items


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_contained_items(docs, corpus, leaks, block):
    frame, items = leaks
    want = set()
    for k, text in enumerate(corpus):
        held = _shingles(text)
        for i, item in enumerate(items):
            own = _shingles(item)
            if own and 100 * len(own & held) >= 80 * len(own):
                want.add((k, i, len(own & held), len(own)))
    got = decontaminate.contained_items(docs, frame, block=block).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) > 60
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, frame, block=block).collect()}
    assert kept == set(range(len(corpus))) - {k for k, *_ in want}


def test_short_items_are_never_missed():
    rng = np.random.default_rng(12)
    runs = rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(runs[k : k + size]) for size in (1, 2, 8, 9) for k in range(0, 100_000, 200)]
    index = decontaminate.Index(list(range(len(sets))), sets)
    assert [k for k, *_ in index.search(runs, index.hits(runs), 100)] == list(range(len(sets)))
    assert index.search(runs[:0], index.hits(runs[:0]), 100) == []


def test_decontamination_of_hard_rows(hard, leaks, empty):
    frame, _ = leaks
    kept = decontaminate.clean_documents(hard, frame)
    assert kept.schema == hard.schema and 0 < kept.count() < hard.count()
    assert decontaminate.clean_documents(empty, frame).collect() == []
    assert decontaminate.contained_items(hard, frame.limit(0)).collect() == []
    assert decontaminate.clean_documents(hard, frame.limit(0)).count() == hard.count()


# -- quality ---------------------------------------------------------------------


def test_held_out_accuracy(spark):
    """On the given table, learnt from three quarters of the labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    scored = quality.scores(docs, weights).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = np.mean([(r.score >= 0.7) == (r.quality == 1) for r in scored])
    assert len(scored) > 50 and right >= 0.95
    again = quality.fit(docs.repartition(3), labels, ~quality.held_out(F.col("doc_id")))
    assert np.array_equal(weights, again)
    bounded = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")), most_rows=50)
    assert not np.array_equal(weights, bounded)


def test_scores_are_dot_products():
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["", "One", "one ONE one!! two | 3", "x " * 50, None, "é ç\nÉ"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "label": [1] * len(texts)})
    got = np.concatenate([s for _, s in quality._scored([batch], weights)])
    for rows, data, offsets in slices([batch]):
        for k, (where, value, _) in enumerate(quality._examples(rows, data, offsets)):
            assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(weights[where] @ value, -30, 30))), abs=1e-6)


def test_quality_of_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (5, None, 1), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit(hard, labels, F.lit(True))
    scores = quality.scores(hard, weights).collect()
    assert len(scores) == hard.count() and all(0 <= r.score <= 1 for r in scores)
    kept = quality.good_documents(hard, weights, 0.5)
    assert kept.schema == hard.schema and kept.count() == sum(r.score >= 0.5 for r in scores)
    none = quality.fit(hard, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.scores(hard, none).collect()} == {0.5}
    assert quality.fit(empty, labels, F.lit(True)).any() == np.False_
    assert quality.scores(empty, weights).collect() == []


# -- token files -----------------------------------------------------------------


def test_units_encode_as_the_whole():
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", " ", " ", "　", "\x85", "\x0b", "\x1c", "a", "B", "é", "!", "1", "<|endoftext|>", "'s", "…", "日", "​", "\x00", "\r\n", "don't", "   ", "12.5", "x,y"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    texts += ["".join(rng.choice([s for s in signs if "<" not in s]) for _ in range(30)) for _ in range(3000)]
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(open(TOKENIZER, encoding="utf-8").read(), 2)
    for rows, data, offsets in slices([pa.RecordBatch.from_pydict({"text": texts[:4000]}), pa.RecordBatch.from_pydict({"text": texts[4000:]})]):
        ids, at = encoder.encode(data, offsets)
        for k, text in enumerate(rows.column(0).to_pylist()):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE_UNITS", 5)
    encoder, whole = tokens.Encoder(open(TOKENIZER, encoding="utf-8").read(), 2), Tokenizer.from_file(TOKENIZER)
    for text in ["one two three", "four five six seven", "", "one two"] * 2:
        for _, data, offsets in slices([pa.RecordBatch.from_pydict({"text": [text]})]):
            assert encoder.encode(data, offsets)[0].tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


def test_token_files(docs, corpus, spark):
    manifest = tokens.write(docs, TOKENIZER, 2, parts=4)
    got = sorted(tokens.read(manifest, with_ids=True).collect())
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    for k, text in enumerate(corpus):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(got[k]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    rows = manifest.orderBy("part").collect()
    assert [r.base for r in rows] == np.cumsum([0] + [r.n_ids for r in rows[:-1]]).tolist() and {r.width for r in rows} == {2}
    # memory-mapped, or by ranges as from a remote store
    for row in rows:
        mapped, ranged = (tokens.TokenFile(row.path, row.width, way) for way in (True, False))
        assert isinstance(mapped.ids(0, row.n_ids), np.memmap) and not isinstance(ranged.ids(0, row.n_ids), np.memmap)
        for a, b in ((0, row.n_docs), (row.n_docs // 2, row.n_docs), (0, 1)):
            assert mapped.bounds(a, b).tolist() == ranged.bounds(a, b).tolist() and len(ranged.bounds(a, b)) == b - a + 1
            assert [x.tolist() for x in mapped.doc_ids(a, b)] == [x.tolist() for x in ranged.doc_ids(a, b)]
            x, y = (int(v) for v in ranged.bounds(a, b)[[0, -1]])
            assert mapped.ids(x, y).tolist() == ranged.ids(x, y).tolist() and len(ranged.ids(x, y)) == y - x
        assert ranged.bounds(0, row.n_docs)[-1] == row.n_ids


def test_token_files_are_read_in_pieces(docs, monkeypatch):
    manifest = tokens.write(docs, TOKENIZER, 2, parts=2)
    whole = sorted(tokens.read(manifest, with_ids=True).collect())
    folder = manifest.first().path.rpartition("/")[0]
    width = manifest.first().width
    import glob

    for path in glob.glob(f"{folder}/*.idx"):
        file = tokens.TokenFile(path.removesuffix(".idx"), width)
        at = 0
        while at < file.n_docs:
            bounds = file.bounds(at, min(at + 7, file.n_docs))
            at += len(bounds) - 1
        assert at == file.n_docs
    assert len(whole) == docs.count()


def test_token_files_of_hard_rows(hard, empty):
    got = tokens.read(tokens.write(hard, TOKENIZER, 2)).orderBy("start").collect()
    assert len(got) == hard.count()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert tokens.read(tokens.write(empty, TOKENIZER, 2)).collect() == []


# -- sanitisation ----------------------------------------------------------------


def _luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def _base(text):
    for kind, pattern in sanitise.PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = {"ip": kind == "ip" and any(int(p) > 255 for p in m[0].split(".")), "card": not (16 <= len(digits) <= 19 and _luhn(digits)), "phone": not 8 <= len(digits) <= 15}
            if not bad.get(kind, False):
                yield f"{kind}:{m.start()}:{m.end()}"


def test_base_spans(spark):
    rng = random.Random(3)
    parts = ["1", "23", "4111 1111 1111 1111", "4111111111111111", ".", "-", " ", "+1", " (", "a", "@", "b.c", "é", "5", "99", "255", "0", "_", "%", "+4912345678", "x@y.zz", "1.2.3.4", "\n", "999", "日"]
    texts = [None, "", "a" * 100_000 + "@", "1" * 50_000, "1 " * 30_000, "a@b.c " * 300, "+1 " * 2000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in sanitise.entities(frame).select("doc_id", sanitise.span_text(F.col("spans")).alias("s")).collect()}
    assert got == {k: ",".join(_base(t or "")) for k, t in enumerate(texts)}


@pytest.mark.parametrize("small", [100_000, 0])
def test_terms_that_reveal(spark, small):
    """A name always near one address goes; a frequent word and a copied passage stay."""
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["house", "river", "stone", "cloud", "green"]) for _ in range(n))
    texts = [f"{filler(8)} wrote Zacharias to eve.{k % 2}@mail.org {filler(8)}" if k % 2 else f"{filler(20)} {k}" for k in range(12)]
    copied = "Unrepeatable Gherkin spoke to only@once.net yesterday"
    texts += [copied, copied, copied, filler(5) + " Zacharias " + filler(3)] + [filler(20)] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sanitise.spans(frame, small=small)
    terms = {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in r.terms] for r in found.collect()}
    assert all(terms[k] == (["wrote", "Zacharias"] if k % 2 else []) for k in range(12))
    assert not any(terms[k] for k in range(12, len(texts)))
    clean = by_id(sanitise.sanitised(frame, found))
    assert "[EMAIL]" in clean[1].text and "Zacharias" not in clean[1].text and clean[0].text == texts[0]
    assert clean[12].text == copied.replace("only@once.net", "[EMAIL]")


def test_terms_of_the_whole_document(spark):
    """Far from the entity, beyond other numbers, short names, in a list of addresses."""
    rng = random.Random(10)
    filler = lambda n: " ".join(rng.choice(["house", "river", "stone", "cloud", "green"]) for _ in range(n))
    texts = [f"Jonathan Lee, born 1984, {filler(3)} card 4111 1111 1111 1111 {filler(60)} with Ng and 李明, {filler(2)} Lee" for _ in range(3)]
    texts += [f"{filler(9)}: {k}a@x.org, eve@mail.org, {k}b@x.org. {filler(40)} Zacharias" for k in range(3)]
    texts += [filler(20) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sanitise.spans(frame)
    terms = {r.doc_id: {texts[r.doc_id][t.start : t.end] for t in r.terms} for r in found.collect()}
    assert all({"Jonathan", "Lee", "Ng", "李明"} <= terms[k] for k in range(3))
    assert all("Zacharias" in terms[k] for k in range(3, 6))
    assert not any(terms[k] for k in range(6, 46))
    clean = by_id(sanitise.sanitised(frame, found))
    assert not any(name in clean[0].text for name in ("Jonathan", "Lee", "Ng", "李明"))


def test_many_entities_in_one_text(spark):
    """More than one piece and many blocks: places, surroundings and terms are those of slices of the text."""
    rng = random.Random(11)
    filler = lambda n: " ".join(rng.choice(["house", "𝒳river", "stone\n", "cloud", "green"]) for _ in range(n))
    texts = [" ".join(f"{filler(k % 40)} u{k}@host{d}.org Zacharias eve@mail.org" for k in range(150)) for d in range(2)]
    texts += [filler(20) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    around = F.udf(lambda t, a, b: [t[max(a - 120, 0) : a], t[b : b + 120]], "array<string>")
    each = sanitise.entities(frame).select("doc_id", F.explode("spans").alias("s")).join(frame, "doc_id")
    plain = each.withColumn("sides", around("text", "s.start", "s.end")).withColumn("want", F.xxhash64(F.get("sides", 0), F.get("sides", 1)))
    assert each.count() == 600
    assert plain.where("want <> s.place").count() == 0
    for row in sanitise.spans(frame).collect():
        text = texts[row.doc_id]
        assert [(s.start, s.end) for s in row.spans] == [m.span() for m in re.finditer(sanitise.PLAIN["email"], text)]
        assert [(t.start, t.end) for t in row.terms if text[t.start : t.end] == "Zacharias"] == [m.span() for m in re.finditer("Zacharias", text)]


def test_sanitisation_of_hard_rows(hard, empty):
    found = sanitise.spans(hard)
    assert found.count() == hard.count()
    assert sanitise.sanitised(hard, found).count() == hard.count()
    assert sanitise.spans(empty).collect() == []


# -- pipeline --------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    """Each stage's effect on what the one before it kept, at the smallest scale."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, frames = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, kept, sf_dir).write.parquet(path)
        kept = spark.read.parquet(path)
        frames.append(kept)
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in frames[2].collect()}
    leaked = {k for k, t in texts.items() for i in items if len(_shingles(i) & _shingles(t)) >= 0.8 * len(_shingles(i))}
    assert ids[3] == ids[2] - leaked
    tokens_out = frames[-1].orderBy("start").collect()
    assert len(tokens_out) == frames[-2].count()
    assert [r.start for r in tokens_out] == np.cumsum([0] + [r.n_tokens for r in tokens_out[:-1]]).tolist()
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, tokens_out))
    assert pq.read_table(f"{sf_dir}/documents.parquet").num_rows == len(ids[0])


def test_pipeline_stages_on_hard_and_empty_rows(spark, hard, empty, tmp_path):
    for k, frame in enumerate((hard, empty)):
        kept = frame
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, kept, "/root/testdata/sf0.001").write.parquet(path)
            kept = spark.read.parquet(path)
