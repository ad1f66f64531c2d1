"""Small corpora with every hard case, and a frame with clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "key long, tie long, range int, component_id long, score double, hash string, place int, size string, copies int, lines string, spans string, of long"


def _prose(rng, count, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(count))


@pytest.fixture(scope="session")
def corpus():
    """Texts: null, empty, blank, tiny, long, equal, nearly equal, with shared passages and repeated lines."""
    rng = random.Random(11)
    shared = _prose(rng, 120)
    texts = [None, "", " \n\t", "Word", "two words", "a b c d e", "x" * 5000, "ab" * 900, "é" * 700, "same " * 3000]
    base = _prose(rng, 200)
    texts += [base, base, base.upper(), base.replace(" ", "\n", 3), base + " tail", shared, "Eins. " + shared + " Zwei!"]
    for k in range(20):
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    texts += [_prose(rng, rng.randint(1, 150)) + " " + shared + "\n" + _prose(rng, rng.randint(1, 150)) for _ in range(10)]
    texts += [_prose(rng, rng.randint(1, 300)) for _ in range(20)]
    block = "\n".join(_prose(rng, 6) for _ in range(4))
    texts += ["\n".join([_prose(rng, 4), block, _prose(rng, 4)]) for _ in range(6)] + [block + "\n" + block, "l\nl\nl\nl\nl"]
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(k, t, "en", [None, "s1", "s2", "s3"][k % 4], None if t is None else len(t)) for k, t in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def hard(spark, corpus):
    """Rows without doc_id, rows listed twice, one doc_id with two texts, all columns null, and extra columns."""
    rows = [(k, t, "en", "s1", 0) for k, t in enumerate(corpus[:30])]
    rows += [(None, corpus[10], None, None, None), (None, None, None, None, None), (None, corpus[40], "de", "s2", 1)]
    rows += [rows[10], rows[10], rows[40 % 30], (3, corpus[45], "en", None, None), (10, corpus[46], "en", "s3", 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for column in CLASHING.split(", "):
        name, kind = column.split(" ")
        frame = frame.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {row["doc_id"]: row for row in frame.collect()}
