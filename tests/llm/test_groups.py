"""Jaccard join and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.llm import jaccard
from kpiloom.llm.components import components
from kpiloom.llm.jaccard import bitmap, keys
from tests.llm.conftest import by_id


def _set(text, n):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _brute(rows, n, percent):
    sets = [(k, _set(t, n)) for k, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return sets, _roots({k for k, _ in rows}, links)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_near_groups(docs, corpus, n, percent):
    sets, roots = _brute(list(enumerate(corpus)), n, percent)
    got = by_id(jaccard.near_groups(docs, n, percent))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), roots[k]) for k, s in sets}


def test_rows_that_share_an_id_are_one_node(hard):
    got = jaccard.near_groups(hard, 3, 90).collect()
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    _, roots = _brute([r for r in rows if r[0] is not None], 3, 90)
    want = sorted((k is None, k or 0, len(_set(t, 3)), roots.get(k, -1)) for k, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_one_of_each_group_keeps_all_columns(hard):
    kept = jaccard.one_of_each_group(hard, 3, 90)
    assert kept.columns == hard.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and 10 in ids and 11 not in ids


def test_empty(empty):
    assert jaccard.near_groups(empty).collect() == []
    assert jaccard.one_of_each_group(empty).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        change = int(rng.integers(0, max(1, len(x) // 4) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
            assert len(np.intersect1d(keys(x, percent), keys(y, percent)))


def test_differing_bits_are_at_most_the_differing_hashes():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x, y = (np.unique(rng.integers(0, 400, 120).astype(np.uint64)) for _ in range(2))
        a, b = (np.frombuffer(bitmap(s), np.uint8) for s in (x, y))
        width = min(len(a), len(b))
        a, b = jaccard._folded(a, width), jaccard._folded(b, width)
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_blocks_of_a_tile(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK", 2)
    _, roots = _brute(list(enumerate(corpus)), 2, 60)
    got = by_id(jaccard.near_groups(docs, 2, 60))
    assert {k: r.component_id for k, r in got.items()} == roots


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 500 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (3, None)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == _roots({n for link in real for n in link}, real)
    assert components(frame.where(F.lit(False))).collect() == []
