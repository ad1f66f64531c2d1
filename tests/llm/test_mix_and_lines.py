"""Mixing, line dedup and Merkle fingerprints."""

import hashlib
import re
from fractions import Fraction

import pytest

from kpiloom.llm import lines, merkle, mixing
from tests.llm.conftest import by_id


def _targets(sizes, weights=(3, 1, 2), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, free, target = Fraction(sum(sizes.values()) * percent, 100), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] > most * sizes[s] * total or not sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = Fraction(most * sizes[s])
            free.remove(s)
        rest = Fraction(sum(sizes.values()) * percent, 100) - sum(target.values())
        if not free:
            break
    return target | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}


def test_mix(docs):
    got = mixing.mix(docs).collect()
    text = {r.doc_id: r for r in docs.collect()}
    sizes = {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken in (0, r.size, 2 * r.size)
    want = _targets(sizes)
    for source in sizes:
        rows = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(float(want[source])) for r in rows)
        assert abs(sum(r.taken for r in rows) - want[source]) <= max(r.size for r in rows) / 2
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())


def test_targets_stop_and_reshare(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 7}, {"a": 900, None: 1, "z": 3, "y": 44}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame, (3, 1, 2), 150, 2).collect()}
        assert got == pytest.approx({k: float(v) for k, v in _targets(sizes).items()})


def test_a_larger_budget_keeps_what_a_smaller_took(docs):
    small, large = (by_id(mixing.mix(docs, weights=(1,), percent=p)) for p in (40, 90))
    assert all(large[k].copies >= r.copies for k, r in small.items())


def test_mixed_documents(hard, empty):
    mixed = mixing.mixed_documents(hard)
    assert mixed.columns == hard.columns
    copies = {}
    for r in mixing.mix(hard).collect():
        copies[r.doc_id, r.size, r.source] = copies.get((r.doc_id, r.size, r.source), 0) + r.copies
    count = len(re.findall(r"\S+", "")) + mixed.count()
    assert count == sum(copies.values())
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def _without_runs(rows, run=3):
    """rows of (key, text) in order; lines that later occurrences of a run cover go."""
    seen, out = set(), {}
    for key, text in rows:
        cut = (text or "").split("\n")
        gone = set()
        for p in range(len(cut) - run + 1):
            body = tuple(cut[p : p + run])
            if body in seen:
                gone |= set(range(p, p + run))
            seen.add(body)
        out[key] = (len(cut), len(gone), "\n".join(x for p, x in enumerate(cut) if p not in gone))
    return out


def test_lines(docs, corpus):
    got = by_id(lines.without_repeated_lines(docs))
    assert {k: (r.n_lines, r.n_removed, r.text) for k, r in got.items()} == _without_runs(list(enumerate(corpus)))
    assert sum(r.n_removed for r in got.values()) > 20


def test_lines_of_hard_rows(spark, hard, empty):
    got = lines.without_repeated_lines(hard).collect()
    assert len(got) == hard.count()
    assert lines.without_repeated_lines(empty).collect() == []
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.text) for r in lines.without_repeated_lines(twice).collect())
    assert got == [(0, 0, "a\nb\nc"), (1, 3, ""), (1, 3, ""), (2, 3, "d")]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(text):
    """(root, all other nodes, paragraphs' nodes, paragraphs of each section) of a text."""
    below = [[_sha(x) for x in re.findall(merkle.LEAF, p)] for p in text.split("\n")]
    assert "\n".join("".join(re.findall(merkle.LEAF, p)) for p in text.split("\n")) == text
    nodes = [_sha("".join(leaves)) for leaves in below]
    groups, cut = [[]], False
    for n in nodes:
        if cut:
            groups.append([])
        groups[-1].append(n)
        cut = n[0] in "01"
    sections = [_sha("".join(f"<{n}>" for n in g)) for g in groups]
    return _sha("".join(sections)), {*sections, *nodes, *sum(below, [])}, nodes, groups


def _descent(a, b):
    """Number of the first paragraph that differs, from the first section that does; 0 if none."""
    before = 0
    for k in range(max(len(a), len(b))):
        x, y = (g[k] if k < len(g) else [] for g in (a, b))
        if x != y:
            rest = [sum(g[k:], []) for g in (a, b)]
            return before + next(i + 1 for i in range(max(map(len, rest))) if rest[0][i : i + 1] != rest[1][i : i + 1])
        before += len(x)
    return 0


def test_fingerprints(docs, corpus):
    got = by_id(merkle.fingerprints_with_edit(docs))
    texts = [t or "" for t in corpus]
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r, (top, nodes, paragraphs, groups) = got[k], _tree(text)
        assert (r.n_chars, r.edited_sha256) == (len(text), _sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (top, _tree(edited)[0])
        assert (r.n_paragraphs, r.n_sections) == (len(paragraphs), len(groups))
        for value, other in ((r.near_edited, edited), (r.near_next, following)):
            other_top, other_nodes, *_ = _tree(other)
            assert value == pytest.approx(2 * (len(nodes & other_nodes) + (top == other_top)) / (len(nodes) + len(other_nodes) + 2))
            assert (value == 1) == (text == other)
        assert r.first_change == _descent(groups, _tree(edited)[3])


def test_fingerprints_of_hard_rows(spark, hard, empty):
    got = merkle.fingerprints_with_edit(hard).collect()
    assert len(got) == hard.count()
    assert merkle.fingerprints_with_edit(empty).collect() == []
    one = spark.createDataFrame([(None, "only this. text here")], "doc_id long, text string")
    row = merkle.fingerprints_with_edit(one).first()
    assert row.near_next == 1.0 and row.near_edited < 1
    same = merkle.fingerprints(spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "a\nc")], "doc_id long, text string"))
    prints = {r.doc_id: r.fingerprint for r in same.collect()}
    assert prints[1] == prints[2] != prints[3]
