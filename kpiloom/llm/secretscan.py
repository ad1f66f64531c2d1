r"""Secrets in texts: plain patterns, and formats inferred as probabilistic automata.

Base spans are the matches of three plain patterns (``PLAIN``): assignments,
access keys and long hexadecimal runs.  They are the labelled credentials of the
method:

* Labelled strings.  The distinct values of each kind (of an assignment, the value
  alone) over the whole corpus, and the distinct other candidates.  Copies count
  once.  All of them are learned from.
* Grammar inference.  A prefix tree counts how often each prefix goes on with each
  character or ends.  From the root outwards, a state whose counts are compatible
  with those of a state already kept (Hoeffding's bound on every continuation, down
  both subtrees) is merged into it, else it is kept.  What is left is a
  deterministic probabilistic automaton.
* Rounds.  All strings run through the automaton so far, in parallel; Spark counts the
  passes of its edges, and behind the edges that lead nowhere yet the prefix tree of
  what is left of the strings, ``DEPTH`` characters deep.  One task for each kind
  infers states from the nodes that hold a ``most``-th of these strings; rarer ones
  wait for the next round, in which those that came to the same state count together.
  When no edge is open, the last counts are of all strings.  Up to ``most`` strings
  are one tree, inferred in one round if none is longer than ``DEPTH``.
* Scores.  Every candidate (a maximal run of ``least`` or more characters of
  ``[A-Za-z0-9+/_.-]`` with a letter and a digit) outside the base spans gets, for
  each kind, its log-likelihood per character under the kind's automaton.  It is a
  span of kind ``format`` if that reaches the likelihood of all but ``share`` of the
  kind's labelled strings, and is greater by ``gain`` or more than that under the
  background's automaton, which is inferred from the candidates that fall short of
  all kinds.

Automata are tables (kind, state, symbol, next, n, visits) of the states that were
kept, sent to every task.

Positions are code points, end exclusive.

Defined results: a null or empty text has no spans.  Rows with the same doc_id and
text get the same spans; a missing doc_id is a document like others.  A corpus
without labelled strings infers no automata and adds no spans.  An empty table gives
no rows.  Further columns are ignored by ``spans``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns, fresh, map_arrow
from kpiloom.llm.words import runs, slices, strings
from kpiloom.staging import materialize

KINDS = ("assign", "access", "hex")
FORMAT = "format"
BACKGROUND = "other"

#: What each kind is, and how long its value has to be.
PLAIN = {
    "assign": r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}

_ASSIGN = re.compile(PLAIN["assign"], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(PLAIN["access"])
# runs that are too short fail whole, so only the long ones need be looked for
_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
#: What a text with a base span holds.
_HINT = rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{{LEAST['hex']}}}"

_IN_RUN = np.zeros(256, dtype=bool)
for _first, _last in ("AZ", "az", "09"):
    _IN_RUN[ord(_first) : ord(_last) + 1] = True
_IN_RUN[[ord(c) for c in "+/_.-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_LETTER = _IN_RUN & ~_DIGIT
_LETTER[[ord(c) for c in "+/_.-"]] = False
SYMBOLS = int(_IN_RUN.sum()) + 2  # with "=", and the end

END = ""
DEPTH = 64  # characters of a prefix tree in one round
_HELD = 200_000  # counts held at once in a task
_COLLECTED = 10_000  # scores among which a quantile is looked up at once
_FOUND = "array<struct<kind:string,start:int,end:int,value:string>>"
_STRUCT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the valid base matches, by start, then in the order of kinds."""
    found = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end(), m[2]))
    for m in _ACCESS.finditer(text):
        if len(m[0]) >= LEAST["access"]:
            found.append((m.start(), 1, m.end(), m[0]))
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return [(KINDS[k], start, end, value) for start, k, end, value in sorted(found)]


def base_and_candidates(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, spans (the base ones), candidates (the other runs), both as (kind, start, end, value)."""

    def run(batches):
        for rows, data, offsets in slices(batches):
            texts = rows.column(1)
            hinted = pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_numpy(zero_copy_only=False)
            spans = [base_matches(t.as_py()) if h else [] for t, h in zip(texts, hinted, strict=True)]
            start, end, first = runs(_IN_RUN[data], offsets)
            digits, letters = (np.concatenate([[0], np.cumsum(of[data])]) for of in (_DIGIT, _LETTER))
            keep = (end - start >= least) & (digits[end] > digits[start]) & (letters[end] > letters[start])
            row = np.repeat(np.arange(rows.num_rows), np.diff(first))[keep]
            start, end = start[keep], end[keep]
            values = strings(data, start, end).to_pylist()
            # code points before each byte
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            start, end = points[start] - points[offsets[row]], points[end] - points[offsets[row]]
            others: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for k, a, b, value in zip(row.tolist(), start.tolist(), end.tolist(), values, strict=True):
                if not any(a < e and s < b for _, s, e, _ in spans[k]):
                    others[k].append({"kind": BACKGROUND, "start": a, "end": b, "value": value.decode()})
            held = [[{"kind": k, "start": s, "end": e, "value": v} for k, s, e, v in found] for found in spans]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(held, _STRUCT), pa.array(others, _STRUCT)], names=["doc_id", "spans", "candidates"])

    return map_arrow(columns(docs, "doc_id", "text"), run, f"doc_id long, spans {_FOUND}, candidates {_FOUND}")


def labelled(found: DataFrame, most: int | None = None) -> DataFrame:
    """kind, value: the distinct strings of each kind and of the background; with ``most``, about so many of each, by least hash."""
    each = found.select(F.explode(F.concat("spans", "candidates")).alias("s")).select("s.kind", "s.value").distinct()
    if most is None:
        return each
    each = materialize(each, "strings")
    counts = {row["kind"]: row["count"] for row in each.groupBy("kind").count().collect()}  # four kinds
    scale = 1 << 30
    share = F.create_map(*(F.lit(x) for kind, n in counts.items() for x in (kind, min(scale, scale * most // n)))) if counts else F.lit(None)
    return each.where(F.pmod(F.xxhash64("kind", "value"), F.lit(scale)) < share[F.col("kind")] if counts else F.lit(False))


class Automaton:
    """Counts of a deterministic probabilistic automaton: ``edges[state][symbol]`` is [next state, passes]."""

    def __init__(self, values: list[str]):
        self.edges: list[dict[str, list[int]]] = [{}]
        self.ends = [0]
        self.visits = [0]
        for value in values:
            state = 0
            for symbol in value:
                self.visits[state] += 1
                edge = self.edges[state].get(symbol)
                if edge is None:
                    edge = self.edges[state][symbol] = [len(self.edges), 0]
                    self.edges.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                edge[1] += 1
                state = edge[0]
            self.visits[state] += 1
            self.ends[state] += 1
        self.kept = [0]
        self.waiting: set[int] = set()  # nodes whose continuations are not known yet

    @classmethod
    def counted(cls, rows: list[tuple[int, str, str, int, int]]) -> Automaton:
        """From (state, prefix, symbol, next, n): how often a symbol follows a prefix behind a kept state, and the kept state it leads to or -1."""
        found = cls([])
        found.kept = list(range(1 + max(max(row[0], row[3]) for row in rows)))
        nodes = {(state, ""): state for state in found.kept}
        rows = sorted(rows, key=lambda row: (len(row[1]), row[:3]))
        for of in dict.fromkeys(row[:2] for row in rows if row[1]):
            nodes[of] = len(nodes)
        found.edges, found.ends, found.visits = [{} for _ in nodes], [0] * len(nodes), [0] * len(nodes)
        for state, prefix, symbol, to, n in rows:
            at = nodes[state, prefix]
            found.visits[at] += n
            if symbol == END:
                found.ends[at] += n
                continue
            if to < 0:
                to = nodes.get((state, prefix + symbol), -1)
            if to < 0:
                to = len(found.edges)
                found.waiting.add(to)
                found.edges.append({})
                found.ends.append(0)
                found.visits.append(n)
            found.edges[at][symbol] = [to, n]
        return found

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether no continuation tells the states apart; ``b`` is the root of a tree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            # the frequencies cannot differ by more than one, so few visits tell nothing
            if bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb)) >= 1:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb, bound):
                return False
            for symbol in self.edges[a].keys() | self.edges[b].keys():
                x, y = self.edges[a].get(symbol), self.edges[b].get(symbol)
                if self._differ(x[1] if x else 0, na, y[1] if y else 0, nb, bound):
                    return False
                if x and y and x[0] not in self.waiting and y[0] not in self.waiting:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree at ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for symbol, (state, passes) in self.edges[b].items():
                edge = self.edges[a].get(symbol)
                if edge is None:
                    self.edges[a][symbol] = [state, passes]
                    continue
                edge[1] += passes
                if edge[0] in self.waiting:
                    edge[0] = state
                elif state not in self.waiting:
                    todo.append((edge[0], state))

    def infer(self, alpha: float = 0.05) -> None:
        """Merges compatible states, the most visited first."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        kept = self.kept
        known = {*kept, *self.waiting}
        while True:
            border = [(-edge[1], state, symbol) for state in kept for symbol, edge in self.edges[state].items() if edge[0] not in known]
            if not border:
                return
            _, state, symbol = min(border)
            new = self.edges[state][symbol][0]
            for old in kept:
                if self.compatible(old, new, bound):
                    self.edges[state][symbol][0] = old
                    self.fold(old, new)
                    break
            else:
                kept.append(new)
                known.add(new)

    def rows(self):
        """(state, symbol, next, n, visits) of the kept states; an end is the empty symbol, and next is -1 there and where a node waits."""
        number = {state: k for k, state in enumerate(self.kept)}
        for state in self.kept:
            if self.ends[state]:
                yield number[state], END, -1, self.ends[state], self.visits[state]
            for symbol, (to, passes) in sorted(self.edges[state].items()):
                yield number[state], symbol, number.get(to, -1), passes, self.visits[state]


def _passes(strings_: DataFrame, known: dict[tuple[str, int, str], int]) -> DataFrame:
    """kind, state, prefix, symbol, next, n: of all strings, the passes of the known edges and of the tree behind the first unknown one."""

    def packed(held):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        values = zip(*((*of, n) for of, n in held.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], names=["kind", "state", "prefix", "symbol", "next", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = 0
                for at, symbol in enumerate((*value, END)):
                    to = known.get((kind, state, symbol), -1)
                    held[kind, state, "", symbol, to] += 1
                    if to < 0:
                        break
                    state = to
                for stop in range(at + 1, min(len(value), at + DEPTH) + 1):
                    held[kind, state, value[at:stop], value[stop : stop + 1], -1] += 1
                if len(held) > _HELD:
                    yield packed(held)
                    held.clear()
        if held:
            yield packed(held)

    counts = map_arrow(strings_.select("kind", "value"), run, "kind string, state long, prefix string, symbol string, next long, n long")
    return counts.groupBy("kind", "state", "prefix", "symbol", "next").agg(F.sum("n").alias("n"))


def automata(strings_: DataFrame, alpha: float = 0.05, most: int = 4_000) -> DataFrame:
    """kind, state, symbol, next, n, visits: the automaton of each kind, inferred from all its strings."""

    def infer(table: pa.Table) -> pa.Table:
        columns_ = (table.column(name).to_pylist() for name in ("state", "prefix", "symbol", "next", "n"))
        automaton = Automaton.counted(list(zip(*columns_, strict=True)))
        automaton.infer(alpha)
        rows = [(state, symbol, to) for state, symbol, to, _, _ in automaton.rows() if to >= 0]
        state, symbol, to = zip(*rows, strict=True) if rows else ((), (), ())
        kind = [table.column("kind")[0].as_py()] * len(rows)
        return pa.table({"kind": pa.array(kind, pa.string()), "state": pa.array(state, pa.int64()), "symbol": pa.array(symbol, pa.string()), "next": pa.array(to, pa.int64())})

    known: dict[tuple[str, int, str], int] = {}
    while True:
        counts = materialize(_passes(strings_, known), "passes")
        edges = counts.where("prefix = ''")
        # the strings of each kind that come to an open edge
        left = {row["kind"]: row["n"] for row in edges.where("symbol <> '' and next < 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        if not left:
            return edges.select("kind", "state", "symbol", "next", "n", F.sum("n").over(Window.partitionBy("kind", "state")).alias("visits"))
        least = F.create_map(*(F.lit(x) for kind, n in left.items() for x in (kind, -(-n // most))))
        of = ["kind", "state", "prefix"]
        nodes = counts.groupBy(*of).agg(F.sum("n").alias("visits")).where((F.length("prefix") < 2) | (F.col("visits") >= least[F.col("kind")]))
        tree = counts.join(nodes.select(*of), of)
        inferred = tree.groupBy("kind").applyInArrow(infer, "kind string, state long, symbol string, next long")
        known = {(row["kind"], row["state"], row["symbol"]): row["next"] for row in inferred.collect()}  # edges of kept states


class Grammar:
    """Log-likelihoods under the automaton of one kind, smoothed over all symbols."""

    def __init__(self, rows: list[tuple[int, str, int, int, int]], smooth: float = 0.02):
        self.next: dict[tuple[int, str], tuple[int, float]] = {}
        self.unseen: dict[int, float] = {}
        for state, symbol, to, n, visits in rows:
            whole = visits + smooth * SYMBOLS
            self.next[state, symbol] = (to, math.log((n + smooth) / whole))
            self.unseen[state] = math.log(smooth / whole)

    def score(self, value: str) -> float:
        """Log-likelihood per character, the end counted as one."""
        state, total = 0, 0.0
        for symbol in (*value, END):
            known = self.next.get((state, symbol))
            if known is None:
                # no state follows: each further character is any of all
                total += self.unseen.get(state, -math.log(SYMBOLS))
                state = -1
            else:
                state, cost = known
                total += cost
        return total / (len(value) + 1)


def grammars(rows: list) -> dict[str, Grammar]:
    by_kind = defaultdict(list)
    for row in rows:
        by_kind[row["kind"]].append((row["state"], row["symbol"], row["next"], row["n"], row["visits"]))
    return {kind: Grammar(found) for kind, found in by_kind.items()}


def _ordered(scores: DataFrame, place: int) -> float:
    """The score at a place in ascending order, looked up by histograms of ever smaller ranges."""
    while True:
        n, low, high = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
        if low == high:
            return low
        if n <= _COLLECTED:
            return sorted(row["score"] for row in scores.collect())[place]
        bin_ = F.floor((F.col("score") - low) / (high - low) * 1024)
        for k, held in sorted(scores.groupBy(bin_.alias("bin")).count().collect()):
            if place < held:
                break
            place -= held
        scores = scores.where(bin_ == k)


def _floors(known: dict[str, Grammar], strings_: DataFrame, share: float) -> dict[str, float]:
    """For each labelled kind the likelihood that all but ``share`` of its strings reach."""

    def run(batches):
        for batch in batches:
            kinds, values = (c.to_pylist() for c in batch.columns)
            scores = [known[kind].score(value) for kind, value in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["kind", "score"])

    scored = materialize(map_arrow(strings_.select("kind", "value"), run, "kind string, score double"), "scores")
    floors = {}
    for row in scored.groupBy("kind").count().collect():
        of_kind = scored.where(F.col("kind") == row["kind"])
        place, part = divmod(share * (row["count"] - 1), 1)
        around = [_ordered(of_kind, min(int(place) + k, row["count"] - 1)) for k in (0, 1)]
        floors[row["kind"]] = float(np.quantile(around, part))
    return floors


def spans(docs: DataFrame, least: int = 12, most: int = 4_000, alpha: float = 0.05, gain: float = 0.5, share: float = 0.01) -> DataFrame:
    """doc_id, spans: (kind, start, end, value) of every document, base ones and those of kind ``format``, by start, then kind."""
    found = materialize(base_and_candidates(docs, least), "candidates")
    strings_ = materialize(labelled(found), "labelled")
    of_kinds = strings_.where(F.col("kind") != BACKGROUND)
    known = grammars(automata(of_kinds, alpha, most).collect())  # the kept states
    floors = _floors(known, of_kinds, share)

    def reaches(value: str) -> bool:
        return any(known[kind].score(value) >= floor for kind, floor in floors.items())

    def others(batches):
        for batch in batches:
            yield batch.filter(pa.array([not reaches(v) for v in batch.column(1).to_pylist()], pa.bool_()))

    rest = materialize(map_arrow(strings_.where(F.col("kind") == BACKGROUND), others, "kind string, value string"), "background")
    background = grammars(automata(rest, alpha, most).collect()).get(BACKGROUND)

    def is_secret(value: str) -> bool:
        other = background.score(value) if background else -math.log(SYMBOLS)
        scores = ((known[kind].score(value), floor) for kind, floor in floors.items())
        return any(score >= floor and score - other >= gain for score, floor in scores)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                candidates = part.column(2).combine_chunks() if isinstance(part.column(2), pa.ChunkedArray) else part.column(2)
                values = candidates.flatten().field("value")
                secret = {v: is_secret(v) for v in values.unique().to_pylist()}
                out = []
                for base, others in zip(part.column(1).to_pylist(), candidates.to_pylist(), strict=True):
                    added = [{**c, "kind": FORMAT} for c in others if secret[c["value"]]]
                    out.append(sorted(base + added, key=lambda s: s["start"]) if added else base)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, _STRUCT)], names=["doc_id", "spans"])

    return map_arrow(found, run, f"doc_id long, spans {_FOUND}")


def span_text(found: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, the secrets of ``text`` replaced by ``[SECRET]``."""
    name, key, place = (fresh(docs, n) for n in ("spans", "of", "tie"))
    keyed = docs.withColumn(place, F.xxhash64("text"))
    # rows with the same text have the same spans
    found = spans(docs.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"]), **options)
    found = materialize(found.where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias(name)), "secrets")
    joined = keyed.join(found.hint("merge"), keyed[place] == found[key], "left")
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            held = batch.column(batch.schema.get_field_index(name)).to_pylist()
            texts = batch.column(at).to_pylist()
            for k, marks in enumerate(held):
                if marks:
                    done, pieces = 0, []
                    for mark in marks:
                        if mark["end"] > done:
                            pieces += [texts[k][done : max(mark["start"], done)], "" if mark["start"] < done else "[SECRET]"]
                            done = mark["end"]
                    texts[k] = "".join(pieces) + texts[k][done:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(schema))], names=schema.names)

    return map_arrow(joined.select(*docs.columns, name), run, schema)
