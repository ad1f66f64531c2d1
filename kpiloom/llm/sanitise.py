r"""Personal data and the terms that give it away, in DataFrame functions alone.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers found by pattern.  A term (a word of three or more letters, or of two that
begins with a capital or a letter without case) in a document that holds an
entity reveals it as far as the corpus shows the two together: with document
counts over the whole corpus, the disclosure of entity e by term t is

    pointwise mutual information (e, t) / information content (e)
        = log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e)),

1 where t never occurs without e.  From ``generalise_at`` on a term is
generalised to its initial and its length class, from ``remove_at`` on it is
removed, wherever it stands in a document that holds that entity.  Evidence
needs ``support`` documents with distinct surroundings of the entity (what is
within ``reach`` characters of it), so copies of one passage count once, and a
term seen in one document reveals nothing.

The counts are over all documents: distinct terms of each document are combined
per task before any shuffle.  Only the terms that have support are counted; a
list of at most ``small`` terms is broadcast for that (so of a bounded size: a run
of more than ``LONGEST_TERM`` letters is no term), a longer one is joined.

Positions are code points, end exclusive.  The patterns keep the leftmost
non-overlapping matches of the plain ones stated in ``PLAIN`` but never try a
run of characters again from its middle, so that a text of any length and kind
is read in linear time.

Defined results: a null or empty text has no spans.  Each row is judged by its
own text; rows with the same doc_id and text get the same spans; a missing
doc_id is a document like others.  An empty table gives no rows.  Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tables import columns
from kpiloom.staging import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LONGEST_TERM = 64  # letters

#: What each kind is.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The same matches without retries inside a run (possessive, and only from a run's start or the last match's end).
_LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which there is no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"\p{L}{3,}+|(?<!\p{L})[\p{Lu}\p{Lt}\p{Lo}]\p{L}(?!\p{L})"
_SPAN = "struct<kind:int,start:int,end:int,value:string>"
_BLOCK = 64  # matches
_PIECE = 1024  # code points


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    digits = F.reverse(_digits(value))

    def add(total: Column, place: Column) -> Column:
        digit = digits.substr(place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(count.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return count.between(8, 15)
    return F.lit(True)


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(matches: Column, wanted: Callable[[Column], Column], record: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """``record`` of each wanted match, given its start and end: gaps and sizes up to it add up to them.

    Sums run over blocks of matches and then within each block, as a state that
    holds all records is copied at every match.
    """
    nothing, none = F.array().cast(f"array<{kind}>"), F.array().cast("array<int>")

    def blocks(every: Column) -> Column:
        last = F.greatest(F.floor((F.size(every) - 1) / _BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(every, k * _BLOCK + 1, F.lit(_BLOCK)))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda total, m: total + m["gap"] + m["size"])

    def step(state: Column, block: Column) -> Column:
        return F.struct((state["at"] + length(block)).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + m["size"]
        records = F.when(wanted(m), F.concat(state["records"], F.array(record(m, start, end)))).otherwise(state["records"])
        return F.struct(end.alias("at"), records.alias("records"))

    def inside(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), nothing.alias("records")), add, lambda state: state["records"])

    def run(every: Column) -> Column:
        starts = F.aggregate(every, F.struct(F.lit(0).alias("at"), none.alias("starts")), step, lambda state: state["starts"])
        return F.flatten(F.zip_with(every, starts, inside))

    return _named(_named(matches, blocks), run)


def _found(kind: str, text: Column) -> Column:
    """The valid matches of a kind: the lengths of what stands between matches add up to their positions."""
    pattern, code = F.lit(_LINEAR[kind]), KINDS.index(kind)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, _LINEAR[kind], -1)  # one more than matches
    # zipped, not indexed: what a lambda names is computed again for each element
    led = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("value"), F.length(b).alias("gap")))
    each = F.transform(F.filter(led, lambda x: x["value"].isNotNull()), lambda x: F.struct(
        x["value"].alias("value"), x["gap"].alias("gap"), F.length(x["value"]).alias("size"), _valid(kind, x["value"]).alias("valid"),
    ))

    def span(m: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lit(code).alias("kind"), start.alias("start"), end.alias("end"), m["value"].alias("value"))

    nothing = F.array().cast(f"array<{_SPAN}>")
    spans = _located(each, lambda m: m["valid"], span, _SPAN)
    needed = _NEEDS[kind]
    has = text.contains(needed) if needed else text.rlike("[0-9][0-9 -]{15}")
    return F.when(has, spans).otherwise(nothing)


def entities(docs: DataFrame, reach: int = 120) -> DataFrame:
    """doc_id, key (of the text), spans (the valid matches of all kinds, in the order of
    kind and start, with the hash of their surroundings), text (null without spans)."""
    rows = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    piece = max(_PIECE, reach)

    def around(at: Column, length: Column) -> Column:
        """At most ``reach`` code points from a place on, out of two pieces: a text has no index of its code points."""
        k = F.floor(at / piece).cast("int")
        two = F.concat(*(F.coalesce(F.get("pieces", i), F.lit("")) for i in (k, k + 1)))
        return two.substr(at - k * piece + 1, length)

    def placed(s: Column) -> Column:
        left = around(F.greatest(s["start"] - reach, F.lit(0)), F.least(s["start"], F.lit(reach)))
        return s.withField("place", F.xxhash64(left, around(s["end"], F.lit(reach))))

    found = rows.select("doc_id", "text", F.concat(*(_found(k, F.col("text")) for k in KINDS)).alias("spans"))
    found = found.withColumn("pieces", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))))
    spans = F.transform("spans", placed).alias("spans")
    return found.select("doc_id", F.xxhash64("text").alias("key"), spans, F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def _terms(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda t: F.length(t) <= LONGEST_TERM)
    return F.transform(words, lambda t: F.lower(t))


def _document_counts(docs: DataFrame, wanted: DataFrame, small: int) -> DataFrame:
    """term, n_t: in how many documents each wanted term occurs."""
    terms = columns(docs, "text").select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    if wanted.count() <= small:
        return terms.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    return terms.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")


def _mentions(found: DataFrame) -> DataFrame:
    """doc, kind, entity, place: each entity of a document once, with the least of its surroundings."""
    each = found.select(_doc().alias("doc"), F.explode("spans").alias("s")).select("doc", "s.kind", _entity(F.col("s")).alias("entity"), "s.place")
    return each.groupBy("doc", "kind", "entity").agg(F.min("place").alias("place"))


def _doc() -> Column:
    return F.xxhash64("doc_id", "key")


def _texts(found: DataFrame) -> DataFrame:
    """doc, text, spans of the documents with entities; rows that are equal in both are one."""
    return found.where("text is not null").select(_doc().alias("doc"), "text", "spans")


def disclosures(docs: DataFrame, found: DataFrame, mentions: DataFrame, support: int = 2, small: int = 100_000) -> DataFrame:
    """kind, entity, term, disclosure for every pair with support; ``found`` is what
    ``entities`` returned and ``mentions`` what ``_mentions`` did, both written."""
    total = found.count()
    # an entity with one surrounding has no pair with support: left out before its terms are counted
    repeated = mentions.groupBy("kind", "entity").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("kind", "entity")
    held = mentions.join(repeated, ["kind", "entity"], "left_semi").groupBy("doc").agg(F.collect_list(F.struct("kind", "entity", "place")).alias("held"))
    terms = F.array_distinct(_terms(F.col("text")))
    near = _texts(found).join(materialize(held, "held").hint("merge"), "doc").select("doc", "held", terms.alias("terms")).dropDuplicates(["doc"])
    near = near.select(F.explode("held").alias("h"), "terms").select("h.*", F.explode("terms").alias("term"))
    pair = ["kind", "entity", "term"]
    # copies have the same least place
    pairs = near.groupBy(*pair, "place").agg(F.count("*").alias("docs")).groupBy(*pair).agg(F.count("*").alias("places"), F.sum("docs").alias("n_et"))
    pairs = materialize(pairs.where(F.col("places") >= support).select("kind", "entity", "term", "n_et"), "pairs")
    counts = _document_counts(docs, materialize(pairs.select("term").distinct(), "terms"), small)
    holders = mentions.groupBy("kind", "entity").agg(F.count("*").alias("n_e"))
    joined = pairs.join(counts, "term").join(holders, ["kind", "entity"])
    information = F.log(F.lit(float(total)) / F.col("n_e"))
    mutual = F.log(F.lit(float(total)) * F.least("n_et", "n_e", "n_t") / (F.col("n_e") * F.col("n_t")))
    return joined.select("kind", "entity", "term", F.when(information > 0, mutual / information).otherwise(0.0).alias("disclosure"))


def _entity(span: Column) -> Column:
    """What two mentions of one entity have in common: digits, or the text in lower case."""
    return F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"]))


def _placed(text: Column, wanted: Column) -> Column:
    """(term, start, end) of the words of a text that are among the wanted terms."""
    words, between = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    pairs = F.filter(F.zip_with(words, between, lambda w, b: F.struct(F.lower(w).alias("term"), F.length(b).alias("gap"), F.length(w).alias("size"))), lambda x: x["term"].isNotNull())

    def one(w: Column, start: Column, end: Column) -> Column:
        return F.struct(w["term"].alias("term"), start.alias("start"), end.alias("end"))

    return _located(pairs, lambda w: F.array_contains(wanted, w["term"]), one, "struct<term:string,start:int,end:int>")


def term_spans(found: DataFrame, mentions: DataFrame, revealing: DataFrame, generalise_at: float = 0.6, remove_at: float = 0.9) -> DataFrame:
    """doc, terms (start, end, action): the revealing terms in the documents of their entity, outside the entities' own spans."""
    chosen = revealing.where(F.col("disclosure") >= generalise_at)
    # two entities may name one word: the stronger action holds
    named = mentions.join(chosen, ["kind", "entity"]).groupBy("doc", "term").agg(F.max("disclosure").alias("disclosure"))
    wanted = named.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("wanted"))
    rows = _texts(found).join(materialize(wanted, "wanted").hint("merge"), "doc").dropDuplicates(["doc"])
    words = rows.select("doc", "spans", "wanted", _placed(F.col("text"), F.map_keys("wanted")).alias("words"))
    free = F.filter("words", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    action = lambda w: F.when(F.element_at("wanted", w["term"]) >= remove_at, "remove").otherwise("generalise").alias("action")
    return words.select("doc", F.transform(free, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), action(w))).alias("terms"))


def spans(docs: DataFrame, support: int = 2, generalise_at: float = 0.6, remove_at: float = 0.9, small: int = 100_000, reach: int = 120) -> DataFrame:
    """doc_id, key, spans (kind, start, end, value) and terms (start, end, action) of every document."""
    found = materialize(entities(docs, reach), "entities")
    mentions = materialize(_mentions(found), "mentions")
    revealing = materialize(disclosures(docs, found, mentions, support, small), "disclosures")
    terms = term_spans(found, mentions, revealing, generalise_at, remove_at)
    rows = found.drop("text").withColumn("doc", _doc()).join(terms, "doc", "left")
    kind = "array<struct<start:int,end:int,action:string>>"
    return rows.select("doc_id", "key", "spans", F.coalesce("terms", F.array().cast(kind)).alias("terms"))


def span_text(spans_of_kinds: Column) -> Column:
    """kind:start:end of every base span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_of_kinds, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text with entities replaced by their kind and revealing terms generalised or removed.

    ``found`` is what ``spans`` returned for ``docs``.  Where spans of two kinds
    overlap, the first by start (then the longer) is replaced and the others
    only from its end on.
    """
    rows = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    marks = F.array_sort(F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.get(name, s["kind"]).alias("by"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("end"), t["action"].alias("by"))),
    ))
    found = found.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), marks.alias("marks")).distinct()
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["of"]) & (rows["key"] == found["of_key"]), "left")
    text = F.col("text")

    def add(state: Column, m: Column) -> Column:
        end = F.greatest(-m["end"], state["at"])
        word = text.substr(m["start"] + 1, F.lit(1))
        by = F.when(m["by"] == "remove", "").when(m["by"] == "generalise", F.concat(word, F.when(-m["end"] - m["start"] < 8, "[WORD]").otherwise("[LONG WORD]"))).otherwise(m["by"])
        kept = F.concat(state["out"], F.array(text.substr(state["at"] + 1, F.greatest(m["start"] - state["at"], F.lit(0)))), F.when(-m["end"] > state["at"], F.array(by)).otherwise(F.array().cast("array<string>")))
        return F.struct(end.alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("marks", start, add, lambda s: F.concat(F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.length(text))))
    return rows.select("doc_id", F.when(F.col("marks").isNull(), text).otherwise(done).alias("text"))
