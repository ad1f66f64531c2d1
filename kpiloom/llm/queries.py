"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import chains, decontaminate, jaccard, lines, merkle, mixing, quality, resample, sanitise, secretscan, suffixes, tokens, variants
from kpiloom.llm.tables import read

END_ID = 2


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints_with_edit(read(spark, sf_dir, "documents"))


def op2_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(read(spark, sf_dir, "documents"), n=3, percent=90)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = quality.held_out(F.col("doc_id"))
    weights = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    scored = quality.scores(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokens.read(manifest)


def _of_kind(kind: int) -> Callable[[Column], Column]:
    # one parameter: a second one would be the element's place
    return lambda span: span["kind"] == kind


def op8_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.spans(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(sanitise.KINDS)]
    base = sanitise.span_text(F.col("spans"))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit(sanitise.TERM), t["start"].cast("string"), t["end"].cast("string")))
    every = F.array_join(F.concat(F.when(base == "", F.array().cast("array<string>")).otherwise(F.array(base)), terms), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_term"))


def op9_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.spans(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _named(kind))).cast("long").alias(f"n_{kind}") for kind in secretscan.KINDS]
    base = secretscan.span_text(F.filter("spans", lambda s: s["kind"] != secretscan.FORMAT))
    added = F.size(F.filter("spans", _named(secretscan.FORMAT))).cast("long").alias("n_format")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secretscan.span_text(F.col("spans")).alias("spans"), added)


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_collinear_passages,
        op3_suffix_dedup,
        op4_ngram_jaccard_join,
        op5_benchmark_decontamination,
        op6_quality_classifier,
        op7_token_files,
        op8_pii_sanitisation,
        op9_mixing_to_weights,
        op10_line_dedup,
        op11_secret_grammars,
        op12_importance_resampling,
        op13_spelling_variants,
    )
}

_FOLDED_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

def _leaves(text: str) -> str:
    """SQL for the leaves' nodes of each paragraph."""
    return f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{merkle.LEAF}'), lambda x: sha256(x)))"


def _sections(paragraphs: str) -> str:
    marked = f"regexp_replace('<' || array_to_string({paragraphs}, '><') || '>', '(<[01][0-9a-f]*>)', '\\1|', 'g')"
    return f"list_transform(string_split(regexp_replace({marked}, '\\|$', ''), '|'), lambda s: sha256(s))"


def _levels(of: str, source: str) -> str:
    """SQL steps for paragraphs, sections, root and nodes of the leaves named by ``of``."""
    return f"""
        {of}_p as (select *, list_transform({of}_leaves, lambda l: sha256(array_to_string(l, ''))) as {of}_paragraphs from {source}),
        {of}_s as (select *, {_sections(f"{of}_paragraphs")} as {of}_sections from {of}_p),
        {of}_t as (select *, sha256(array_to_string({of}_sections, '')) as {of}_root,
                         list_distinct(list_concat(list_concat({of}_sections, {of}_paragraphs), flatten({of}_leaves))) as {of}_nodes from {of}_s)"""


ORACLE: dict[str, str] = {
    "op1_document_fingerprints": rf"""
        with n as (select doc_id, coalesce(text, '') as text,
                          coalesce(lead(coalesce(text, '')) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) as next_text
                   from documents),
        e as (select *, length(text) as n, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) as edited from n),
        l as (select *, {_leaves("text")} as a_leaves, {_leaves("edited")} as b_leaves, {_leaves("next_text")} as c_leaves from e),
        {_levels("a", "l")}, {_levels("b", "a_t")}, {_levels("c", "b_t")}
        select doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256, a_root as fingerprint, b_root as edited_fingerprint,
               (2 * (len(list_intersect(a_nodes, b_nodes)) + (a_root = b_root)::int))::double / (len(a_nodes) + len(b_nodes) + 2) as near_edited,
               (2 * (len(list_intersect(a_nodes, c_nodes)) + (a_root = c_root)::int))::double / (len(a_nodes) + len(c_nodes) + 2) as near_next,
               len(a_sections)::int as n_sections, len(a_paragraphs)::int as n_paragraphs,
               coalesce(list_position(list_transform(range(1, greatest(len(a_paragraphs), len(b_paragraphs)) + 1), lambda i: a_paragraphs[i] is distinct from b_paragraphs[i]), true), 0)::bigint as first_change
        from c_t""",
    "op10_line_dedup": """
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
        w as (select doc_id, l, unnest(range(1, len(l) - 1)) as p from d),
        r as (select doc_id, p, row_number() over (partition by array_to_string(l[p:p+2], chr(10)) order by doc_id, p) as nth from w),
        gone as (select distinct doc_id, p + unnest([0, 1, 2]) as p from r where nth > 1),
        every as (select doc_id, l, unnest(range(1, len(l) + 1)) as p from d),
        kept as (select doc_id, string_agg(l[p], chr(10) order by p) as text from every anti join gone using (doc_id, p) group by doc_id),
        removed as (select doc_id, count(*) as n from gone group by doc_id)
        select doc_id, len(l)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
        from d left join kept using (doc_id) left join removed using (doc_id)""",
    "op5_benchmark_decontamination": f"""
        with d as (select row_number() over () as row, doc_id, {_FOLDED_WORDS} as w from documents),
        ds as (select distinct row, doc_id, array_to_string(w[k:k+4], ' ') as s
               from (select *, unnest(range(1, len(w) - 3)) as k from d)),
        i as (select row_number() over () as irow, item_id, {_FOLDED_WORDS} as w from benchmark),
        i_s as (select distinct irow, item_id, array_to_string(w[k:k+4], ' ') as s
               from (select *, unnest(range(1, len(w) - 3)) as k from i)),
        sizes as (select irow, count(*) as n_item from i_s group by irow),
        shared as (select row, any_value(doc_id) as doc_id, irow, any_value(item_id) as item_id, count(*) as n_shared
                   from ds join i_s using (s) group by row, irow)
        select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment
        from shared join sizes using (irow) where 100 * n_shared >= 80 * n_item""",
    "op9_mixing_to_weights": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                          ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as place
                   from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
        w as (select *, 2 * source_size as cap, case rank % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s),
        l as (select *, cap * (6 // weight) as stop from w),
        r as (select *, sum(source_size) over () * 150 / 100.0::double as budget,
                     coalesce(sum(cap) over (order by stop, rank rows between unbounded preceding and 1 preceding), 0) as capped,
                     sum(weight) over (order by stop, rank rows between current row and unbounded following) as weights from l),
        f as (select *, stop * weights <= (budget - capped) * 6 as stopped from r),
        t as (select source, source_size, case when stopped then cap::double
                     else weight * (budget - coalesce(sum(cap) filter (stopped) over (), 0)) / sum(weight) filter (not stopped) over () end as target from f),
        p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from t),
        q as (select d.doc_id, d.source, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size as rest, place
              from d join p on d.source is not distinct from p.source),
        c as (select *, sum(size) over (partition by source order by place) as upto, sum(size) over (partition by source, place) as held from q)
        select doc_id, source, size::bigint as size, source_size, target,
               (size * (passes + case when upto <= rest or (upto - held <= rest and upto - rest < rest - (upto - held)) then 1 else 0 end))::bigint as taken
        from c""",
}
