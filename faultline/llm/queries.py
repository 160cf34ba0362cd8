"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, merkle, minhash, packing, pii, suffixdedup, tokencount, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents"), kept=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokencount.count_edited(docs, tokencount.standard_edits(F.col("text")), vocabulary("byte_bpe_50k.tiktoken"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_warc, op4_decontamination, op5_near_duplicates, op6_substring_dedup, op7_token_counts, op8_html_text, op9_packing, op10_pii)}

_LEAVES = r"list_transform(string_split({0}, chr(10)), lambda p: list_transform(string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: sha256(s)))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SECTIONS = "list_transform(range(1, len({0}) + 1, 8), lambda k: sha256('s' || array_to_string({0}[k:k + 7], '')))"

ORACLE_SQL: dict[str, str] = {
    "op2_fingerprints": f"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
        n as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as nxt from d),
        e as (select *, length(text) as n_chars, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) as edited from n),
        l as (select doc_id, n_chars, sha256(edited) as edited_sha256, {_LEAVES.format("text")} as own, {_LEAVES.format("edited")} as new, {_LEAVES.format("nxt")} as aft from e),
        p as (select *, list_transform(own, lambda x: sha256('p' || array_to_string(x, ''))) as p_own, list_transform(new, lambda x: sha256('p' || array_to_string(x, ''))) as p_new,
            list_distinct(flatten(own)) as l_own, list_distinct(flatten(new)) as l_new, list_distinct(flatten(aft)) as l_aft from l)
        select doc_id, n_chars, edited_sha256, sha256('r' || array_to_string({_SECTIONS.format("p_own")}, '')) as fingerprint, sha256('r' || array_to_string({_SECTIONS.format("p_new")}, '')) as edited_fingerprint,
            2.0::double * len(list_intersect(l_own, l_new)) / (len(l_own) + len(l_new)) as near_edited, 2.0::double * len(list_intersect(l_own, l_aft)) / (len(l_own) + len(l_aft)) as near_next from p""",
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        w as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as largest from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to from w""",
    "op4_decontamination": f"""
        with d as (select doc_id, {_WORDS} as words from documents),
        b as (select item_id, {_WORDS} as words from benchmark),
        bw as (select distinct item_id, least(10, len(words)) as n, array_to_string(words[p:p + least(10, len(words)) - 1], ' ') as w
            from b, unnest(range(1, len(words) - least(10, len(words)) + 2)) as t(p) where len(words) > 0),
        dw as (select doc_id, n, p, array_to_string(words[p:p + n - 1], ' ') as w from d, (select distinct n from bw), unnest(range(1, len(words) - n + 2)) as t(p) where len(words) >= n),
        h as (select doc_id, item_id, n, p from dw join bw using (n, w)),
        x as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, n, p from h), unnest(range(p, p + n)) as t(q) group by doc_id),
        i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
        select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join x using (doc_id) left join i using (doc_id)""",
}
