"""Every registered query of the core engine, next to the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, embedding, extraction, fusion, graph, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Shared SQL: the same definitions as faultline.functions.text.
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')"
_TERMS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda t: length(t) > 1 and t not in ({_STOP}))".replace("{{", "{").replace("}}", "}")


def terms_sql(column: str) -> str:
    return _TERMS.replace("{0}", column)


_SCR_SELECT = "select p_partkey as row_no, upper(substr(p_type,1,4)) || '-' || lpad(cast(p_partkey % 150 as {s}),3,'0') || ' ' || p_name || ' fault detected on axis motor during cycle' as symptom, p_brand || ' ' || p_type || ' worn part' as cause, 'Replace ' || p_name || ' and reset ' || p_brand as remedy, 'EQ-' || cast(p_size % 5 as {s}) as equipment, p_partkey {d} 20 as page from {t}"
_SCR = "with scr as (" + _SCR_SELECT.format(s="varchar", d="//", t="part") + ")"


def scr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic symptom, cause and remedy relation over parts."""
    return spark.sql(_SCR_SELECT.format(s="string", d="div", t="{part}"), part=table(spark, sf_dir, "part"))


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual pages written from the relation: document_id (its page), text."""
    rows = scr(spark, sf_dir).select(F.col("page").alias("document_id"), "row_no", F.concat("symptom", F.lit(" Cause: "), "cause", F.lit(". Remedy: "), "remedy", F.lit(".")).alias("line"))
    return chunking.joined_in_order(rows, "document_id", "row_no", "line")


_MANUAL = _SCR + ", manual as (select page as document_id, string_agg(symptom || ' Cause: ' || cause || '. Remedy: ' || remedy || '.', ' ' order by row_no) as text from scr group by page)"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts: the whole texts of the benchmark items whose id is divisible by 20."""
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "text")


_ASKED = "asked as (select item_id as query_id, text from benchmark where item_id % 20 = 0)"

# -- text ------------------------------------------------------------------------------------------------------------


@query("x01_word_count", f"select doc_id, len({_W})::bigint as words from documents")
def x01(spark, d):
    return docs_of(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("x04_long_words", f"select doc_id, len(list_filter({_W}, lambda w: length(w) > 15))::bigint as long_words from documents")
def x04(spark, d):
    return docs_of(spark, d).select("doc_id", T.long_words(F.col("text")).alias("long_words"))


@query("x05_clean_triplet", r"select doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text,''), '\s+', ' ', 'g'), '[^\x20-\x7EÀ-ÿ]', '', 'g')), '\$.\$', '', 'g'), '\^\d', '', 'g') as cleaned from documents")
def x05(spark, d):
    return docs_of(spark, d).select("doc_id", T.clean_triplet(F.col("text")).alias("cleaned"))


@query("x07_strict_codes", _SCR + r" select row_no, array_to_string(regexp_extract_all(upper(symptom), '\b[A-Z]{3,5}-\d{3,4}\b'), ',') as codes from scr")
def x07(spark, d):
    return scr(spark, d).select("row_no", F.array_join(T.strict_codes(F.col("symptom")), ",").alias("codes"))


@query("x08_code_prefix", _SCR + r" select row_no, regexp_extract(symptom, '[A-Z]+-\d+') as code, split_part(regexp_extract(symptom, '[A-Z]+-\d+'), '-', 1) as prefix from scr")
def x08(spark, d):
    return scr(spark, d).select("row_no", T.first_code(F.col("symptom")).alias("code")).withColumn("prefix", T.code_prefix(F.col("code")))


@query("x09_clean_query", r"""select item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '["''()\[\]{}!?*]', '', 'g'), '[:;+\-/\\|&]', ' ', 'g'), '\s+', ' ', 'g')) as cleaned from benchmark""")
def x09(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.clean_query(F.col("text")).alias("cleaned"))


@query("x11_token_set", r"select item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+'), lambda w: w <> ''))), ' ') as tokens from benchmark")
def x11(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(T.token_set(F.col("text"))), " ").alias("tokens"))


@query("x12_analyzed_terms", f"select doc_id, len({terms_sql('text')})::bigint as n, md5(array_to_string({terms_sql('text')}, ' ')) as terms from documents")
def x12(spark, d):
    return docs_of(spark, d).select("doc_id", T.analyzed(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


@query("x13_keyword", "select doc_id from documents where contains(lower(text), 'tion')")
def x13(spark, d):
    return docs_of(spark, d).where(T.contains_keyword(F.col("text"), "tion")).select("doc_id")


@query("x15_shortened", _SCR + " select row_no, left(symptom, 50) || '...' as short from scr")
def x15(spark, d):
    return scr(spark, d).select("row_no", T.shortened(F.col("symptom")).alias("short"))


@query("x16_levenshtein", _SCR + " select row_no, levenshtein(symptom, remedy)::bigint as d from scr")
def x16(spark, d):
    return scr(spark, d).select("row_no", F.levenshtein("symptom", "remedy").cast("long").alias("d"))


@query("x18_content_hash", "select doc_id, md5(trim(text)) as hash from documents")
def x18(spark, d):
    return docs_of(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("x20_token_estimate", f"select doc_id, floor(len({_W}) * 0.75)::int as tokens from documents")
def x20(spark, d):
    return docs_of(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_REPLY = "case row_no % 4 when 0 then 'Here it is: ```json' || chr(10) || '{\"symptom\": \"' || symptom || '\", \"n\": {\"k\": 1}}' || chr(10) || '``` and {\"other\": 2}' when 1 then 'Sure: {\"symptom\": \"' || symptom || '\", \"n\": {\"k\": 2}} {\"b\": 3}' when 2 then 'none' else '{\"broken' end"


@query("x22_json_in_prose", _SCR + ", r as (select row_no, symptom, " + _REPLY + " as reply from scr), j as (select row_no, coalesce(nullif(regexp_extract(reply, '(?is)```json\\s*(\\{.*?\\})\\s*```', 1), ''), nullif(regexp_extract(reply, '(?s)\\{(?:[^{}]|\\{[^{}]*\\})*\\}', 0), '')) as j from r) select row_no, j, j::json->>'$.symptom' as symptom, (j::json->>'$.n.k')::bigint as k from j")
def x22(spark, d):
    """JSON objects in prose: fenced, bare, absent and broken."""
    j = T.json_in_prose(F.expr(_REPLY.replace("chr(10)", "char(10)")))
    return scr(spark, d).select("row_no", j.alias("j")).select("row_no", "j", F.get_json_object("j", "$.symptom").alias("symptom"), F.get_json_object("j", "$.n.k").cast("long").alias("k"))


# -- chunks, corpus statistics ---------------------------------------------------------------------------------------


@query("c01_fixed_windows", f"with w as (select doc_id, {_W} as w from documents), s as (select doc_id, w, unnest(range(0, len(w), 100)) as pos from w where len(w) > 0) select doc_id as document_id, pos // 100 as chunk_id, md5(array_to_string(w[pos + 1:pos + 200], ' ')) as hash, len(w[pos + 1:pos + 200])::bigint as word_count, length(array_to_string(w[pos + 1:pos + 200], ' '))::bigint as char_count from s")
def c01(spark, d):
    rows = chunking.fixed_windows(docs_of(spark, d).withColumnRenamed("doc_id", "document_id"))
    return rows.select("document_id", "chunk_id", F.md5("text").alias("hash"), "word_count", "char_count")


_SENTENCES = r"list_filter(regexp_split_to_array(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query("c02_sentence_groups", rf"""with recursive base as materialized (select row_number() over () as r, doc_id, {_SENTENCES} as ss from documents),
    sized as materialized (select r, doc_id, ss, list_transform(ss, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))) as n from base where len(ss) > 0),
    run as (
        select r, 1::bigint as k, 1::bigint as first, n[1]::bigint as held, 0::bigint as chunk_id, 0::bigint as out_first, 0::bigint as out_last from sized
        union all
        select r, k + 1, case when full_now then carry else first end, case when full_now then coalesce(list_sum(n[carry:k]), 0) + n[k + 1] else held + n[k + 1] end::bigint, chunk_id + full_now::int, case when full_now then first else 0 end, case when full_now then k else 0 end
        from (select run.*, n, held + n[k + 1] > 200 as full_now, k + 1 - len(list_filter(range(1, k - first + 2), lambda i: list_sum(n[k - i + 1:k]) <= 100)) as carry from run join sized using (r) where k < len(n))
    ),
    cuts as (select r, chunk_id - 1 as chunk_id, out_first as a, out_last as b from run where out_last > 0 union all select r, chunk_id, first, k from run join sized using (r) where k = len(n)),
    texts as (select doc_id as document_id, chunk_id, array_to_string(ss[a:b], ' ') as text from cuts join sized using (r))
    select document_id, chunk_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::bigint as word_count, length(text)::bigint as char_count from texts""")
def c02(spark, d):
    return chunking.sentence_groups(docs_of(spark, d).withColumnRenamed("doc_id", "document_id"))


@query("c03_conversations", "select conv_id, string_agg(coalesce(text, ''), ' ' order by turn, text) as text from conversations group by conv_id")
def c03(spark, d):
    rows = table(spark, d, "conversations")
    return chunking.joined_in_order(rows, "conv_id", "turn", "text")


_CHUNKS = f"w as (select doc_id, {_W} as w from documents), ch as (select doc_id, w[pos + 1:pos + 200] as c from w, unnest(range(0, len(w), 100)) as t(pos) where len(w) > 0), st as (select doc_id, len(c) as n, length(array_to_string(c, ' ')) as chars, len(list_filter(c, lambda x: length(x) > 15)) as longs from ch)"


def _chunks(spark, d):
    return chunking.fixed_windows(docs_of(spark, d).withColumnRenamed("doc_id", "document_id"))


@query("a01_chunk_quality", f"with {_CHUNKS} select doc_id as document_id, count(*) as chunks, round(avg(n), 6) as avg_words, min(n)::bigint as min_words, max(n)::bigint as max_words, round(avg(chars), 6) as avg_chars, count(*) filter (n < 50) as short_chunks, count(*) filter (n > 500) as long_chunks from st group by doc_id")
def a01(spark, d):
    n = F.col("word_count")
    return _chunks(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(n), 6).alias("avg_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.round(F.avg("char_count"), 6).alias("avg_chars"), F.count_if(n < 50).alias("short_chunks"), F.count_if(n > 500).alias("long_chunks"))


@query("a02_quality_score", f"select doc_id, case when len({_W}) = 0 then 0.0::double else round(greatest(0, 1 - len(list_filter({_W}, lambda w: length(w) > 15))::double / len({_W})), 9) end as score from documents")
def a02(spark, d):
    return docs_of(spark, d).select("doc_id", F.round(T.quality_score(F.col("text")), 9).alias("score"))


@query("a03_corpus_quality", f"with {_CHUNKS} select round(avg(1 - longs::double / n), 9) as mean_score, count(*) filter (1 - longs::double / n < 0.8) as poor from st")
def a03(spark, d):
    s = T.quality_score(F.col("text"))
    return _chunks(spark, d).agg(F.round(F.avg(s), 9).alias("mean_score"), F.count_if(s < 0.8).alias("poor"))


@query("a04_corpus_statistics", f"with {_CHUNKS} select count(distinct doc_id) as documents, count(*) as chunks, sum(n)::bigint as words, sum(chars)::bigint as chars, round(avg(n), 6) as avg_words, count(*) filter (longs > 0) as with_long_words from st")
def a04(spark, d):
    return _chunks(spark, d).agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), F.round(F.avg("word_count"), 6).alias("avg_words"), F.count_if(T.long_words(F.col("text")) > 0).alias("with_long_words"))


@query("a05_document_statistics", f"select count(*) as documents, sum(len({_W}))::bigint as words, (sum(len({_W})) // count(*))::bigint as words_per_document, (select doc_id from documents order by len({_W}) desc, doc_id limit 1) as largest from documents")
def a05(spark, d):
    rows = docs_of(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words"), F.expr("sum(n) div count(*)").alias("words_per_document"), F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("largest"))


_CODED = _SCR + r", c as (select *, regexp_extract(symptom, '[A-Z]+-\d+') as code from scr)"


@query("a06_scr_statistics", _CODED + " select count(*) as triplets, count(distinct equipment) as equipments, count(distinct code) as codes, count(distinct split_part(code, '-', 1)) as prefixes, count(distinct page) as pages, min(page) as first_page, max(page) as last_page, round(count(*)::double / count(distinct page), 9) as per_page, round(avg(length(cause)), 9) as cause_length, round(avg(length(remedy)), 9) as remedy_length from c")
def a06(spark, d):
    code = T.first_code(F.col("symptom"))
    n = F.count_distinct
    return scr(spark, d).agg(F.count(F.lit(1)).alias("triplets"), n("equipment").alias("equipments"), n(code).alias("codes"), n(T.code_prefix(code)).alias("prefixes"), n("page").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.round(F.count(F.lit(1)) / n("page"), 9).alias("per_page"), F.round(F.avg(F.length("cause")), 9).alias("cause_length"), F.round(F.avg(F.length("remedy")), 9).alias("remedy_length"))


@query("a07_top_prefixes", _CODED + " select split_part(code, '-', 1) as prefix, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 9) as percent from c group by 1 order by n desc, prefix limit 10")
def a07(spark, d):
    rows = scr(spark, d).groupBy(T.code_prefix(T.first_code(F.col("symptom"))).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("prefix", "n", F.round(100.0 * F.col("n") / F.col("total"), 9).alias("percent")).orderBy(F.col("n").desc(), "prefix").limit(10)


_JUDGED = "case when row_no % 5 = 0 then 'no verdict' else 'My scores: {\"score_classic\": ' || (row_no % 6) || ', \"score_dense\": ' || (row_no % 4 + 1) || ', \"score_sparse\": ' || (row_no % 3) || '.5}' end"


@query("a09_judge_scores", _SCR + ", s as (select row_no as answer_set, unnest(['classic', 'dense', 'sparse', 'dense_sc']) as system, unnest(case when row_no % 5 = 0 then [2.5, 2.5, 2.5, 2.5] else [(row_no % 6)::double, (row_no % 4 + 1)::double, row_no % 3 + 0.5, 2.5] end)::double as score from scr) select answer_set, system, score, row_number() over (partition by answer_set order by score desc, system) as rank from s")
def a09(spark, d):
    """Four scores of a judge's replies, compared: parsed from prose, 2.5 where they cannot be read."""
    replies = scr(spark, d).select(F.col("row_no").alias("answer_set"), F.expr(_JUDGED).alias("reply"))
    return context.score_comparison(context.verdict(replies))


# -- extraction ------------------------------------------------------------------------------------------------------

_WINDOWS = _MANUAL + r""", parts as (select document_id, string_split(regexp_replace(text, '([A-Z]+-\d+)', chr(1) || '\1', 'g'), chr(1)) as p from manual),
    win as (select document_id, k::bigint as window_no, p[k + 1] as w, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0)::bigint as position from parts, unnest(range(1, len(p))) as t(k))"""
_FOUND = _WINDOWS + r""", tr as (select document_id, window_no, position, regexp_extract(w, '[A-Z]+-\d+') as code, trim(regexp_extract(w, '(?is)^(.*?)\s*Cause:', 1)) as symptom, trim(regexp_extract(w, '(?is)Cause:\s*(.*?)(?:Remedy:|$)', 1)) as cause, trim(regexp_extract(w, '(?is)Remedy:\s*(.*?)(?:\n\n|\d+\.\d+|$)', 1)) as remedy from win where regexp_matches(w, '(?i)Cause:') and regexp_matches(w, '(?i)Remedy:'))"""


@query("e01_triplets", _FOUND + " select * from tr where length(cause) > 10 and length(remedy) > 10")
def e01(spark, d):
    return extraction.triplets(manuals(spark, d))


@query("e02_page_of_offset", _FOUND + ", pg as (select document_id, k + 1 as page, 500 * k as start from manual, unnest(range(0, 200)) as t(k) where 500 * k <= length(text)) select document_id, window_no, (select max(page) from pg where pg.document_id = tr.document_id and start <= position)::bigint as page from tr where length(cause) > 10 and length(remedy) > 10")
def e02(spark, d):
    m = manuals(spark, d)
    pages = m.select("document_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int"))).alias("k")).select("document_id", (F.col("k") + 1).cast("long").alias("page"), (500 * F.col("k")).cast("long").alias("start"))
    return extraction.with_page(extraction.triplets(m), pages).select("document_id", "window_no", "page")


@query("e04_detection", _FOUND + " select (select count(*) from tr) as triplets, (select count(*) from win) as codes, round(100.0::double * (select count(*) from tr) / (select count(*) from win), 6) as rate")
def e04(spark, d):
    m = manuals(spark, d)
    n = extraction.code_windows(m).agg(F.count(F.lit(1)).alias("codes"))
    return extraction.triplets(m).agg(F.count(F.lit(1)).alias("triplets")).crossJoin(n).select("triplets", "codes", F.round(F.when(F.col("codes") > 0, 100.0 * F.col("triplets") / F.col("codes")).otherwise(0.0), 6).alias("rate"))


@query("s06_triplet_clean", _SCR + ", u as (select * from scr union all select row_no + 1000000, symptom, cause, case when row_no % 3 = 0 then 'None' when row_no % 3 = 1 then remedy end, equipment, page from scr) select row_no, symptom, cause, remedy, equipment, page from (select *, row_number() over (partition by symptom, cause, remedy, equipment order by row_no) as nth from u where remedy is not null and remedy <> 'None') where nth = 1")
def s06(spark, d):
    r = scr(spark, d)
    more = r.select((F.col("row_no") + 1000000).alias("row_no"), "symptom", "cause", F.when(F.col("row_no") % 3 == 0, "None").when(F.col("row_no") % 3 == 1, F.col("remedy")).alias("remedy"), "equipment", "page")
    return extraction.clean_triplet_rows(r.union(more))


# -- search and fusion -----------------------------------------------------------------------------------------------

def bm25_sql(key: str, text: str, source: str, queries: str, k: int, out: str = "bm") -> str:
    """Table expressions that end in ``out`` (query_id, key, score, rank): the k best rows of source for each query."""
    return (
        f"tk as (select {key}, {terms_sql(text)} as ts from {source}), tot as (select count(*) as nd, avg(len(ts)) as ml from tk), pst as (select {key}, term, count(*) as tf, any_value(len) as len from (select {key}, len(ts) as len, unnest(ts) as term from tk) group by 1, 2), df as (select term, count(*) as df from pst group by 1), "
        f"qt as (select query_id, unnest(list_distinct({terms_sql('text')})) as term from {queries}), sc as (select query_id, {key}, round(sum((ln(nd / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / ml))), 9) as score, count(*) as found from pst join qt using (term) join df using (term), tot group by 1, 2), "
        f"{out} as (select * from (select query_id, {key}, score, row_number() over (partition by query_id order by score desc, {key}) as rank from sc) where rank <= {k})"
    )


_BM25 = f"with {_ASKED}, " + bm25_sql("doc_id", "text", "documents", "asked", 10)


@query("i01_postings", f"with tk as materialized (select doc_id, {terms_sql('text')} as ts from documents) select doc_id, term, count(*) as tf, any_value(n)::bigint as length from (select doc_id, len(ts) as n, unnest(ts) as term from tk) group by doc_id, term")
def i01(spark, d):
    return search.postings(docs_of(spark, d)).select("doc_id", "term", "tf", "length")


@query("i05_valid_vectors", "select count(*) as n, min(len(embedding))::bigint as dim, round(min(x), 6) as min_norm, round(max(x), 6) as max_norm, round(avg(x), 6) as mean_norm from (select embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) as x from embeddings)")
def i05(spark, d):
    x = embedding.norm(F.col("embedding"))
    return search.valid_vectors(table(spark, d, "embeddings")).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"), F.round(F.min(x), 6).alias("min_norm"), F.round(F.max(x), 6).alias("max_norm"), F.round(F.avg(x), 6).alias("mean_norm"))


@query("i08_index_kind", "select count(*) as n, case when count(*) < 1000 then 'flat' when count(*) < 10000 then 'hnsw' else 'ivf' end as kind from documents")
def i08(spark, d):
    return docs_of(spark, d).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", search.index_kind(F.col("n")))


@query("q01_bm25", _BM25 + " select query_id, doc_id, score, rank from bm")
def q01(spark, d):
    return search.bm25(asked(spark, d), docs_of(spark, d))


_COS = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda v: v::double * v::double))) * sqrt(list_sum(list_transform(b.embedding, lambda v: v::double * v::double)))), 9)"


@query("q02_vectors", f"select * from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select a.vec_id as query_id, b.vec_id, {_COS} as score from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rank <= 10")
def q02(spark, d):
    e = table(spark, d, "embeddings")
    return search.vector_search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), e)


@query("q03_similar_to_stored", f"select * from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select a.vec_id as query_id, b.vec_id, {_COS} as score from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id <> a.vec_id)) where rank <= 5")
def q03(spark, d):
    e = table(spark, d, "embeddings")
    return search.similar_to_each(e.where("vec_id % 20 = 0"), e)


@query("q06_levenshtein", _SCR + r", k as (select distinct symptom, regexp_extract(symptom, '[A-Z]{3,5}-\d{3,4}') as code from scr), q as (select row_no as query_id, regexp_extract(symptom, '[A-Z]{3,5}-\d{3,4}') as asked from scr where row_no % 20 = 0) select * from (select query_id, symptom, 1 - d / 3.0::double as score, row_number() over (partition by query_id order by d, symptom) as rank from (select query_id, symptom, levenshtein(code, asked) as d from k, q where code <> '' and asked <> '') where d <= 3) where rank <= 5")
def q06(spark, d):
    r = scr(spark, d)
    return search.levenshtein_search(r.where("row_no % 20 = 0").select(F.col("row_no").alias("query_id"), F.col("symptom").alias("text")), r.select("symptom"))


_TURNED = "array_to_string(list_reverse(string_split(lower(n_name), ' ')), ' ')"


@query("q12_equipment", f"with a as (select s_suppkey as query_id, case s_suppkey % 4 when 0 then lower(n_name) when 1 then 'the ' || n_name || ' plant' when 2 then {_TURNED} else '' end as a from supplier join nation on n_nationkey = s_nationkey), k as (select n_nationkey as list_no, n_name as name, lower(n_name) as b from nation), s as (select query_id, list_no, name, case when lower(a) = b then 1 when contains(lower(a), b) or contains(b, lower(a)) then 2 when list_sort(string_split(lower(a), ' ')) = list_sort(string_split(b, ' ')) then 3 end as stage from a, k where a <> ''), f as (select query_id, name, stage, row_number() over (partition by query_id order by stage, list_no) as nth from s where stage is not null) select a.query_id, name as matched, stage::bigint as stage from a left join f on a.query_id = f.query_id and nth = 1")
def q12(spark, d):
    """Names as they are, inside others, with their words turned round (found by vectors), and blank."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("list_no"), F.col("n_name").alias("name"))
    both = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("list_no"))
    turned = F.array_join(F.reverse(F.split(F.lower("name"), " ")), " ")
    k = F.col("s_suppkey") % 4
    ask = both.select(F.col("s_suppkey").alias("query_id"), F.when(k == 0, F.lower("name")).when(k == 1, F.concat(F.lit("the "), "name", F.lit(" plant"))).when(k == 2, turned).otherwise("").alias("equipment"))
    return search.match_equipment(ask, n)


@query("q14_equipments", _SCR + " select distinct equipment from scr where equipment <> ''")
def q14(spark, d):
    return scr(spark, d).where("equipment <> ''").select("equipment").distinct().orderBy("equipment")


_NORMAL = ", nm as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as normal from bm window w as (partition by query_id))"
_VEC = f", vec as (select * from (select query_id, vec_id as doc_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select a.vec_id as query_id, b.vec_id, {_COS} as score from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rank <= 10), vn as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as normal from vec window w as (partition by query_id))"
_FUSED = ", fu as (select * from (select query_id, doc_id, fused, source, row_number() over (partition by query_id order by fused desc, doc_id) as rank from (select query_id, doc_id, round(0.5 * coalesce(nm.normal, 0) + 0.5 * coalesce(vn.normal, 0), 9) as fused, case when nm.score is not null and vn.score is not null then 'Mixed' when nm.score is not null then 'Lexical' else 'Semantic' end as source from nm full join vn using (query_id, doc_id))) where rank <= 10)"


def _vectors_as_docs(spark, d):
    """Vector hits; a vector's id stands for the document of the same id."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.vector_search(e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector")), e, key="doc_id")


@query("f01_min_max", _BM25 + _NORMAL + " select query_id, doc_id, round(normal, 9) as normal from nm")
def f01(spark, d):
    return fusion.min_max(q01(spark, d)).select("query_id", "doc_id", F.round("normal", 9).alias("normal"))


@query("f02_weighted_fusion", _BM25 + _NORMAL + _VEC + _FUSED + " select * from fu")
def f02(spark, d):
    return fusion.weighted(q01(spark, d), _vectors_as_docs(spark, d), "doc_id")


@query("f04_reciprocal_rank", _BM25 + _VEC + " select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select query_id, doc_id, rank from bm union all select query_id, doc_id, rank from vec) group by 1, 2)) where rank <= 10")
def f04(spark, d):
    return fusion.reciprocal_rank([q01(spark, d), _vectors_as_docs(spark, d)], "doc_id")


@query("f05_distinct_content", "select doc_id from (select doc_id, row_number() over (partition by md5(trim(text)) order by doc_id) as nth from documents where trim(text) <> '') where nth = 1")
def f05(spark, d):
    return fusion.distinct_content(docs_of(spark, d), "doc_id").select("doc_id")


_RERANK = f", cand as (select query_id, doc_id, rank, q.text as query, d.text as text from fu join asked q using (query_id) join documents d using (doc_id) where trim(d.text) <> ''), cut as (select *, case when length(query) + length(text) > 502 then left(text, greatest(0, 502 - length(query))) else text end as t from cand), rr as (select query_id, doc_id, rank as original_rank, round(len(list_intersect(list_distinct({terms_sql('query')}), list_distinct({terms_sql('t')})))::double / greatest(len(list_distinct({terms_sql('query')})), 1) - length(t)::double / (length(t) + 1000000), 9) as rerank_score from cut), top as (select * from (select *, row_number() over (partition by query_id order by rerank_score desc, original_rank, doc_id) as rank from rr) where rank <= 5)"


def _candidates(spark, d):
    fused = f02(spark, d)
    q = asked(spark, d).select("query_id", F.col("text").alias("query"))
    return fused.join(q, "query_id").join(docs_of(spark, d).select("doc_id", "text"), "doc_id").select("query_id", "query", "doc_id", "text", "rank")


@query("flagship_hybrid", _BM25 + _NORMAL + _VEC + _FUSED + _RERANK + " select query_id, doc_id, original_rank, rerank_score, rank from top")
def flagship(spark, d):
    """Hybrid retrieval: BM25 and vectors, fused, reranked."""
    return fusion.rerank(_candidates(spark, d)).select("query_id", "doc_id", "original_rank", "rerank_score", "rank")


@query("r01_budget", _BM25 + f", t as (select query_id, rank, doc_id, sum(floor(len({_W}) * 0.75)) over (partition by query_id order by rank) as tokens from bm join documents using (doc_id)) select query_id, doc_id, tokens::bigint as tokens from t where rank <= 3 and tokens <= 6000")
def r01(spark, d):
    rows = q01(spark, d).join(docs_of(spark, d).select("doc_id", "text"), "doc_id")
    return context.within_budget(rows).select("query_id", "doc_id", "tokens")


@query("r02_relevance", _BM25 + ", s as (select query_id, 1 / (1 + exp(-(score - 8))) as p from bm) select query_id, count(*) filter (p >= 0.7) as relevant_count, count(*) as total_count, round(max(p), 9) as max_score, round(avg(p), 9) as avg_score, count(*) filter (p >= 0.7) > 0 as is_relevant from s group by query_id")
def r02(spark, d):
    return context.document_relevance(q01(spark, d).withColumn("score", F.col("score") - 8))


@query("r05_strategy", "select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then 'HYBRID' when o_orderkey % 2 = 0 then 'DOC_ONLY' when o_orderkey % 3 = 0 then 'KG_ONLY' else 'NO_CONTEXT' end as strategy from orders")
def r05(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", context.strategy(k % 2 == 0, k % 3 == 0).alias("strategy"))


# -- graph -----------------------------------------------------------------------------------------------------------

_CAUSES = ", ca as (select distinct symptom, cause from scr), tr as (select distinct cause, remedy from scr), eq as (select symptom, arg_max(equipment, row_no) as equipment from scr group by symptom), paths as (select symptom, cause, remedy, equipment from ca join tr using (cause) join eq using (symptom))"


@query("g01_sparse_nodes", _SCR + " select 'symptom' as label, symptom as name, equipment, row_no as triplet_id from scr union all select 'cause', cause, equipment, row_no from scr union all select 'remedy', remedy, equipment, row_no from scr")
def g01(spark, d):
    return graph.sparse(scr(spark, d))


@query("g02_dense_nodes", _SCR + ", n as (select 'symptom' as label, symptom as name, equipment, row_no from scr union all select 'cause', cause, equipment, row_no from scr union all select 'remedy', remedy, equipment, row_no from scr) select label, name, arg_max(equipment, row_no) as equipment from n group by 1, 2")
def g02(spark, d):
    return graph.nodes(scr(spark, d))


@query("g02_dense_edges", _SCR + " select distinct 'CAUSES' as relation, symptom as src, cause as dst from scr union select distinct 'TREATED_BY', cause, remedy from scr")
def g02e(spark, d):
    return graph.edges(scr(spark, d))


@query("g03_combined_text", _SCR + " select symptom, arg_max(symptom || ' ' || cause, row_no) as combined_text from scr group by symptom")
def g03(spark, d):
    return graph.with_combined_text(scr(spark, d))


_TOK = r"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(symptom), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+'), lambda w: w <> '')))"
_SIM = _SCR + rf""", s as (select distinct symptom, {_TOK} as t, regexp_extract(upper(symptom), '[A-Z]{{3,5}}-\d{{3,4}}') as code from scr),
    pr as (select a.symptom as src, b.symptom as dst, len(list_intersect(a.t, b.t)) as i, len(a.t) as na, len(b.t) as nb, case when a.code <> '' and b.code <> '' and levenshtein(a.code, b.code) <= 3 then 1 - levenshtein(a.code, b.code) / 3.0::double else 0 end as lev from s a join s b on a.symptom <> b.symptom and (a.t = b.t or levenshtein(a.code, b.code) <= 2)),
    sc as (select src, dst, round(0.4 * i / sqrt((na * nb)::double) + 0.4 * i / (na + nb - i) + 0.2 * lev, 9) as score from pr),
    sim as (select src, dst, score from (select *, row_number() over (partition by src order by score desc, dst) as nth from sc where score >= 0.8) where nth <= 5)"""


@query("g09_similarity_edges", _SIM + " select src, dst, score from sim")
def g09(spark, d):
    return graph.similarity_edges(scr(spark, d).select("symptom"))


@query("g10_propagated_causes", _SIM + " select symptom, cause from scr union select dst, cause from sim join scr on src = symptom")
def g10(spark, d):
    return graph.propagate(scr(spark, d), g09(spark, d))


@query("g05_jaccard_benchmark", r"with s as (select item_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+'), lambda w: w <> '')) as t from benchmark) select a.item_id as a, b.item_id as b, round(len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) as jaccard from s a join s b on a.item_id < b.item_id")
def g05(spark, d):
    """All pairs, as the operator is defined: over the fixed benchmark only."""
    s = table(spark, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("t"))
    both = s.select(F.col("item_id").alias("a"), F.col("t").alias("ta")).join(s.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), F.col("a") < F.col("b"))
    return both.select("a", "b", F.round(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")), 9).alias("jaccard"))


def _causes(spark, d):
    return scr(spark, d).select("symptom", "cause").distinct()


@query("h01_paths", _SCR + _CAUSES + " select * from paths")
def h01(spark, d):
    return graph.expand(_causes(spark, d), scr(spark, d))


@query("h02_paths_of_equipment", _SCR + _CAUSES + " select * from paths where equipment = 'EQ-2'")
def h02(spark, d):
    return h01(spark, d).where("equipment = 'EQ-2'")


@query("h03_sparse_triplets", _SCR + " select row_no as triplet_id, symptom, cause, remedy, equipment from scr where equipment = 'EQ-1'")
def h03(spark, d):
    n = graph.sparse(scr(spark, d)).where("equipment = 'EQ-1'")
    one = lambda label: n.where(F.col("label") == label).select("triplet_id", F.col("name").alias(label), *(["equipment"] if label == "symptom" else []))
    return one("symptom").join(one("cause"), "triplet_id").join(one("remedy"), "triplet_id").select("triplet_id", "symptom", "cause", "remedy", "equipment")


@query("h10_counts", _SCR + " select 'symptom' as what, count(distinct symptom) as n from scr union all select 'cause', count(distinct cause) from scr union all select 'remedy', count(distinct remedy) from scr union all select 'CAUSES', count(*) from (select distinct symptom, cause from scr) union all select 'TREATED_BY', count(*) from (select distinct cause, remedy from scr)")
def h10(spark, d):
    r = scr(spark, d)
    return graph.nodes(r).groupBy(F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("n")).union(graph.edges(r).groupBy("relation").agg(F.count(F.lit(1))))


@query("h11_filtered_stats", _SCR + _CAUSES + " select count(distinct e.symptom) as symptoms, count(distinct c.cause) as causes, count(distinct t.remedy) as remedies from eq e left join ca c using (symptom) left join tr t using (cause) where e.equipment = 'EQ-3'")
def h11(spark, d):
    r = scr(spark, d)
    s = graph.nodes(r).where("label = 'symptom' and equipment = 'EQ-3'").select(F.col("name").alias("symptom"))
    return s.join(_causes(spark, d), "symptom", "left").join(r.select("cause", "remedy").distinct(), "cause", "left").agg(F.count_distinct("symptom").alias("symptoms"), F.count_distinct("cause").alias("causes"), F.count_distinct("remedy").alias("remedies"))


@query("h12_equipment_distribution", _SCR + _CAUSES + " select equipment, count(*) as symptoms from eq group by 1")
def h12(spark, d):
    return graph.nodes(scr(spark, d)).where("label = 'symptom'").groupBy("equipment").agg(F.count(F.lit(1)).alias("symptoms")).orderBy(F.col("symptoms").desc(), "equipment")


@query("h13_densification", _SIM + ", pc as (select symptom, cause from scr union select dst, cause from sim join scr on src = symptom), n as (select symptom, count(*) as n from pc group by 1) select count(*) as symptoms, round(avg(n), 9) as mean_causes, max(n) as most_causes from n where n > 1")
def h13(spark, d):
    n = g10(spark, d).groupBy("symptom").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("symptoms"), F.round(F.avg("n"), 9).alias("mean_causes"), F.max("n").alias("most_causes"))


@query("h14_one_to_one", _SCR + _CAUSES + ", n as (select symptom, count(distinct cause) as c, count(distinct remedy) as r from paths group by 1) select round(avg(c), 9) as causes, round(avg(r), 9) as remedies, abs(avg(c) - 1) <= 0.1 and abs(avg(r) - 1) <= 0.1 as one_to_one from n")
def h14(spark, d):
    n = h01(spark, d).groupBy("symptom").agg(F.count_distinct("cause").alias("c"), F.count_distinct("remedy").alias("r"))
    a = n.agg(F.avg("c").alias("c"), F.avg("r").alias("r"))
    return a.select(F.round("c", 9).alias("causes"), F.round("r", 9).alias("remedies"), ((F.abs(F.col("c") - 1) <= 0.1) & (F.abs(F.col("r") - 1) <= 0.1)).alias("one_to_one"))


@query("h15_orphans", _SCR + ", n as (select distinct 'symptom' as label, symptom as name from scr union select distinct 'cause', cause from scr union select distinct 'remedy', remedy from scr), kept as (select * from scr where row_no % 7 <> 0), e as (select symptom as name from kept union select cause from kept union select remedy from kept) select label, name from n where name not in (select name from e)")
def h15(spark, d):
    """Nodes that no relationship touches, after every seventh triplet's relationships are gone."""
    r = scr(spark, d)
    return graph.orphans(graph.nodes(r), graph.edges(r.where("row_no % 7 <> 0"))).select("label", "name")


@query("h16_remedy_sharing", _SCR + _CAUSES + ", sh as (select a.symptom as s1, b.symptom as s2, cause, remedy from paths a join paths b using (cause, remedy) where a.symptom <> b.symptom) select count(distinct remedy) as remedies, count(distinct cause) as causes, count(distinct (s1, s2)) as pairs from sh")
def h16(spark, d):
    return graph.relation_sharing(scr(spark, d))


@query("h08_context", _SCR + " select equipment as query_id, string_agg(symptom || ' → ' || cause || ' → ' || remedy, chr(10) order by row_no) as context from scr group by equipment")
def h08(spark, d):
    rows = scr(spark, d).select(F.col("equipment").alias("query_id"), F.col("row_no").alias("rank"), "symptom", "cause", "remedy")
    return context.graph_context(rows)


@query("h20_verify", _SCR + _CAUSES + " select (select count(*) from eq) as symptoms, (select count(distinct cause) from scr) as causes, (select count(distinct remedy) from scr) as remedies, (select count(*) from ca) + (select count(*) from tr) as relations, (select count(distinct equipment) from eq) as equipments")
def h20(spark, d):
    r = scr(spark, d)
    n = graph.nodes(r)
    of = lambda label: F.count_if(F.col("label") == label)
    counts = n.agg(of("symptom").alias("symptoms"), of("cause").alias("causes"), of("remedy").alias("remedies"), F.count_distinct(F.when(F.col("label") == "symptom", F.col("equipment"))).alias("equipments"))
    return counts.crossJoin(graph.edges(r).agg(F.count(F.lit(1)).alias("relations"))).select("symptoms", "causes", "remedies", "relations", "equipments")


@query("q11_max_fusion", _SCR + ", v as (select page as query_id, row_no % 3 as variant, symptom, (row_no % 17) / 17.0::double as score from scr) select * from (select query_id, symptom, score, row_number() over (partition by query_id order by score desc, symptom) as rank from (select query_id, symptom, round(max(score * case when variant = 0 then 1.0 else 0.8 end), 9) as score from v group by 1, 2)) where rank <= 3")
def q11(spark, d):
    v = scr(spark, d).select(F.col("page").alias("query_id"), (F.col("row_no") % 3).alias("variant"), "symptom", ((F.col("row_no") % 17) / 17.0).alias("score"))
    return search.max_fusion(v)


_REWRITTEN = _SCR + r", w as (select row_no as query_id, array_to_string(regexp_extract_all(upper(symptom), '\b[A-Z]{3,5}-\d{3,4}\b'), ' ') as codes, array_to_string(" + terms_sql("symptom") + ", ' ') as terms from scr)"


@query("u01_rewrite", _REWRITTEN + " select query_id, trim(concat_ws(' ', codes, terms)) as filtered_query, array_to_string(list_filter([terms, codes], lambda v: v <> ''), '|') as variants from w")
def u01(spark, d):
    rows = context.rewrite_query(scr(spark, d).select(F.col("row_no").alias("query_id"), F.col("symptom").alias("text")))
    return rows.withColumn("variants", F.array_join("variants", "|"))
