"""Queries on symptom indexes, equipment, scored triplets, graph statistics and evaluation, next to their SQL.

Searches ask with every row whose number is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, embedding, extraction, graph, search
from .registry import _CAUSES, _FOUND, _MANUAL, _SCR, _SIM, bm25_sql, docs_of, h01, manuals, query, scr, table, terms_sql

_N = embedding.DIMENSION


def _places(column: str) -> str:
    return f"list_transform({terms_sql(column)}, lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % {_N})"


def vectors_sql(key: str, text: str, source: str, out: str) -> str:
    """Table expressions that end in ``out`` (key, v): counts of hashed terms."""
    return f"{out}_b as (select {key}, {_places(text)} as b from {source}), {out} as (select {key}, list_transform(range({_N}), lambda i: len(list_filter(b, lambda x: x = i))::double) as v from {out}_b)"


def near_sql(queries: str, rows: str, key: str, k: int, least: float, out: str) -> str:
    """``out`` (query_id, key, score, rank): the k best rows by cosine above a threshold."""
    cosine = "coalesce(round(list_inner_product(q.v, r.v) / nullif(sqrt(list_inner_product(q.v, q.v) * list_inner_product(r.v, r.v)), 0), 9), 0)"
    return f"{out} as (select * from (select query_id, {key}, score, row_number() over (partition by query_id order by score desc, {key}) as rank from (select query_id, {key}, {cosine} as score from {queries} q, {rows} r) where score >= {least}) where rank <= {k})"


_ASK = _SCR + ", sy as (select distinct symptom from scr), q as (select row_no as query_id, symptom as text from scr where row_no % 20 = 0), " + vectors_sql("query_id", "text", "q", "qv") + ", " + vectors_sql("symptom", "symptom", "sy", "sv")


def symptoms(spark, d):
    return scr(spark, d).select("symptom").distinct()


def symptom_queries(spark, d):
    return scr(spark, d).where(F.col("row_no") % 20 == 0).select(F.col("row_no").alias("query_id"), F.col("symptom").alias("text"))


@query("i02_index_metadata", r"select source as document_id, count(*) as chunks, sum(len(w))::bigint as words, round(avg(case when len(w) = 0 then 0 else 1 - len(list_filter(w, lambda x: length(x) > 15))::double / len(w) end), 9) as mean_quality from (select source, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') as w from documents) group by 1")
def i02(spark, d):
    return docs_of(spark, d).groupBy(F.col("source").alias("document_id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.word_count(F.col("text"))).cast("long").alias("words"), F.round(F.avg(T.quality_score(F.col("text"))), 9).alias("mean_quality"))


@query("i03_symptom_postings", _SCR + f", s as (select distinct symptom from scr), t as (select symptom, unnest({terms_sql('symptom')}) as term from s) select symptom, term, count(*) as tf from t group by 1, 2")
def i03(spark, d):
    return search.postings(symptoms(spark, d), "symptom", "symptom").select("symptom", "term", "tf")


@query("i04_embedded_texts", _ASK + f" select symptom, i::bigint as place, round(v[i + 1] / sqrt(list_inner_product(v, v)), 9) as weight, {_N}::bigint as dim from (select symptom, v, unnest(range({_N})) as i from sv) where v[i + 1] > 0")
def i04(spark, d):
    rows = embedding.embedded(symptoms(spark, d), F.col("symptom"))
    return rows.select("symptom", "dim", F.posexplode("embedding").alias("place", "weight")).where("weight > 0").select("symptom", F.col("place").cast("long").alias("place"), F.round("weight", 9).alias("weight"), "dim")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double)))"


@query("i05_vector_statistics", f"select count(*) as n, count(distinct len(embedding)) as dims, round(min(x), 6) as min_norm, round(max(x), 6) as max_norm, round(avg(x), 6) as mean_norm, round(stddev_pop(x), 6) as std_norm from (select embedding, {_NORM} as x from embeddings)")
def i05s(spark, d):
    return embedding.statistics(search.valid_vectors(table(spark, d, "embeddings")))


@query("i06_embedding_quality", f"with p as (select text, len({terms_sql('text')}) as n from benchmark) select count(*) as n, count(*) filter (n = 0) as zero_norms, count(*) filter (trim(coalesce(text, '')) = '') as blank_texts, round(avg(case when n > 0 then 1.0 else 0.0 end), 6) as mean_norm from p")
def i06(spark, d):
    return embedding.quality(embedding.embedded(table(spark, d, "benchmark").select("text"), F.col("text")))


_TEXTS = _SCR + ", cx as (select symptom, arg_max(symptom || ' ' || cause, row_no) as combined_text from scr group by symptom)"


@query("i09_symptom_vectors", _TEXTS + f" select symptom, combined_text, len({terms_sql('combined_text')})::bigint as terms, {_N}::bigint as dim, 1.0::double as norm from cx")
def i09(spark, d):
    rows = embedding.embedded(graph.with_combined_text(scr(spark, d)), F.col("combined_text"))
    return rows.select("symptom", "combined_text", F.size(T.analyzed(F.col("combined_text"))).cast("long").alias("terms"), "dim", F.round("norm", 9).alias("norm"))


_LEX = bm25_sql("symptom", "symptom", "sy", "q", 6)


@query("q04_symptom_bm25", _ASK + ", " + bm25_sql("symptom", "symptom", "sy", "q", 5) + " select * from bm")
def q04(spark, d):
    return search.bm25(symptom_queries(spark, d), symptoms(spark, d).withColumn("text", F.col("symptom")), 5, key="symptom", clean=T.clean_symptom_query)


@query("q01_bm25_all_terms", _ASK + ", " + bm25_sql("symptom", "symptom", "sy", "q", 10) + ", nt as (select query_id, count(*) as n from qt group by 1) select * from (select query_id, symptom, score, row_number() over (partition by query_id order by score desc, symptom) as rank from (select query_id, symptom, score from sc join nt using (query_id) where found = n)) where rank <= 10")
def q01_all(spark, d):
    return search.bm25(symptom_queries(spark, d), symptoms(spark, d).withColumn("text", F.col("symptom")), key="symptom", mode="and")


@query("q05_symptom_vectors", _ASK + ", " + near_sql("qv", "sv", "symptom", 5, -1, "nr") + " select * from nr")
def q05(spark, d):
    return search.vector_search(embedding.embedded_queries(symptom_queries(spark, d)), embedding.embedded(symptoms(spark, d), F.col("symptom")), 5, key="symptom")


_HYBRID = _ASK + ", " + _LEX + ", " + near_sql("qv", "sv", "symptom", 6, -1, "nr") + r""", cd as (select symptom, regexp_extract(symptom, '[A-Z]{3,5}-\d{3,4}') as code from sy), qc as (select query_id, regexp_extract(text, '[A-Z]{3,5}-\d{3,4}') as code from q),
    lv as (select * from (select query_id, symptom, 1 - dist / 3.0::double as score, row_number() over (partition by query_id order by dist, symptom) as rank from (select query_id, symptom, levenshtein(cd.code, qc.code) as dist from cd, qc where cd.code <> '' and qc.code <> '') where dist <= 3) where rank <= 3),
    al as (select query_id, symptom, 0.4 * score / max(score) over (partition by query_id) as s from bm union all select query_id, symptom, 0.4 * case when m > 0 then score / m else 0 end from (select *, max(score) over (partition by query_id) as m from nr) union all select query_id, symptom, 0.2 * score from lv),
    hy as (select * from (select query_id, symptom, score, row_number() over (partition by query_id order by score desc, symptom) as rank from (select query_id, symptom, round(sum(s), 9) as score from al group by 1, 2)) where rank <= 3)"""


@query("q07_hybrid_symptoms", _HYBRID + " select * from hy")
def q07(spark, d):
    return search.dense_symptoms(symptom_queries(spark, d), symptoms(spark, d))


@query("q08_dense_symptoms", _ASK + ", " + near_sql("qv", "sv", "symptom", 3, 0.8, "nr") + " select * from nr")
def q08(spark, d):
    return search.dense_symptoms(symptom_queries(spark, d), symptoms(spark, d), hybrid=False)


_SPARSE = _ASK + ", rv_t as (select row_no as triplet_id, symptom from scr), rv as (select triplet_id, v from rv_t join sv using (symptom)), " + near_sql("qv", "rv", "triplet_id", 3, 0.8, "nr")


@query("q09_sparse_symptoms", _SPARSE + " select query_id, triplet_id, symptom, equipment, score, rank from nr join scr on row_no = triplet_id")
def q09(spark, d):
    rows = scr(spark, d).select(F.col("row_no").alias("triplet_id"), "symptom", "cause", "remedy", "equipment")
    return search.threshold_symptoms(symptom_queries(spark, d), rows, "triplet_id", "symptom").select("query_id", "triplet_id", "symptom", "equipment", "score", "rank")


@query("q10_combined_symptoms", _ASK + ", cx as (select symptom, arg_max(symptom || ' ' || cause, row_no) as combined_text from scr group by symptom), " + vectors_sql("symptom", "combined_text", "cx", "cv") + ", " + near_sql("qv", "cv", "symptom", 3, 0.8, "nr") + " select query_id, symptom, combined_text, score, rank from nr join cx using (symptom)")
def q10(spark, d):
    return search.threshold_symptoms(symptom_queries(spark, d), graph.with_combined_text(scr(spark, d)), "symptom", "combined_text").select("query_id", "symptom", "combined_text", "score", "rank")


_EQUIPMENT = "with nm as (select distinct p_brand || ' ' || p_type as name from part), q as (select p_partkey as query_id, p_type as text from part where p_partkey % 20 = 0), " + vectors_sql("query_id", "text", "q", "qv") + ", " + vectors_sql("name", "name", "nm", "nv") + ", " + near_sql("qv", "nv", "name", 3, -1, "nr")


@query("q13_top_equipment", _EQUIPMENT + " select * from nr where score >= 0.5")
def q13(spark, d):
    p = table(spark, d, "part")
    asked = p.where(F.col("p_partkey") % 20 == 0).select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("equipment"))
    return search.top_equipment(asked, p.select(F.concat_ws(" ", "p_brand", "p_type").alias("name")))


@query("q15_index_statistics", "select count(*) as chunks, count(distinct source) as documents, round(count(*)::double / count(distinct source), 9) as chunks_per_document from documents")
def q15(spark, d):
    n, m = F.count(F.lit(1)), F.count_distinct("source")
    return docs_of(spark, d).agg(n.alias("chunks"), m.alias("documents"), F.round(n / m, 9).alias("chunks_per_document"))


@query("x06_loose_codes", _SCR + r" select row_no, unnest(regexp_extract_all(symptom || ' ' || remedy, '[A-Z]+-\d+')) as code from scr")
def x06(spark, d):
    return scr(spark, d).select("row_no", F.explode(T.loose_codes(F.concat_ws(" ", "symptom", "remedy"))).alias("code"))


@query("x14_equipment_contains", _SCR + " select row_no, equipment from scr where contains(equipment, 'EQ-4')")
def x14(spark, d):
    return scr(spark, d).where(F.contains("equipment", F.lit("EQ-4"))).select("row_no", "equipment")


@query("x21_sigmoid", "select l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25))), 9) as p from lineitem")
def x21(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.sigmoid(F.col("l_quantity") - 25), 9).alias("p"))


@query("e05_extraction_summary", _FOUND + ", f as (select * from tr where length(cause) > 10 and length(remedy) > 10) select count(*) as triplets, count(distinct document_id) as pages, round(count(*)::double / count(distinct document_id), 9) as per_page, count(distinct code) as codes from f")
def e05(spark, d):
    n, m = F.count(F.lit(1)), F.count_distinct("document_id")
    return extraction.triplets(manuals(spark, d)).agg(n.alias("triplets"), m.alias("pages"), F.round(n / m, 9).alias("per_page"), F.count_distinct("code").alias("codes"))


@query("g06_code_similarity", _SCR + r", c as (select row_no, symptom, remedy, regexp_extract(symptom, '[A-Z]{3,5}-\d{3,4}') as a, regexp_extract(lead(symptom, 1, symptom) over (partition by page order by row_no), '[A-Z]{3,5}-\d{3,4}') as b from scr) select row_no, round(case when a <> '' and b <> '' and levenshtein(a, b) <= 3 then 1 - levenshtein(a, b) / 3.0::double else 0 end, 9) as similarity from c")
def g06(spark, d):
    """Each symptom's codes against those of the next on its page."""
    r = scr(spark, d)
    following = F.lead("symptom", 1).over(graph.Window.partitionBy("page").orderBy("row_no"))
    return r.select("row_no", F.round(graph.code_similarity(F.col("symptom"), F.coalesce(following, "symptom")), 9).alias("similarity"))


@query("g07_edge_statistics", _SIM + " select count(*) as edges, count(distinct src) as symptoms, round(avg(score), 6) as mean_score, max(score) as max_score from sim")
def g07(spark, d):
    n = graph.similarity_edges(symptoms(spark, d))
    return n.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("symptoms"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"))


@query("g12_dense_paths", _SIM + ", pc as (select symptom, cause from scr union select dst, cause from sim join scr on src = symptom), tr as (select distinct cause, remedy from scr), eq as (select symptom, arg_max(equipment, row_no) as equipment from scr group by symptom) select symptom, cause, remedy, equipment from pc join tr using (cause) join eq using (symptom)")
def g12(spark, d):
    """The merged graph as built: similarity edges, propagation, expansion."""
    return graph.build_dense(scr(spark, d))


@query("h04_combined_paths", _TEXTS + _CAUSES + " select symptom, cause, remedy, equipment, combined_text from paths join cx using (symptom)")
def h04(spark, d):
    return h01(spark, d).join(graph.with_combined_text(scr(spark, d)), "symptom")


_SCORED = _HYBRID + _CAUSES + ", tp as (select query_id, symptom, cause, remedy, equipment, score, row_number() over (partition by query_id order by score desc, rank, cause, remedy) as place from hy join paths using (symptom)), cut as (select * from tp where place <= 3)"


@query("h05_scored_triplets", _SCORED + " select query_id, place, symptom, cause, remedy, equipment, score from cut")
def h05(spark, d):
    return graph.collect_scored(q07(spark, d), graph.first_paths(scr(spark, d), scr(spark, d)))


@query("h06_scored_sparse_triplets", _SPARSE + " select query_id, rank as place, triplet_id, symptom, cause, remedy, equipment, score from nr join scr on row_no = triplet_id")
def h06(spark, d):
    rows = scr(spark, d).select(F.col("row_no").alias("triplet_id"), "symptom", "cause", "remedy", "equipment")
    return graph.collect_sparse(search.threshold_symptoms(symptom_queries(spark, d), rows, "triplet_id", "symptom"))


@query("h07_equipment_context", _HYBRID + _CAUSES + ", qe as (select row_no as query_id, equipment as e from scr where row_no % 20 = 0), tp as (select query_id, symptom, cause, remedy, row_number() over (partition by query_id order by score desc, rank, cause, remedy) as place from hy join paths using (symptom) join qe using (query_id) where equipment = e) select query_id, string_agg(symptom || ' → ' || cause || ' → ' || remedy, chr(10) order by place) as context from tp where place <= 3 group by query_id")
def h07(spark, d):
    """Contexts whose triplets belong to the equipment of the query; a query without any has no row."""
    of_query = scr(spark, d).where(F.col("row_no") % 20 == 0).select(F.col("row_no").alias("query_id"), F.col("equipment").alias("e"))
    ranked = q07(spark, d).join(of_query, "query_id")
    paths = graph.first_paths(scr(spark, d), scr(spark, d))
    found = graph.collect_scored(ranked, paths, by_equipment="e")
    return context.graph_context(found.withColumnRenamed("place", "rank"))


@query("h17_property_presence", _TEXTS + " select (select count(*) from cx) as nodes, (select count(combined_text) from cx) as with_combined_text, (select count(equipment) from (select arg_max(equipment, row_no) as equipment from scr group by symptom)) as with_equipment")
def h17(spark, d):
    n = graph.nodes(scr(spark, d)).where("label = 'symptom'").select(F.col("name").alias("symptom"), "equipment").join(graph.with_combined_text(scr(spark, d)), "symptom", "left")
    return graph.property_presence(n, "combined_text", "equipment")


@query("r04_graph_relevance", _SCORED + " select query_id, count(*) as lines from cut group by query_id")
def r04(spark, d):
    contexts = context.graph_context(h05(spark, d).withColumnRenamed("place", "rank"))
    return contexts.select("query_id", context.graph_relevance(F.col("context")).cast("long").alias("lines"))


@query("r03_fallback_relevance", "select item_id as query_id, length(trim(text)) > 20 as is_relevant from benchmark")
def r03(spark, d):
    return context.fallback_relevance(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("r07_prompts", _MANUAL + " select document_id, 'Answer from the manual.' || chr(10) || text as prompt from manual")
def r07(spark, d):
    return manuals(spark, d).select("document_id", context.prompt("Answer from the manual.\n{passage}", passage=F.col("text")).alias("prompt"))


@query("a08_embedding_statistics", r"select source as document_id, count(*) as chunks, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')))::bigint as words from documents group by 1")
def a08(spark, d):
    return docs_of(spark, d).groupBy(F.col("source").alias("document_id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.word_count(F.col("text"))).cast("long").alias("words"))


@query("s15_quality_report", r"with m as (select count(*) as n, count(distinct source) as s, coalesce(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))), 0)::bigint as w from documents) select 'Documents: ' || n || chr(10) || 'Sources: ' || s || chr(10) || 'Words: ' || w as report from m")
def s15(spark, d):
    rows = docs_of(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).cast("long").alias("words"))
    return context.report(rows)
