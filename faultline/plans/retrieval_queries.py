"""Queries on candidate pools, graph contexts, stored indexes and evaluation, next to their SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, context, embedding, extraction, fusion, graph, kg_context, search, shared, vector_index
from .registry import _ASKED, _BM25, _CAUSES, _MANUAL, _COS, _FUSED, _NORMAL, _RERANK, _SCR, _VEC, asked, bm25_sql, docs_of, h01, manuals, query, scr, table, terms_sql
from .symptom_queries import _ASK, _HYBRID, _TEXTS, near_sql, symptom_queries, symptoms, vectors_sql

_STORED: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder for indexes in the shared one of the session; only on one machine may it be a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='indexes-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/index-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """The place of an index, which is built once for each table and application."""
    key = (spark.sparkContext.applicationId, os.path.basename(sf_dir.rstrip("/")), sf_dir, name)
    if key not in _STORED:
        path = folder(spark)
        build(path)
        _STORED[key] = path
    return _STORED[key]


def lexical_path(spark: SparkSession, d: str) -> str:
    return stored(spark, d, "lexical", lambda p: vector_index.build_lexical_index(docs_of(spark, d), p))


def vector_path(spark: SparkSession, d: str) -> str:
    return stored(spark, d, "vectors", lambda p: vector_index.build_vector_index(table(spark, d, "embeddings"), p))


# -- stored indexes --------------------------------------------------------------------------------------------------


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_TRUE = f"select * from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select a.vec_id as query_id, b.vec_id, {_COS} as score from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rank <= 10"


@query("i07_index_exact", _TRUE)
def i07(spark, d):
    """The stored vector index in its exact mode."""
    return vector_index.search_vector_index(vector_queries(spark, d), vector_path(spark, d), probes=None)


@query("i07_index_recall", "select count(*) as queries, true as enough from embeddings where vec_id % 20 = 0")
def i07r(spark, d):
    """The stored index with cells against the exact search: a recall of 0.9 at least, over all queries."""
    found = vector_index.search_vector_index(vector_queries(spark, d), vector_path(spark, d))
    return vector_index.recall(found, i07(spark, d)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("i07_index_coverage", "select count(*) as vectors, count(distinct vec_id) as keys, true as all_in_a_cell from embeddings")
def i07c(spark, d):
    vectors, _, figures = vector_index.open_vector_index(spark, vector_path(spark, d))
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("vec_id").alias("keys"), F.bool_and((F.col("cell") >= 0) & (F.col("cell") < figures["cells"])).alias("all_in_a_cell"))


@query("i01_stored_bm25", _BM25 + " select query_id, doc_id, score, rank from bm")
def i01_stored(spark, d):
    """BM25 over the stored lexical index."""
    return vector_index.search_lexical_index(asked(spark, d), lexical_path(spark, d))


@query("flagship_stored", _BM25 + _NORMAL + _VEC + _FUSED + _RERANK + " select query_id, doc_id, original_rank, rerank_score, rank from top")
def flagship_stored(spark, d):
    """The flagship over stored indexes: BM25 and vectors, fused and reranked."""
    near = vector_index.search_vector_index(vector_queries(spark, d), vector_path(spark, d), probes=None).withColumnRenamed("vec_id", "doc_id")
    fused = fusion.weighted(i01_stored(spark, d), near, "doc_id")
    q = asked(spark, d).select("query_id", F.col("text").alias("query"))
    rows = fused.join(q, "query_id").join(docs_of(spark, d).select("doc_id", "text"), "doc_id").select("query_id", "query", "doc_id", "text", "rank")
    return fusion.rerank(rows).select("query_id", "doc_id", "original_rank", "rerank_score", "rank")


@query("q01_bm25_batch", "with q0 as (select doc_id as query_id, text from documents where doc_id % 20 = 0), asked as (select query_id, array_to_string((" + terms_sql("text") + ")[1:8], ' ') as text from q0), " + bm25_sql("doc_id", "text", "documents", "asked", 10) + " select * from bm")
def q01_batch(spark, d):
    """Every document whose id is divisible by 20 asks with its first eight terms, in one job."""
    rows = docs_of(spark, d).where("doc_id % 20 = 0")
    ask = rows.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.analyzed(F.col("text")), 1, 8), " ").alias("text"))
    return vector_index.search_lexical_index(ask, lexical_path(spark, d))


@query("i08_stored_kind", "select count(*) as n, 64::bigint as dim, case when count(*) < 1000 then 'flat' else 'ivf' end as kind from embeddings")
def i08_stored(spark, d):
    """The metadata that a stored index carries, checked against its vectors."""
    _, _, figures = vector_index.open_vector_index(spark, vector_path(spark, d), 64)
    return spark.createDataFrame([(figures["n"], figures["dim"], figures["kind"])], "n long, dim long, kind string")


@query("i10_index_presence", "select unnest(['lexical', 'none', 'vectors']) as name, unnest([true, false, true]) as present")
def i10(spark, d):
    names = {"lexical": f"{lexical_path(spark, d)}/postings", "vectors": f"{vector_path(spark, d)}/metadata", "none": f"{vector_path(spark, d)}/absent"}
    return vector_index.index_presence(spark, names).select("name", "present")


@query("i11_smoke", "select unnest(['bm25', 'vector']) as engine, true as answers")
def i11(spark, d):
    text = docs_of(spark, d).where("length(text) > 20").orderBy("doc_id").limit(1).first()["text"]
    rows = vector_index.smoke(spark, vector_path(spark, d), lexical_path(spark, d), " ".join(text.split()[:8]))
    return rows.select("engine", ((F.col("hits") > 0) & (F.col("best") > 0)).alias("answers"))


# -- candidate pool and final ranking --------------------------------------------------------------------------------

_QUERY_ROWS = "(select row_no as query_id, 0 as query_no, symptom as text from scr where row_no % 20 = 0 union all select row_no, 1, cause from scr where row_no % 20 = 0 union all select row_no, 2, remedy from scr where row_no % 20 = 0)"
_POOL = (
    _SCR + ", sy as (select distinct symptom from scr), q as (select query_id || '#' || query_no as query_id, text from " + _QUERY_ROWS + "), " + vectors_sql("query_id", "text", "q", "qv") + ", " + vectors_sql("symptom", "symptom", "sy", "sv") + ", "
    + bm25_sql("symptom", "symptom", "sy", "q", 7) + ", " + near_sql("qv", "sv", "symptom", 7, -1, "nr")
    + ", pu as (select *, 'BM25' as engine, 0 as engine_no from bm union all select *, 'FAISS', 1 from nr), pool as (select split_part(query_id, '#', 1)::bigint as query_id, symptom, score, engine, engine || '_v' || split_part(query_id, '#', 2) as tag, row_number() over (partition by split_part(query_id, '#', 1) order by split_part(query_id, '#', 2), engine_no, rank) as place from pu)"
)


def _pool(spark, d) -> DataFrame:
    r = scr(spark, d).where("row_no % 20 = 0")
    processed = r.select(F.col("row_no").alias("query_id"), F.array("symptom", "cause", "remedy", "equipment").alias("all_queries"))
    known = symptoms(spark, d).withColumn("text", F.col("symptom"))
    vectors = embedding.embedded(symptoms(spark, d), F.col("symptom"))
    lexical = lambda q: search.bm25(q, known, 7, key="symptom", clean=T.clean_symptom_query)
    semantic = lambda q: search.vector_search(embedding.embedded_queries(q), vectors, 7, key="symptom")
    return candidates.candidate_pool(candidates.all_queries(processed), lexical, semantic, "symptom")


@query("f06_candidate_pool", _POOL + " select query_id, symptom, score, tag, place from pool")
def f06(spark, d):
    """Three texts a query, seven hits an engine, tagged; only the first three texts are asked."""
    return _pool(spark, d)


def _fused_sql(source: str) -> str:
    return (
        f", la as (select query_id, symptom, engine, arg_max(score, place) as score, min(place) as place from {source} group by 1, 2, 3), sd as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as normal from la window w as (partition by query_id, engine)),"
        " gr as (select query_id, symptom, max(score) filter (engine = 'BM25') as bm25, max(score) filter (engine = 'FAISS') as faiss, max(normal) filter (engine = 'BM25') as b, max(normal) filter (engine = 'FAISS') as f, min(place) as place from sd group by 1, 2),"
        " bo as (select *, bool_or(bm25 is not null) over (partition by query_id) and bool_or(faiss is not null) over (partition by query_id) as two from gr),"
        " pf as (select query_id, symptom, round(case when two then 0.5 * coalesce(b, 0) + 0.5 * coalesce(f, 0) else coalesce(bm25, faiss) end, 9) as fused, bm25, faiss, place from bo),"
        " pk as (select *, row_number() over (partition by query_id order by fused desc, place, symptom) as rank from pf)"
    )


_FIRST = _POOL + ", fi as (select * from (select *, row_number() over (partition by query_id, md5(trim(symptom)) order by place) as nth from pool) where nth = 1)"
_TOP = f", ca2 as (select pk.*, s.symptom as query from pk join scr s on s.row_no = pk.query_id where rank <= 15), cu as (select *, case when length(query) + length(symptom) > 502 then left(symptom, greatest(0, 502 - length(query))) else symptom end as t from ca2), ra as (select query_id, symptom, rank as original_rank, fused, bm25, faiss, round(len(list_intersect(list_distinct({terms_sql('query')}), list_distinct({terms_sql('t')})))::double / greatest(len(list_distinct({terms_sql('query')})), 1) - length(t)::double / (length(t) + 1000000), 9) as ce from cu) select query_id, symptom, original_rank, ce as cross_encoder, rank, fused as fusion, bm25, faiss from (select *, row_number() over (partition by query_id order by ce desc, original_rank, symptom) as rank from ra) where rank <= 5"


def _primary(spark, d) -> DataFrame:
    return symptom_queries(spark, d).withColumnRenamed("text", "query")


@query("f07_final_ranking", _FIRST + _fused_sql("fi") + _TOP)
def f07(spark, d):
    """The pool made distinct, fused and reranked, with every score."""
    return candidates.final_ranking(_pool(spark, d).withColumn("text", F.col("symptom")), _primary(spark, d), key="symptom")


@query("f07_fused_order", _FIRST + _fused_sql("fi") + " select query_id, symptom, rank, fused as fusion from pk where rank <= 5")
def f07_plain(spark, d):
    """Without a reranker the fused order decides."""
    rows = candidates.final_ranking(_pool(spark, d).withColumn("text", F.col("symptom")), _primary(spark, d), scorer=None, key="symptom")
    return rows.select("query_id", "symptom", "rank", "fusion")


@query("f10_score_bundle", _FIRST + _fused_sql("fi") + ", bu as (" + (_FIRST + _fused_sql("fi") + _TOP).split(", ca2 as (", 1)[1].join(["with ca2 as (", ""]) + ") select query_id, symptom, cross_encoder, fusion, bm25 is not null as has_bm25, faiss is not null as has_faiss from bu")
def f10(spark, d):
    """The scores of a ranked candidate as one struct, taken apart again."""
    s = candidates.all_scores(f07(spark, d))
    return s.select("query_id", "symptom", "all_scores.cross_encoder", "all_scores.fusion", F.col("all_scores.bm25").isNotNull().alias("has_bm25"), F.col("all_scores.faiss").isNotNull().alias("has_faiss"))


@query("f09_pair_scores", f"with p as (select a.item_id as a, b.item_id as b, a.text as query, b.text as t from benchmark a join benchmark b on b.item_id = a.item_id + 1) select a, b, coalesce(round(len(list_intersect(list_distinct({terms_sql('query')}), list_distinct({terms_sql('t')})))::double / greatest(len(list_distinct({terms_sql('query')})), 1) - length(t)::double / (length(t) + 1000000), 9), 0) as score from p")
def f09(spark, d):
    """Each benchmark item against the next."""
    b = table(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("query")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), "text"), "a")
    return candidates.pair_scores(pairs).select("a", "b", F.round("score", 9).alias("score"))


@query("f12_speed", "select count(*) as runs, round(avg(l_tax + 0.01), 9) as mean, round(min(l_tax + 0.01), 9) as least, round(max(l_tax + 0.01), 9) as greatest, round(stddev_pop(l_tax + 0.01), 9) as deviation, round(avg(5.0::double / (l_tax + 0.01)), 9) as a_second from (select l_tax::double as l_tax from lineitem)")
def f12(spark, d):
    """The statistics of a speed benchmark, over given seconds of five items each."""
    return candidates.speed(table(spark, d, "lineitem").select((F.col("l_tax").cast("double") + 0.01).alias("seconds"), F.lit(5.0).alias("n")))


# -- graph contexts --------------------------------------------------------------------------------------------------

_LINES = " select query_id, coalesce(context, 'No structured context available.') as context, coalesce(selected, 0) as selected, coalesce(total, 0) as total from q left join (select query_id, string_agg(symptom || ' → ' || cause || ' → ' || remedy, chr(10) order by place) filter (place <= 3) as context, count(*) filter (place <= 3) as selected, count(*) as total from tp group by query_id) using (query_id)"
_PLACED = "row_number() over (partition by query_id order by score desc, rank, cause, remedy) as place"
_RV = ", rv_t as (select row_no as triplet_id, symptom from scr), rv as (select triplet_id, v from rv_t join sv using (symptom)), " + near_sql("qv", "rv", "triplet_id", 3, 0.8, "nr")
_CV = ", cx as (select symptom, arg_max(symptom || ' ' || cause, row_no) as combined_text from scr group by symptom), " + vectors_sql("symptom", "combined_text", "cx", "cv") + ", " + near_sql("qv", "cv", "symptom", 3, 0.8, "nr")
_WANTED = ", qe as (select row_no as query_id, equipment as wanted from scr where row_no % 20 = 0)"


def _as_queries(r: DataFrame) -> DataFrame:
    """Symptoms as queries, with their equipment, and their cause and remedy as variants."""
    return r.select(F.col("row_no").alias("query_id"), F.col("symptom").alias("text"), "equipment", F.array("symptom", "cause", "remedy").alias("variants"))


def _asked_graph(spark, d) -> DataFrame:
    return _as_queries(scr(spark, d).where("row_no % 20 = 0"))


def _context(spark, d, kind: str, level: str, **options) -> DataFrame:
    return kg_context.wrappers(kind)[level](_asked_graph(spark, d), scr(spark, d), **options)


@query("h07_dense_plain", _HYBRID + _CAUSES + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from hy join paths using (symptom))" + _LINES)
def h07_dense(spark, d):
    return _context(spark, d, "dense", "plain")


@query("h07_dense_equipment", _HYBRID + _CAUSES + _WANTED + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from hy join paths using (symptom) join qe using (query_id) where equipment = wanted)" + _LINES)
def h07_dense_equipment(spark, d):
    return _context(spark, d, "dense", "equipment")


_NUMBERED = _HYBRID.replace("q as (select row_no as query_id, symptom as text from scr where row_no % 20 = 0)", "q as (select row_no || '#0' as query_id, symptom as text from scr where row_no % 20 = 0 union all select row_no || '#2', cause from scr where row_no % 20 = 0)")
_MAXED = ", mx as (select query_id, symptom, score, row_number() over (partition by query_id order by score desc, symptom) as rank from (select split_part(query_id, '#', 1)::bigint as query_id, symptom, round(max(score * case when split_part(query_id, '#', 2) = '0' then 1.0 else 0.8 end), 9) as score from hy group by 1, 2))"


@query("h07_dense_variants", _NUMBERED + _MAXED + _CAUSES + _WANTED + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from mx join paths using (symptom) join qe using (query_id) where rank <= 3 and equipment = wanted)" + _LINES.replace("from q left join", "from qe left join"))
def h07_dense_variants(spark, d):
    """Three texts are given; the first equals the query and is passed over, the third is beyond the two that are asked."""
    return _context(spark, d, "dense", "variants")


@query("q11_dense_variants", _NUMBERED.replace(" where row_no % 20 = 0", "") + _MAXED + " select query_id, symptom, score, rank from mx where rank <= 3")
def q11_variants(spark, d):
    """Every row asks."""
    return kg_context.lookup_variants("dense", _as_queries(scr(spark, d)), scr(spark, d))


@query("h07_sparse_plain", _ASK + _RV + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from nr join scr on row_no = triplet_id)" + _LINES)
def h07_sparse(spark, d):
    return _context(spark, d, "sparse", "plain")


@query("h07_sparse_equipment", _ASK + _RV + _WANTED + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from nr join scr on row_no = triplet_id join qe using (query_id) where equipment = wanted)" + _LINES)
def h07_sparse_equipment(spark, d):
    return _context(spark, d, "sparse", "equipment")


@query("h07_combined_plain", _ASK + _CV + _CAUSES + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from nr join paths using (symptom))" + _LINES)
def h07_combined(spark, d):
    return _context(spark, d, "dense_sc", "plain")


@query("h07_combined_equipment", _ASK + _CV + _CAUSES + _WANTED + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from nr join paths using (symptom) join qe using (query_id) where equipment = wanted)" + _LINES)
def h07_combined_equipment(spark, d):
    return _context(spark, d, "dense_sc", "equipment")


@query("h08_detailed_context", _ASK + _RV + f", tp as (select query_id, symptom, cause, remedy, equipment, score, {_PLACED} from nr join scr on row_no = triplet_id), li as (select query_id, count(*) as total, count(*) filter (place <= 3) as selected, string_agg(format('Triplet {{}} (score: {{:.3f}}):', place, score) || chr(10) || '  Symptom: ' || symptom || chr(10) || '  Cause: ' || cause || chr(10) || '  Remedy: ' || remedy || chr(10) || '  Equipment: ' || equipment || chr(10), chr(10) order by place) filter (place <= 3) as body from tp group by 1) select query_id, coalesce('=== SPARSE KNOWLEDGE GRAPH CONTEXT ===' || chr(10) || 'Triplets: ' || selected || '/' || total || chr(10) || chr(10) || body, 'No structured context available.') as context from q left join li using (query_id)")
def h08_detailed(spark, d):
    return _context(spark, d, "sparse", "plain", style="detailed").select("query_id", "context")


@query("i03_sparse_postings", _SCR + f", t as (select 'sparse_' || row_no as key, unnest({terms_sql('symptom')}) as term from scr) select key, term, count(*) as tf from t group by 1, 2")
def i03_sparse(spark, d):
    return kg_context.symptom_index("sparse", scr(spark, d)).select("key", "term", "tf")


@query("i03_combined_postings", _TEXTS + f", t as (select symptom as key, unnest({terms_sql('combined_text')}) as term from cx) select key, term, count(*) as tf from t group by 1, 2")
def i03_combined(spark, d):
    return kg_context.symptom_index("dense_sc", scr(spark, d)).select("key", "term", "tf")


@query("s11_symptom_sources", _TEXTS + ", eq as (select symptom, arg_max(equipment, row_no) as equipment from scr group by symptom) select 'dense' as graph, symptom, equipment, null::varchar as combined_text from eq union all select 'sparse', symptom, equipment, null from scr union all select 'dense_sc', symptom, equipment, combined_text from eq join cx using (symptom)")
def s11(spark, d):
    parts = {k: kg_context.symptom_source(k, scr(spark, d)) for k in kg_context.GRAPHS}
    none = F.lit(None).cast("string")
    rows = [p.select(F.lit(k).alias("graph"), "symptom", "equipment", (F.col("combined_text") if k == "dense_sc" else none).alias("combined_text")) for k, p in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


def _edges_sql(vectors: str) -> str:
    return f", ce as (select a.symptom as src, b.symptom as dst, coalesce(round(list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 0), 9), 0) as score from {vectors} a join {vectors} b on a.symptom <> b.symptom), ed as (select src, dst, score from (select *, row_number() over (partition by src order by score desc, dst) as nth from ce where score >= 0.8) where nth <= 5)"


@query("g08_cosine_edges", _ASK + _edges_sql("sv") + " select * from ed")
def g08(spark, d):
    """Similarity edges by vectors alone."""
    return graph.cosine_edges(scr(spark, d))


_CEDGES = _TEXTS + ", " + vectors_sql("symptom", "combined_text", "cx", "cv") + _edges_sql("cv")


@query("g09_combined_edges", _CEDGES + " select * from ed")
def g09a(spark, d):
    """Edges of the combined graph: each text stays with its symptom, and none points to itself."""
    return graph.combined_edges(scr(spark, d))


@query("g12_combined_paths", _CEDGES + ", pc as (select symptom, cause from scr union select dst, cause from ed join scr on src = symptom), tr as (select distinct cause, remedy from scr), eq as (select symptom, arg_max(equipment, row_no) as equipment from scr group by symptom) select symptom, cause, remedy, equipment, combined_text from pc join tr using (cause) join eq using (symptom) join cx using (symptom)")
def g12_combined(spark, d):
    return graph.build_combined(scr(spark, d))


@query("g12_sparse_paths", _SCR + " select row_no as triplet_id, symptom, cause, remedy, equipment from scr")
def g12_sparse(spark, d):
    return graph.build_sparse(scr(spark, d))


@query("g04_pairwise_cosine", f"select src, dst, score from (select src, dst, score, row_number() over (partition by src order by score desc, dst) as nth from (select a.vec_id as src, b.vec_id as dst, {_COS} as score from embeddings a, embeddings b where a.vec_id <> b.vec_id) where score >= -1) where nth <= 5")
def g04(spark, d):
    """Over given vectors."""
    return graph.pairwise_cosine(table(spark, d, "embeddings"), "vec_id", -1.0)


@query("h20_verify_graph", _SCR + _CAUSES + ", e as (select symptom, count(distinct cause) as c, count(distinct remedy) as r from paths group by 1) select (select count(*) from eq) as symptoms, (select count(distinct cause) from scr) as causes, (select count(distinct remedy) from scr) as remedies, (select count(distinct equipment) from eq) as equipments, (select count(*) from ca) + (select count(*) from tr) as relations, (select round(avg(c), 9) from e) as mean_causes, (select round(avg(r), 9) from e) as mean_remedies, (select count(*) from e where c > 1) as dense_symptoms, (select count(*) from eq) as with_combined_text, (select count(equipment) from eq) as with_equipment")
def h20(spark, d):
    return kg_context.verify(scr(spark, d), h01(spark, d))


# -- extraction, answers, evaluation ---------------------------------------------------------------------------------

_SEQ = _MANUAL + r""", parts as (select document_id, text, string_split(regexp_replace(text, '([A-Z]+-\d+)', chr(1) || '\1', 'g'), chr(1)) as p from manual), win as (select document_id, k - 1 as code_no, case when k = len(p) - 1 then left(p[k + 1], 1500) else p[k + 1] end as w from parts, unnest(range(1, len(p))) as t(k))"""
_FIELDS = r" select document_id, code_no::bigint as code_no, regexp_extract(w, '[A-Z]+-\d+') as code, trim(split_part(w, chr(10), 1)) as symptom, trim(regexp_extract(w, '(?is)Cause:\s*(.*?)(?:Remedy:|$)', 1)) as cause, trim(regexp_extract(w, '(?is)Remedy:\s*(.*?)(?:\n\n|\d+\.\d+|$)', 1)) as remedy from win where regexp_matches(w, '(?i)Cause:') and regexp_matches(w, '(?i)Remedy:')"


@query("e03_sequential", _SEQ + _FIELDS)
def e03(spark, d):
    return extraction.sequential_triplets(manuals(spark, d))


@query("e03_first_occurrence", _MANUAL + r", c as (select document_id, text, regexp_extract_all(text, '[A-Z]+-\d+') as cs from manual), k as (select document_id, text, i - 1 as code_no, cs[i] as code, cs[i + 1] as nx, strpos(text, cs[i]) as b from c, unnest(range(1, len(cs) + 1)) as t(i)), s as (select *, case when nx is not null then strpos(substr(text, b + length(code)), nx) else 0 end as e from k), win as (select document_id, code_no, code, case when e > 0 then substr(text, b, length(code) + e - 1) else substr(text, b, 1500) end as w from s)" + _FIELDS.replace(r"regexp_extract(w, '[A-Z]+-\d+') as code", "code"))
def e03_first(spark, d):
    """The known defect, on request."""
    return extraction.sequential_triplets(manuals(spark, d), first_occurrence=True)


@query("e06_equipment", _MANUAL + " select document_id, 'ROBOT A' as equipment, length(text)::bigint as n from manual")
def e06(spark, d):
    return extraction.with_equipment(manuals(spark, d), " ROBOT A ").select("document_id", "equipment", F.length("text").cast("long").alias("n"))


_PROMPT_FILE = "'intro' || chr(10) || '# === PROMPT KG_ONLY ===' || chr(10) || 'Use {kg} on ' || symptom || chr(10) || '# === PROMPT DOC_ONLY ===' || chr(10) || 'Use {docs}' || case when row_no % 3 = 0 then '' else chr(10) || '# === PROMPT BOTH ===' || chr(10) || 'Use {kg}, {docs} and ' || cause || chr(10) end"


@query("x23_prompt_sections", _SCR + f", f as (select row_no, string_split({_PROMPT_FILE}, '# === PROMPT ') as s from scr), e as (select row_no, unnest(s[2:]) as x, len(s) - 1 as n from f) select row_no, trim(split_part(split_part(x, chr(10), 1), ' ===', 1)) as name, trim(substr(x, length(split_part(x, chr(10), 1)) + 1), chr(10) || ' ') as template from e where n >= 3")
def x23(spark, d):
    """Prompt files of three sections, and some of two, which are no prompt files."""
    sections = context.prompt_sections(F.expr(_PROMPT_FILE.replace("chr(10)", "char(10)")))
    return scr(spark, d).select("row_no", F.explode(sections).alias("name", "template"))


@query("r07_strategy_prompts", _SCR + ", p as (select row_no, case row_no % 3 when 0 then 'Graph (importance 50): ' || symptom || ' → ' || cause when 1 then 'Documents (importance 50, best 0.9): ' || remedy else 'Graph (importance 50): ' || symptom || ' → ' || cause || chr(10) || 'Documents (importance 50, best 0.9): ' || remedy end as prompt from scr) select * from p")
def r07(spark, d):
    """Three templates, chosen by strategy, with importances and the best score filled in."""
    both = {"g": "Graph (importance {importance_graph}): {kg}", "d": "Documents (importance {importance_docs}, best {max_score}): {docs}"}
    values = {"importance_graph": F.lit(50), "importance_docs": F.lit(50), "max_score": F.lit(0.9), "kg": F.concat_ws(" → ", "symptom", "cause"), "docs": F.col("remedy")}
    k = F.col("row_no") % 3
    of = lambda template: context.prompt(template, **values)
    return scr(spark, d).select("row_no", F.when(k == 0, of(both["g"])).when(k == 1, of(both["d"])).otherwise(of(both["g"] + "\n" + both["d"])).alias("prompt"))


@query("v02_answers_in_prompt", _SCR + " select row_no, unnest(['classic', 'dense']) as system, unnest([cause, case when row_no % 2 = 0 then remedy || ' ' || symptom else remedy end]) as answer from scr")
def v02(spark, d):
    """A judge's prompt for two answers, and the answers taken out of it again; one has two lines."""
    answers = {"classic": F.col("cause"), "dense": F.when(F.col("row_no") % 2 == 0, F.concat_ws("\n\n", "remedy", "symptom")).otherwise(F.col("remedy"))}
    found = context.answers_in_prompt(context.judge_prompt(answers, F.col("symptom")))
    rows = scr(spark, d).select("row_no", F.posexplode(found).alias("k", "answer"))
    return rows.select("row_no", F.when(F.col("k") == 0, "classic").otherwise("dense").alias("system"), "answer")


_RAW = "case when row_no % 3 = 0 then 'no answer' else 'ok {\"filtered_query\": \"' || case when row_no % 3 = 1 then symptom else ' ' end || '\", \"query_variants\": [\"' || cause || '\", \"' || symptom || '\"], \"technical_terms\": {\"components\": [\"motor\"]}, \"equipment_info\": {\"series\": \"S1\"}}' end"


@query("u02_processed_query", _SCR + " select row_no as query_id, case when row_no % 3 = 1 then symptom else remedy end as primary_query, case when row_no % 3 = 0 then remedy when row_no % 3 = 1 then symptom || '|' || cause else remedy || '|' || cause || '|' || symptom end as all_queries, case when row_no % 3 = 0 then 0.0 else 0.5 end::double as confidence_score, (row_no % 3 <> 0)::bigint as components, 0::bigint as models, 'unknown' as manufacturer, case when row_no % 3 = 0 then 'unknown' else 'S1' end as series from scr")
def u02(spark, d):
    raw = scr(spark, d).select(F.col("row_no").alias("query_id"), F.col("remedy").alias("raw_query"), F.expr(_RAW).alias("reply"))
    p = context.processed_query(raw)
    return p.select("query_id", "primary_query", F.array_join("all_queries", "|").alias("all_queries"), "confidence_score", F.size("technical_terms.components").cast("long").alias("components"), F.size("technical_terms.equipment_models").cast("long").alias("models"), "equipment_info.manufacturer", "equipment_info.series")


@query("r06_display_strategy", _HYBRID + _CAUSES + _WANTED + f", tp as (select query_id, symptom, cause, remedy, {_PLACED} from hy join paths using (symptom) join qe using (query_id) where equipment = wanted and query_id % 40 = 0), g as (select query_id, count(*) filter (place <= 3) as n from tp group by 1), s as (select query_id, 1 / (1 + exp(-(score - 9))) as p from bm), r as (select query_id, round(max(p), 9) as m, count(*) filter (p >= 0.7) > 0 as ok from s group by 1) select query_id, case when ok and coalesce(n, 0) > 0 then 'HYBRID' when ok then 'DOC_ONLY' when coalesce(n, 0) > 0 then 'KG_ONLY' else 'NO_CONTEXT' end as strategy, m as max_score, coalesce(n, 0) as triplets from r left join g using (query_id)")
def r06(spark, d):
    """What is shown beside an answer, from the scores and contexts that the answer was given on."""
    known = shared.written(symptoms(spark, d).withColumn("text", F.col("symptom")), "symptoms")
    scores = shared.written(search.bm25(symptom_queries(spark, d), known, 6, key="symptom", clean=T.clean_symptom_query).select("query_id", (F.col("score") - 9).alias("score")), "scores")
    contexts = _context(spark, d, "dense", "equipment").where("query_id % 40 = 0")
    return context.display_strategy(scores, contexts)


@query("r09_configuration", "select unnest(['generator', 'generator', 'generator', 'generator', 'generator', 'generator', 'reranker', 'reranker', 'client', 'client', 'client']) as part, unnest(['context_token_limit', 'max_context_chunks', 'max_triplets', 'relevance_threshold', 'importance_context_rerank', 'importance_context_graph', 'most_chars', 'top_k', 'model', 'max_tokens', 'temperature']) as name, unnest(['6000', '3', '3', '0.7', '50', '50', '502', '5', 'none', '500', '0.1']) as value")
def r09(spark, d):
    return context.configuration(spark, {"client": {"max_tokens": 500, "temperature": None}})


@query("h18_random_paths", _SCR + _CAUSES + " select least(7, count(*)) as n, true as of_equipment, true as repeatable from paths where contains(equipment, 'EQ-3')")
def h18(spark, d):
    """A repeatable sample of seven paths of one equipment."""
    one, two = (kg_context.random_paths(h01(spark, d), 7, 5, "EQ-3") for _ in range(2))
    same = two.select("symptom", "cause", "remedy", F.lit(True).alias("again"))
    rows = one.join(same, ["symptom", "cause", "remedy"], "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.contains("equipment", F.lit("EQ-3"))).alias("of_equipment"), F.bool_and(F.coalesce("again", F.lit(False))).alias("repeatable"))
