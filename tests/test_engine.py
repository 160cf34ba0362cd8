"""Core engine: indexes, graph contexts, readers and plans against brute force and golden values."""

import random

import pytest
from pyspark.sql import functions as F

from faultline import sources
from faultline.operators import candidates, context, embedding, extraction, graph, kg_context, search, vector_index


def vectors_of(spark, n, dim=16, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(20)]
    rows = [(k, [c + rng.gauss(0, 0.4) for c in centres[k % 20]]) for k in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_vector_index_recall_exact_mode_and_checks(spark, tmp_path):
    vectors, path = vectors_of(spark, 3000), f"file://{tmp_path}/index"
    vector_index.build_vector_index(vectors, path, cells=30)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    truth = search.vector_search(asked, vectors).cache()
    exact = vector_index.search_vector_index(asked, path, probes=None)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, truth.collect()))
    few = vector_index.recall(vector_index.search_vector_index(asked, path), truth).first()
    assert few.queries == 150 and few.recall >= 0.9 and vector_index.open_vector_index(spark, path)[2]["probes"] < 30
    held, _, figures = vector_index.open_vector_index(spark, path, 16)
    assert figures["cells"] == 30 and held.select("vec_id").distinct().count() == 3000
    with pytest.raises(ValueError, match="dimension"):
        vector_index.open_vector_index(spark, path, 99)
    vectors.limit(5).withColumn("part", F.lit(0)).withColumn("cell", F.lit(0)).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="metadata"):
        vector_index.open_vector_index(spark, path)


def test_vector_index_of_few_rows(spark, tmp_path):
    for name, n in (("none", 0), ("one", 1)):
        rows = vectors_of(spark, 1).where("vec_id >= 0" if n else "vec_id < 0")
        vector_index.build_vector_index(rows, f"file://{tmp_path}/{name}")
        asked = vectors_of(spark, 1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        assert vector_index.search_vector_index(asked, f"file://{tmp_path}/{name}").count() == n


def test_valid_vectors_have_one_dimension(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [float("nan"), 1.0]), (4, []), (5, None), (6, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in search.valid_vectors(rows).collect()) == [1, 6]


def test_stored_lexical_index_equals_search(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["pump", "motor", "valve", "axis", "cable"]) + str(rng.randint(0, 5)) for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(99, None)], "doc_id long, text string")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    vector_index.build_lexical_index(docs, f"file://{tmp_path}/lexical")
    for mode in ("or", "and"):
        assert sorted(map(tuple, vector_index.search_lexical_index(asked, f"file://{tmp_path}/lexical", 5, mode).collect())) == sorted(map(tuple, search.bm25(asked, docs, 5, mode).collect()))


def test_similarity_edges_equal_all_pairs(spark):
    """Frequent codes, equal word sets, near codes and none: the shapes' join gives what all pairs give."""
    rng = random.Random(9)
    words = ["motor", "axis", "fault", "cable", "stop", "brake", "limit"]
    texts = {f"{rng.choice(['SYST-001', 'SYST-002', 'ACAL-117', ''])} {' '.join(rng.sample(words, rng.randint(2, 6)))}".strip() for _ in range(120)}
    texts |= {"Motor axis!", "axis motor", "MOTOR AXIS", "axis  motor", "motor axis?", "motor, axis", "axis - motor", "SYST-001 motor axis", "SYST-001 axis motor", "syst-001 motor AXIS"}
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "symptom string")
    import re

    def parts(t):
        return sorted(set(re.sub(r"[^\w\s-]", " ", t.lower()).split())), re.findall(r"\b[A-Z]{3,5}-\d{3,4}\b", t.upper())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = []
    for s in sorted(texts):
        found = []
        for d in sorted(texts - {s}):
            (ts, cs), (td, cd) = parts(s), parts(d)
            shared = len(set(ts) & set(td))
            code = max([1 - distance(a, b) / 3 for a in cs for b in cd if distance(a, b) <= 2], default=0.0)
            score = round(0.4 * shared / (len(ts) * len(td)) ** 0.5 + 0.4 * shared / (len(ts) + len(td) - shared) + 0.2 * code, 9)
            if score >= 0.8 and (code or ts == td):
                found.append((-score, d))
        want += [(s, d, -score) for score, d in sorted(found)[:5]]
    assert len(want) > 100 and sorted(map(tuple, graph.similarity_edges(rows).collect())) == sorted(want)


def test_remedy_sharing_equals_all_pairs(spark):
    rng = random.Random(5)
    data = {(f"s{rng.randint(0, 12)}", f"c{rng.randint(0, 3)}", f"r{rng.randint(0, 2)}") for _ in range(40)}
    pairs = {(a, b) for a, c, r in data for b, c2, r2 in data if a != b and (c, r) == (c2, r2)}
    got = graph.remedy_sharing(spark.createDataFrame(sorted(data), "symptom string, cause string, remedy string")).first()
    assert got["pairs"] == len(pairs)


def test_held_names_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(60)]
    a = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:30])], "query_id long, a string")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(texts[30:])], "list_no long, b string")
    want = {(i, j) for i, x in enumerate(texts[:30]) for j, y in enumerate(texts[30:]) if x in y or y in x}
    assert {tuple(r) for r in search.held_names(a, b).collect()} == want


def test_embedder_counts_places(spark):
    rng = random.Random(3)
    texts = [" ".join(f"term{rng.randint(0, 40)}" for _ in range(rng.randint(1, 80))) for _ in range(20)]
    import hashlib

    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", embedding.embed(F.col("text")).alias("v")).collect():
        counts = [0.0] * 256
        for t in r.text.split():
            counts[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 256] += 1  # noqa: S324
        norm = sum(c * c for c in counts) ** 0.5
        assert [round(x, 12) for x in r.v] == [round(c / norm, 12) for c in counts]


def test_candidates(spark):
    processed = spark.createDataFrame([(1, ["a b", "c", " ", "d"]), (2, [])], "query_id long, all_queries array<string>")
    rows = candidates.all_queries(processed)
    assert sorted((r.query_id, r.query_no, r.text) for r in rows.collect()) == [(1, 0, "a b"), (1, 1, "c"), (1, 2, " ")]
    pool = spark.createDataFrame([(1, 10, "x", 5.0, "BM25_v0", 1), (1, 11, "y", 3.0, "BM25_v0", 2), (1, 12, " x ", 0.9, "FAISS_v0", 3), (1, 13, "z", 0.5, "FAISS_v0", 4), (1, 14, " ", 9.0, "FAISS_v1", 5)], "query_id long, doc_id long, text string, score double, tag string, place long")
    queries = spark.createDataFrame([(1, "z")], "query_id long, query string")
    plain = candidates.final_ranking(pool, queries, scorer=None).orderBy("rank").collect()
    assert [r.doc_id for r in plain] == [10, 11, 13] and plain[0].bm25 == 5.0 and plain[0].faiss is None
    both = candidates.final_ranking(pool, queries, scorer=None, fuse_before_dedup=True).orderBy("rank").collect()
    assert [r.doc_id for r in both] == [10, 11, 13]
    assert candidates.pair_scores(spark.createDataFrame([("a", None)], "query string, text string")).first()["score"] == 0.0


def test_contexts_without_triplets(spark):
    rows = spark.createDataFrame([(1, "SYST-001 motor stops", "worn belt", "replace it", "EQ-1", 1)], "row_no long, symptom string, cause string, remedy string, equipment string, page long")
    queries = spark.createDataFrame([(1, "SYST-001 motor stops", "EQ-1", ["motor", None, ""]), (2, "SYST-001 motor stops", "nothing known", None)], "query_id long, text string, equipment string, variants array<string>")
    for kind in kg_context.GRAPHS:
        for level, call in kg_context.wrappers(kind).items():
            got = {r.query_id: r for r in call(queries, rows).collect()}
            assert got[1].selected == got[2].selected == (1 if kind != "dense_sc" or "worn" in got[1].context else 0), (kind, level)
    other = rows.union(spark.createDataFrame([(2, "other text", "c", "r", "EQ-2", 1)], rows.schema))
    wanted = spark.createDataFrame([(1, "SYST-001 motor stops", "EQ-2")], "query_id long, text string, equipment string")
    assert kg_context.kg_context("sparse", wanted, other).first()["context"] == kg_context.NO_CONTEXT
    detailed = kg_context.kg_context("sparse", queries.select("query_id", "text"), rows, style="detailed").first()["context"]
    assert detailed.startswith("=== SPARSE KNOWLEDGE GRAPH CONTEXT ===\nTriplets: 1/1\n\nTriplet 1 (score: 1.000):\n  Symptom: SYST-001")
    import json

    assert json.loads(kg_context.kg_context("sparse", queries.select("query_id", "text"), rows, style="json").first()["context"])[0]["cause"] == "worn belt"
    with pytest.raises(ValueError):
        kg_context.wrappers("other")


def test_answers_and_prompts(spark):
    prompt = "RESPONSE 1 (RAG A):\nfirst\n\nsecond\nRESPONSE 2 (DENSE):\nother\nEVALUATION CRITERIA: x\nmore\nProvide JSON: y\nRESPONSE 3 (RAG):\nlate"
    row = spark.createDataFrame([(prompt,), (None,)], "p string").select(context.answers_in_prompt(F.col("p")).alias("a")).collect()
    assert [r.a for r in row] == [["first second", "other", "more"], []]
    with pytest.raises(ValueError):
        context.judge_prompt({"one": F.lit("x")}, F.lit("q"))
    two = context.verdict(spark.createDataFrame([(1, 'x {"score_classic": 4, "score_dense": 1}'), (2, "none")], "answer_set long, reply string"), ("classic", "dense")).orderBy("answer_set").collect()
    assert [tuple(r) for r in two] == [(1, 4.0, 1.0), (2, 2.5, 2.5)]
    sections = spark.createDataFrame([("# === PROMPT A ===\nx\n# === PROMPT B ===\ny",)], "t string")
    assert sections.select(context.prompt_sections(F.col("t"))).first()[0] is None
    assert sections.select(context.prompt_sections(F.col("t"), 2)).first()[0] == {"A": "x", "B": "y"}
    assert context.settings("client", {"model": "m", "max_tokens": None}) == {"model": "m", "max_tokens": 1000, "temperature": 0.1}
    with pytest.raises(RuntimeError):
        context.Client().ask(sections)
    client = context.Client(lambda prompts, s: prompts.withColumn("reply", F.lit(s["model"])), {"model": "m"})
    assert client.ask(sections).first()["reply"] == "m"


def test_extraction_variants(spark):
    text = "ALRM-001 hot\nCause: fan. Remedy: clean.\n\nsee ALRM-002 x Cause: y Remedy: z 1.2 t ALRM-001 again Cause: p Remedy: q"
    m = spark.createDataFrame([("d", text)], "document_id string, text string")
    got = [(r.code, r.symptom, r.cause, r.remedy) for r in extraction.sequential_triplets(m).orderBy("code_no").collect()]
    assert got == [("ALRM-001", "ALRM-001 hot", "fan.", "clean."), ("ALRM-002", "ALRM-002 x Cause: y Remedy: z 1.2 t", "y", "z"), ("ALRM-001", "ALRM-001 again Cause: p Remedy: q", "p", "q")]
    first = [(r.code, r.cause) for r in extraction.sequential_triplets(m, first_occurrence=True).orderBy("code_no").collect()]
    assert first == [("ALRM-001", "fan."), ("ALRM-002", "y"), ("ALRM-001", "fan.")]
    cut = extraction.with_last_cut(extraction.code_windows(m), 20).orderBy("window_no").collect()
    assert [len(r.window) for r in cut][-1] == 20 and [r.position for r in cut] == [0, text.index("ALRM-002"), text.rindex("ALRM-001")]
    with pytest.raises(ValueError):
        extraction.with_equipment(m, " x ")


def test_readers(spark, tmp_path):
    header = "symptom,cause,remedy,equipment\n"
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text(header + "a1,c,r,E\na2,c,r,E\n")
    (tmp_path / "csv" / "b.csv").write_text(header + "".join(f"b{k},c,r,E\n" for k in range(500)))
    (tmp_path / "csv" / "c.csv").write_text(header + "c1,c,r,E\n")
    rows = sources.read_triplets(spark, str(tmp_path / "csv")).orderBy("row_no").collect()
    assert [r.symptom for r in rows] == ["a1", "a2", *(f"b{k}" for k in range(500)), "c1"] and len({r.row_no for r in rows}) == 503
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"two pages")
    (tmp_path / "pdf" / "y.pdf").write_bytes(b"broken")

    def parse(raw):
        if raw == b"broken":
            raise ValueError
        return [("short", "longer text"), ("plain text", "p")]

    got = sorted(tuple(r) for r in sources.read_pdf(spark, str(tmp_path / "pdf"), parse).collect())
    assert got == [("x.pdf", 1, "longer text"), ("x.pdf", 2, "plain text"), ("y.pdf", 1, "error")]
    rows = spark.createDataFrame([("d", 0, "t", [1.0, 2.0])], "document_id string, chunk_id long, text string, embedding array<double>")
    sources.write_embeddings(rows, str(tmp_path / "emb"))
    assert sources.read_embeddings(spark, str(tmp_path / "emb"), 2).count() == 1
    with pytest.raises(ValueError, match="dimension"):
        sources.read_embeddings(spark, str(tmp_path / "emb"), 3)
    rows.drop("text").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lacks text"):
        sources.read_embeddings(spark, str(tmp_path / "bad"))
    store = sources.GraphStore(spark, str(tmp_path / "graph"))
    store.save(spark.range(2), spark.range(3))
    store.truncate()
    assert [t.count() for t in store.load()] == [0, 0]


def test_entry_reports_broken_imports(monkeypatch):
    import __spark_entry__ as entry

    def broken(name):
        raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")

    def absent(name):
        raise ModuleNotFoundError(f"No module named '{name}'", name=name)

    monkeypatch.setattr(entry, "import_module", absent)
    assert entry._optional("corpus_pipeline") is None
    monkeypatch.setattr(entry, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("corpus_pipeline")
