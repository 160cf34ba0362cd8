"""What is asked of an operator grows with different texts, not with copies of them; rows equal brute force."""

import math

from pyspark.sql import functions as F

from faultline.operators import graph, kg_context, search
from faultline.plans import registry, retrieval_queries, symptom_queries  # noqa: F401  they register


def test_copies_of_texts_are_searched_once(spark, monkeypatch):
    texts = ["motor axis fault", "cable stop brake", "motor axis stop"]
    rows = spark.createDataFrame([(k, texts[k % 3], f"c{k}") for k in range(60)], "triplet_id long, symptom string, cause string")
    asked = rows.where("triplet_id % 5 = 0").select(F.col("triplet_id").alias("query_id"), F.col("symptom").alias("text"))
    sizes, plain = [], search.vector_search

    def counted(queries, vectors, *rest, **more):
        sizes.append((queries.count(), vectors.count()))
        return plain(queries, vectors, *rest, **more)

    monkeypatch.setattr(search, "vector_search", counted)
    got = search.threshold_symptoms(asked, rows, "triplet_id", "symptom", k=3, least=0.5).orderBy("query_id", "rank").collect()
    assert sizes == [(3, 3)]
    want = [(q, t, n + 1) for q in range(0, 60, 5) for n, t in enumerate([q % 3 + 3 * i for i in range(3)])]
    assert [(r.query_id, r.triplet_id, r["rank"]) for r in got] == want and all(r.cause == f"c{r.triplet_id}" for r in got)


def test_bm25_adds_up_within_blocks(spark, monkeypatch):
    """Several blocks and packs, repeated questions and a word of every document: no table of query and document pairs."""
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "MOST", 40)
    docs = [(k, f"motor m{k % 5} n{k % 7} " + "stop " * (k % 3)) for k in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"motor m{q % 4} stop missing") for q in range(20)] + [(20, None), (21, "none")], "query_id long, text string")
    found = search.bm25(asked, rows, 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    terms = {k: t.split() for k, t in docs}
    mean = sum(map(len, terms.values())) / len(terms)
    df = {t: sum(t in w for w in terms.values()) for w in terms.values() for t in w}
    want = set()
    for q in range(20):
        scores = []
        for k, w in terms.items():
            held = [t for t in ("motor", f"m{q % 4}", "stop") if t in w]
            scores.append((-round(sum((math.log(40 / (df[t] + 1)) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in held), 9), k))
        want |= {(q, k, -s, n) for n, (s, k) in enumerate(sorted(scores)[:5], 1)}
    assert set(map(tuple, found.collect())) == want
    assert search.bm25(asked, rows, 5, mode="and").count() == 0 and search.bm25(asked, rows.limit(0), 5).count() == 0


def test_levenshtein_search_takes_the_first_of_each_code(spark, monkeypatch):
    known = spark.createDataFrame([(f"ABC-00{k % 3} part {k:03d}",) for k in range(60)], "symptom string")
    asked = spark.createDataFrame([(q, "ABC-001 ABD-001 x") for q in range(9)], "query_id long, text string")
    got = search.levenshtein_search(asked, known, 4)
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("row_number()") >= 3  # firsts of a code, best of an asked code, best of a query
    want = [f"ABC-001 part {k:03d}" for k in (1, 4, 7, 10)]
    assert [(r.query_id, r.symptom, r.score) for r in got.orderBy("query_id", "rank").collect()] == [(q, s, 1.0) for q in range(9) for s in want]


def test_dense_lookup_fuses_equal_questions_once(spark, monkeypatch):
    texts = ["ABC-001 motor axis fault", "ABD-002 cable stop brake", "ABC-003 motor axis stop"]
    known = spark.createDataFrame([(t,) for t in [*texts, "XYZ-900 fan"]], "symptom string")
    asked = spark.createDataFrame([(q, texts[q % 3]) for q in range(30)] + [(30, None), (31, " ")], "query_id long, text string")
    sizes, plain = [], search.hybrid_symptoms

    def counted(scored, *rest):
        sizes.extend(rows.select("query_id").distinct().count() for rows, _, _ in scored)
        return plain(scored, *rest)

    monkeypatch.setattr(search, "hybrid_symptoms", counted)
    got = search.dense_symptoms(asked, known, 2)
    assert sizes == [3, 3, 3] and got.columns == ["query_id", "symptom", "score", "rank"]
    found = {(r.query_id, r["rank"]): (r.symptom, r.score) for r in got.collect()}
    assert {q for q, _ in found} == set(range(30)) and len(found) == 60
    assert all(found[q, n] == found[q % 3, n] for q, n in found) and all(found[q, 1] == (texts[q], 1.0) for q in range(3))


def _graph(spark):
    """Symptoms with several causes, which have many remedies each."""
    rows = [(k, f"ABC-{k % 4:03d} motor axis fault {k % 7}", f"cause {k % 3}", f"remedy {k % 11:02d}", f"EQ-{k % 5}") for k in range(231)]
    rows += [(500, "ABC-009 lone fan", "cause x", "remedy y", "EQ-1"), (501, "ABC-008 no cause", None, "remedy z", "EQ-1")]
    return spark.createDataFrame(rows, "row_no long, symptom string, cause string, remedy string, equipment string")


def test_first_paths_are_those_of_all_paths(spark):
    rows = _graph(spark)
    own = {}
    for r in graph.expand(rows.select("symptom", "cause").distinct(), rows).collect():
        own.setdefault(r.symptom, []).append((r.cause, r.remedy, r.equipment))
    for most in (1, 3, 50):
        got = {}
        for r in graph.first_paths(rows, rows, most).collect():
            got.setdefault(r.symptom, []).append(((r.cause, r.remedy, r.equipment), r.stands))
        assert {s: sorted(p for p, _ in ps) for s, ps in got.items()} == {s: sorted(ps)[:most] for s, ps in own.items()}
        assert {s: sum(n for _, n in ps) for s, ps in got.items()} == {s: len(ps) for s, ps in own.items()}


def test_contexts_do_not_write_all_paths(spark, monkeypatch):
    rows = _graph(spark)
    queries = rows.where("row_no % 20 = 0 or row_no > 400").select(F.col("row_no").alias("query_id"), F.col("symptom").alias("text"), "equipment")
    paths = graph.expand(rows.select("symptom", "cause").distinct(), rows)
    want = {(kind, level): sorted(map(tuple, kg_context.kg_context(kind, queries.select("query_id", "text", *level), rows, paths).collect())) for kind in ("dense", "dense_sc") for level in ((), ("equipment",))}
    assert max(total for _, _, _, total in want["dense", ()]) > 60

    def refused(*_):
        raise AssertionError("all paths are written")

    monkeypatch.setattr(graph, "expand", refused)
    for (kind, level), context in want.items():
        assert sorted(map(tuple, kg_context.kg_context(kind, queries.select("query_id", "text", *level), rows).collect())) == context


SMALL = "/root/testdata/sf0.001"


def test_scored_triplets_do_not_write_all_paths(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all paths are written")

    monkeypatch.setattr(graph, "expand", refused)
    for name in ("h05_scored_triplets", "h07_equipment_context"):
        registry.QUERIES[name](spark, SMALL)


def test_dense_lookups_have_small_plans(spark):
    """What the searches share is computed once: the driver plans and holds few exchanges."""
    for name, most in (("q07_hybrid_symptoms", 10), ("h07_dense_equipment", 40)):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Aggregate") <= most, (name, plan.count("Aggregate"))


def test_remedy_sharing_does_not_write_all_paths(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all paths are written")

    r = [(None if k % 31 == 0 else f"s{k % 23}", None if k % 29 == 0 else f"c{k * k % 13}", None if k % 5 == 0 else f"r{k % 7}") for k in range(150)]
    r += [("lone", "c lone", "r lone"), ("a", "c none", None), ("b", "c none", None)]
    paths = {(s, c, m) for s, c, _ in r for c2, m in {x[1:] for x in r} if c == c2 and None not in (s, c, m)}
    sharing = {(a, b, c, m) for a, c, m in paths for b, c2, m2 in paths if a != b and (c, m) == (c2, m2)}
    want = tuple(len({f(x) for x in sharing}) for f in (lambda x: x[3], lambda x: x[2], lambda x: x[:2]))
    monkeypatch.setattr(graph, "SHARE", 3)  # classes are cut into several parts
    rows = spark.createDataFrame(r, "symptom string, cause string, remedy string")
    assert tuple(graph.relation_sharing(rows).first()) == want and 0 < want[2] < 23 * 22
    assert tuple(graph.remedy_sharing(spark.createDataFrame(sorted(paths), rows.schema)).first()) == want
    assert tuple(graph.relation_sharing(rows.limit(0)).first()) == (0, 0, 0)
    monkeypatch.setattr(graph, "expand", refused)
    registry.QUERIES["h16_remedy_sharing"](spark, SMALL)


def test_every_row_asks_with_its_variants(spark):
    found = registry.QUERIES["q11_dense_variants"](spark, SMALL)
    ids = {r.p_partkey for r in registry.table(spark, SMALL, "part").select("p_partkey").collect()}
    assert {r.query_id for r in found.select("query_id").collect()} == ids and len(ids) > 100
    assert "% 20" not in registry.ORACLE_SQL["q11_dense_variants"] and "% 20" in registry.ORACLE_SQL["h07_dense_variants"]


def test_equal_queries_with_variants_are_fused_once(spark, monkeypatch):
    rows = _graph(spark)
    text = lambda k: f"ABC-{k % 4:03d} motor axis fault {k % 2}"
    asked = [(k, text(k), [text(k), "ABC-009 lone fan", "stop"]) for k in range(40)] + [(40, None, ["ABC-009 lone fan"]), (41, "ABC-009 lone fan", None), (41, "ABC-009 lone fan", None), (42, text(0), []), (42, text(1), [" ", text(0)])]
    sizes, plain = [], search.dense_symptoms

    def counted(queries, *rest, **more):
        sizes.append(queries.count())
        return plain(queries, *rest, **more)

    monkeypatch.setattr(search, "dense_symptoms", counted)
    schema = "query_id long, text string, variants array<string>"
    got = {}
    for part in (asked[:42], asked):  # ids given once, and some given twice
        got = {}
        for r in kg_context.lookup_variants("dense", spark.createDataFrame(part, schema), rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.symptom, r.score, r["rank"]))
        assert all(got[k] == got[k % 4] for k in range(40)) and 40 not in got
        assert got[41][0] == ("ABC-009 lone fan", 1.0, 1) and all([n for *_, n in hits] == [1, 2, 3] for hits in got.values())
    assert max(sizes) <= 14
    best = {}  # of an id given twice: the best of both rows
    texts = spark.createDataFrame([(0, text(0)), (1, text(1))], "query_id long, text string")
    for r in plain(texts, rows.select("symptom")).collect():
        best[r.symptom] = max(best.get(r.symptom, 0), r.score)
    assert [x[:2] for x in got[42]] == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]
