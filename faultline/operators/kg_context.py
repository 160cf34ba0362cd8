"""Contexts from the three graphs (dense: merged nodes, sparse: a path a triplet, dense_sc: symptoms with a cause's text).

Each graph answers at three levels: the query alone, the query within its matched equipment, and the query with its
variants within its equipment. A query whose equipment matches none is answered from the whole graph; one whose
equipment has no triplet for it stays without.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, search
from .embedding import embed
from .shared import written

GRAPHS = ("dense", "sparse", "dense_sc")
#: Weight of a variant's score, and how many variants are asked.
VARIANT_WEIGHT, VARIANTS = 0.8, 2
NO_CONTEXT = "No structured context available."


def _of(kind: str, rows: DataFrame) -> DataFrame:
    """What a graph finds symptoms in: its key column, and ``sought``, the text that is embedded."""
    if kind == "dense":
        return rows.select("symptom").distinct().withColumn("sought", F.col("symptom"))
    if kind == "sparse":
        return rows.select(F.col("row_no").alias("triplet_id"), "symptom", F.col("symptom").alias("sought"))
    if kind == "dense_sc":
        return graph.with_combined_text(rows).withColumn("sought", F.col("combined_text"))
    raise ValueError(f"a graph is one of {', '.join(GRAPHS)}, not {kind!r}")


def key_of(kind: str) -> str:
    return "triplet_id" if kind == "sparse" else "symptom"


def symptom_index(kind: str, rows: DataFrame) -> DataFrame:
    """Postings of a graph's symptoms: distinct names, names a triplet (key ``sparse_<id>``), or combined texts."""
    own = _of(kind, rows)
    key = F.concat(F.lit("sparse_"), F.col("triplet_id").cast("string")) if kind == "sparse" else F.col("symptom")
    return search.postings(own.select(key.alias("key"), "sought"), "key", "sought")


def symptom_source(kind: str, rows: DataFrame) -> DataFrame:
    """A graph's symptoms in order: distinct with their equipment, with their combined text, or a row a triplet."""
    if kind == "sparse":
        return rows.select("symptom", "equipment", F.col("row_no").alias("triplet_id")).orderBy("triplet_id")
    named = graph.nodes(rows).where("label = 'symptom'").select(F.col("name").alias("symptom"), "equipment").distinct()
    return (named.join(graph.with_combined_text(rows), "symptom") if kind == "dense_sc" else named).orderBy("symptom", "equipment")


def lookup(kind: str, queries: DataFrame, rows: DataFrame, k: int = 3, least: float = 0.8, embedder=embed) -> DataFrame:
    """query_id, key, score, rank of a graph's nearest symptoms; the dense graph weighs three searches."""
    if kind == "dense":
        return search.dense_symptoms(queries, rows.select("symptom").distinct(), k, embedder=embedder)
    found = search.threshold_symptoms(queries, _of(kind, rows), key_of(kind), "sought", k, least, embedder)
    return found.select("query_id", key_of(kind), "score", "rank")


def lookup_variants(kind: str, queries: DataFrame, rows: DataFrame, k: int = 3, **options) -> DataFrame:
    """As lookup(), for queries with ``variants``: each key's best score, those of variants weighing less.

    Queries of equal texts and variants are asked, and what their texts find is fused, once. Rows of one id are one query.
    """
    given = F.slice(F.coalesce("variants", F.array().cast("array<string>")), 1, VARIANTS)
    each = queries.select("query_id", F.struct("text", given.alias("variants")).alias("a"))
    unique = each.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    own = each.select("query_id", F.array("a").alias("asks")) if unique else each.groupBy("query_id").agg(F.array_sort(F.collect_set("a")).alias("asks"))
    digest = F.unhex(F.md5(F.to_json("asks"))).alias("set")
    sets = own.groupBy("asks").agg(F.min("query_id").cast("string").alias("of")).select(digest, "of", F.explode("asks").alias("a")).select("set", "of", "a.text", "a.variants")
    numbered = F.filter(F.transform("variants", lambda v, i: F.struct((i + 1).alias("variant"), v.alias("text"))), lambda v: v["text"].isNotNull() & (F.trim(v["text"]) != "") & (v["text"] != F.col("text")))
    texts = F.concat(F.array(F.struct(F.lit(0).alias("variant"), F.col("text").alias("text"))), numbered)
    asked = sets.select("set", "of", F.explode(texts).alias("v")).select("set", "v.variant", "v.text", F.concat_ws("#", "of", F.col("v.variant").cast("string")).alias("asked"))
    asked = written(asked.distinct(), "variants")
    found = lookup(kind, asked.select(F.col("asked").alias("query_id"), "text"), rows, k, **options).withColumnRenamed("query_id", "asked").drop("rank")
    weight = F.when(F.col("variant") == 0, F.lit(1.0)).otherwise(F.lit(VARIANT_WEIGHT))
    fused = found.join(asked.select("set", "variant", "asked").distinct(), "asked").groupBy("set", key_of(kind)).agg(F.round(F.max(F.col("score") * weight), 9).alias("score"))
    best = search.top_k(fused, k, "set", "score", key_of(kind))
    # Sizes of files mislead: a side of many short rows must not go to the driver.
    return own.select("query_id", digest).hint("merge").join(best, "set").select("query_id", key_of(kind), "score", "rank")


def triplets(kind: str, rows: DataFrame, paths: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """All triplets of a graph with its key; ``paths``: those of a merged graph that was built before.

    ``most``: of each symptom of a merged graph that is built here only its first so many, see graph.first_paths(); then
    and for the others ``stands`` says how many triplets a row stands for.
    """
    if kind == "sparse":
        out = rows.select(F.col("row_no").alias("triplet_id"), "symptom", "cause", "remedy", "equipment")
    elif paths is not None:
        out = paths
    elif most is None:
        out = graph.expand(rows.select("symptom", "cause").distinct(), rows)
    else:
        out = graph.first_paths(rows, rows, most)
    if kind == "dense_sc":
        out = out.join(graph.with_combined_text(rows), "symptom")
    return out if most is None or "stands" in out.columns else out.withColumn("stands", F.lit(1).cast("long"))


def kg_context(kind: str, queries: DataFrame, rows: DataFrame, paths: DataFrame | None = None, style: str = "compact", most: int = 3, **options) -> DataFrame:
    """query_id, context, selected, total: one text of each query's best triplets.

    queries: query_id, text, and for the higher levels ``equipment`` and ``variants``. Columns that are absent take
    the level below. A query without triplets gets the sentence NO_CONTEXT.
    """
    key = key_of(kind)
    ranked = (lookup_variants if "variants" in queries.columns else lookup)(kind, queries, rows, **options)
    found = triplets(kind, rows, paths, most).join(ranked, key)
    if "equipment" in queries.columns:
        names = rows.where("equipment <> ''").groupBy(F.col("equipment").alias("name")).agg(F.min("row_no").alias("list_no"))
        matched = search.match_equipment(queries.select("query_id", "equipment"), names)
        found = found.join(matched.select("query_id", "matched"), "query_id").where(F.col("matched").isNull() | (F.col("matched") == F.col("equipment")))
    same = [F.col(c) for c in (("triplet_id",) if kind == "sparse" else ("symptom", "cause", "remedy"))]
    once = F.row_number().over(Window.partitionBy("query_id", *same).orderBy("rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "cause", "remedy")
    kept = found.withColumn("nth", once).where("nth = 1").withColumn("place", F.row_number().over(order).cast("long"))
    kept = kept.withColumn("total", F.sum("stands").over(Window.partitionBy("query_id"))).where(F.col("place") <= most)
    one = {
        "compact": F.concat_ws(" → ", "symptom", "cause", "remedy"),
        "detailed": F.format_string("Triplet %d (score: %.3f):\n  Symptom: %s\n  Cause: %s\n  Remedy: %s\n  Equipment: %s\n", "place", "score", "symptom", "cause", "remedy", F.coalesce("equipment", F.lit("N/A"))),
        "json": F.to_json(F.struct("symptom", "cause", "remedy", "equipment", F.col("score").alias("similarity_score")), {"pretty": "true"}),
    }[style]
    lines = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("line")))).alias("lines"), F.max("total").alias("total"))
    joined = F.array_join("lines.line", {"compact": "\n", "detailed": "\n", "json": ",\n"}[style])
    size = F.size("lines").cast("long")
    header = F.format_string(f"=== {kind.upper()} KNOWLEDGE GRAPH CONTEXT ===\nTriplets: %d/%d\n\n", size, F.col("total"))
    text = {"compact": joined, "detailed": F.concat(header, joined), "json": F.concat(F.lit("[\n"), joined, F.lit("\n]"))}[style]
    out = lines.select("query_id", text.alias("context"), size.alias("selected"), "total")
    none = F.lit("[]" if style == "json" else NO_CONTEXT)
    return queries.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("context", none).alias("context"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("selected", "total")))


def wrappers(kind: str) -> dict[str, Callable[..., DataFrame]]:
    """The graph's three entry points by level; each passes on the columns that its level reads."""

    def at(*columns: str) -> Callable[..., DataFrame]:
        return lambda queries, rows, **options: kg_context(kind, queries.select("query_id", "text", *columns), rows, **options)

    if kind not in GRAPHS:
        raise ValueError(f"a graph is one of {', '.join(GRAPHS)}, not {kind!r}")
    return {"plain": at(), "equipment": at("equipment"), "variants": at("equipment", "variants")}


def random_paths(paths: DataFrame, n: int, seed: int = 42, equipment: str | None = None) -> DataFrame:
    """A repeatable sample of n paths, of equipment that contains a text if one is given."""
    own = paths if equipment is None else paths.where(F.contains("equipment", F.lit(equipment)))
    return own.orderBy(F.xxhash64(F.lit(seed), "symptom", "cause", "remedy"), "symptom", "cause", "remedy").limit(n)


def verify(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: counts of nodes, relations and equipment, densification, one-to-one means and properties of a graph."""
    n = graph.nodes(rows)
    of = lambda label: F.count_if(F.col("label") == label)
    counts = n.agg(of("symptom").alias("symptoms"), of("cause").alias("causes"), of("remedy").alias("remedies"), F.count_distinct(F.when(F.col("label") == "symptom", F.col("equipment"))).alias("equipments"))
    counts = counts.crossJoin(graph.edges(rows).agg(F.count(F.lit(1)).alias("relations")))
    each = paths.groupBy("symptom").agg(F.count_distinct("cause").alias("c"), F.count_distinct("remedy").alias("r"))
    means = each.agg(F.round(F.avg("c"), 9).alias("mean_causes"), F.round(F.avg("r"), 9).alias("mean_remedies"), F.count_if(F.col("c") > 1).alias("dense_symptoms"))
    symptoms = n.where("label = 'symptom'").select(F.col("name").alias("symptom"), "equipment").join(graph.with_combined_text(rows), "symptom", "left")
    return counts.crossJoin(means).crossJoin(graph.property_presence(symptoms, "combined_text", "equipment").drop("nodes"))
