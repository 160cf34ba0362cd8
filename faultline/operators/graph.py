"""The diagnosis graph: symptoms, causes and remedies as tables; similarity edges, propagation and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .embedding import embed, embedded
from .search import near_codes, vector_search

WEIGHTS = (0.4, 0.4, 0.2)
LABELS = ("symptom", "cause", "remedy")
SHARE = 4096  # profiles of a class that a task compares with the class


def sparse(rows: DataFrame) -> DataFrame:
    """One path a row: label, name, equipment, triplet_id."""
    pairs = ", ".join(f"'{x}', {x}" for x in LABELS)
    return rows.selectExpr("row_no as triplet_id", "equipment", f"stack(3, {pairs}) as (label, name)").select("label", "name", "equipment", "triplet_id")


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes merged by label and name; the last row's equipment wins."""
    return sparse(rows).groupBy("label", "name").agg(F.max_by("equipment", "triplet_id").alias("equipment"))


def edges(rows: DataFrame) -> DataFrame:
    """Distinct edges: relation, src, dst."""
    causes = rows.select(F.lit("CAUSES").alias("relation"), F.col("symptom").alias("src"), F.col("cause").alias("dst"))
    return causes.union(rows.select(F.lit("TREATED_BY"), "cause", "remedy")).distinct()


def with_combined_text(rows: DataFrame) -> DataFrame:
    """Symptoms with ``symptom cause`` of their last row: symptom, combined_text."""
    return rows.groupBy("symptom").agg(F.max_by(F.concat_ws(" ", "symptom", "cause"), "row_no").alias("combined_text"))


def _both(pairs: DataFrame) -> DataFrame:
    a, b = F.col("ta"), F.col("tb")
    shared, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    cosine = F.when((na > 0) & (nb > 0), shared / F.sqrt((na * nb).cast("double"))).otherwise(F.lit(0.0))
    jaccard = F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(shared / (na + nb - shared))
    code = F.when(F.col("d").between(0, 3), 1 - F.col("d") / 3).otherwise(F.lit(0.0))
    w = WEIGHTS
    return pairs.withColumn("score", F.round(w[0] * cosine + w[1] * jaccard + w[2] * code, 9))


def similarity_edges(symptoms: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """src, dst, score: the k most similar symptoms of each, by cosine, word overlap and error codes.

    Lossless blocking by codes: a pair without codes at most two edits apart reaches ``least`` only with equal word
    sets; the others are joined on near codes. The cosine is at most the root of the word overlap, so the overlap has a
    floor for each distance of codes, and sets that reach it share one of their rarest words, the fewer the farther the
    codes; blocks are cut by codes and such words, and only blocks that both sides have are dealt. Symptoms of equal words and codes are one shape; shapes are compared, not symptoms, and of a
    shape's symptoms only the k + 1 first can be among another's k best. So no group is paired with itself.
    """
    lowest = (least - WEIGHTS[0] - WEIGHTS[2]) / WEIGHTS[1]
    if lowest <= 0:
        raise ValueError("the blocking needs a threshold above the cosine and code weights")
    rows = symptoms.select("symptom", F.sort_array(T.token_set(F.col("symptom"))).alias("t"), F.sort_array(F.array_distinct(T.strict_codes(F.col("symptom")))).alias("codes")).distinct()
    rows = rows.withColumn("shape", F.sha2(F.to_json(F.struct("t", "codes")), 256))
    shapes = rows.select("shape", "t", "codes").distinct()
    words = shapes.where(F.size("codes") > 0).select("shape", F.size("t").alias("n"), F.explode("t").alias("word"))
    known = words.groupBy("word").agg(F.count(F.lit(1)).alias("shapes"))
    nth = F.row_number().over(Window.partitionBy("shape").orderBy("shapes", "word"))
    w = WEIGHTS

    def floor_at(d: int) -> float:
        need = least - w[2] * (1 - d / 3)
        return ((-w[0] + (w[0] ** 2 + 4 * w[1] * need) ** 0.5) / (2 * w[1])) ** 2

    floor = F.when(F.col("d") == 0, floor_at(0)).when(F.col("d") == 1, floor_at(1)).otherwise(floor_at(2))
    most = lambda n, j: F.col(n) - F.ceil(j * F.col(n) - 1e-9) + 1
    rare = words.join(known, "word").withColumn("nth", nth).where(F.col("nth") <= most("n", F.lit(floor_at(0)))).select("shape", "word", "n", "nth")
    coded = shapes.select("shape", "t", F.explode("codes").alias("code")).join(rare, "shape")
    codes = shapes.select(F.explode("codes").alias("code")).distinct()
    near = near_codes(codes.select(F.col("code").alias("asked")), codes, 2).select(F.col("asked").alias("ca"), F.col("code").alias("cb"), "d")
    held = coded.select("code", "word").distinct()
    blocks = near.join(held.select(F.col("code").alias("ca"), "word"), "ca").join(held.select(F.col("code").alias("cb"), "word"), ["cb", "word"])
    a = coded.select(F.col("shape").alias("sa"), F.col("t").alias("ta"), F.col("code").alias("ca"), "word", F.col("n").alias("na"), F.col("nth").alias("ia"))
    b = coded.select(F.col("shape").alias("sb"), F.col("t").alias("tb"), F.col("code").alias("cb"), "word", F.col("n").alias("nb"), F.col("nth").alias("ib"))
    shared = F.size(F.array_intersect("ta", "tb"))
    by_code = a.join(blocks, ["ca", "word"]).where(F.col("ia") <= most("na", floor)).join(b, ["cb", "word"]).where(F.col("ib") <= most("nb", floor)).where("sa <> sb")
    by_code = by_code.where(shared / (F.size("ta") + F.size("tb") - shared) >= floor - 1e-9)
    left = shapes.select(F.col("shape").alias("sa"), F.col("t").alias("ta"))
    equal = left.join(shapes.select(F.col("shape").alias("sb"), F.col("t").alias("tb")), F.col("ta") == F.col("tb")).where("sa <> sb").select("sa", "sb", F.lit(-1).alias("d"), "ta", "tb")
    own = shapes.select(F.col("shape").alias("sa"), F.col("shape").alias("sb"), F.when(F.size("codes") > 0, 0).otherwise(-1).alias("d"), F.col("t").alias("ta"), F.col("t").alias("tb"))
    pairs = by_code.select("sa", "sb", "d", "ta", "tb").union(equal).union(own)
    scored = _both(pairs).groupBy("sa", "sb").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("shape").orderBy("symptom"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= k + 1).select(F.col("shape").alias("sb"), F.col("symptom").alias("dst"))
    found = rows.select(F.col("symptom").alias("src"), F.col("shape").alias("sa")).join(scored, "sa").join(firsts, "sb").where("src <> dst").select("src", "dst", "score")
    order = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def propagate(rows: DataFrame, similar: DataFrame) -> DataFrame:
    """Distinct (symptom, cause): each similar symptom gains the causes of its source; one hop."""
    own = rows.select("symptom", "cause").distinct()
    gained = similar.join(own, F.col("src") == F.col("symptom")).select(F.col("dst").alias("symptom"), "cause")
    return own.union(gained).distinct()


def expand(causes: DataFrame, rows: DataFrame) -> DataFrame:
    """Paths symptom, cause, remedy, equipment over merged nodes."""
    treated = rows.select("cause", "remedy").distinct()
    equipment = rows.groupBy("symptom").agg(F.max_by("equipment", "row_no").alias("equipment"))
    return causes.join(treated, "cause").join(equipment, "symptom").select("symptom", "cause", "remedy", "equipment")


def first_paths(causes: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """As expand(), but of each symptom only the ``most`` first paths by cause and remedy; ``stands`` counts the paths
    that a row stands for, so that its sum over a symptom is the number of all its paths.

    They have the first remedies of the symptom's first causes, so no other path is written.
    """

    def firsts(table: DataFrame, by: str, *order: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        return table.withColumn("nth", nth).where(F.col("nth") <= most)

    treated = rows.select("cause", "remedy").distinct()
    own = causes.select("symptom", "cause").distinct().join(treated.groupBy("cause").agg(F.count(F.lit(1)).alias("n")), "cause")
    few = firsts(own, "symptom", "cause").select("symptom", "cause").join(firsts(treated, "cause", "remedy").select("cause", "remedy"), "cause")
    kept = firsts(few, "symptom", "cause", "remedy").join(own.groupBy("symptom").agg(F.sum("n").alias("all")), "symptom")
    stands = F.when(F.col("nth") == 1, F.greatest(F.col("all") - (most - 1), F.lit(1))).otherwise(F.lit(1)).cast("long")
    equipment = rows.groupBy("symptom").agg(F.max_by("equipment", "row_no").alias("equipment"))
    return kept.join(equipment, "symptom").select("symptom", "cause", "remedy", "equipment", stands.alias("stands"))


def code_similarity(left: Column, right: Column) -> Column:
    """1 less a third of the least distance between strict codes of two texts; 0 beyond three edits or without codes."""
    distances = F.flatten(F.transform(T.strict_codes(left), lambda a: F.transform(T.strict_codes(right), lambda b: F.levenshtein(a, b))))
    least = F.array_min(distances)
    return F.when(least <= 3, 1 - least / 3).otherwise(F.lit(0.0))


def build_dense(rows: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """Paths of the merged graph after similarity edges and one hop of propagation."""
    return expand(propagate(rows, similarity_edges(rows.select("symptom"), least, k)), rows)


def collect_scored(ranked: DataFrame, paths: DataFrame, most: int = 3, by_equipment: str | None = None) -> DataFrame:
    """Each query's best paths of its ranked symptoms (query_id, symptom, score, rank): distinct triplets.

    Ordered by score, rank, cause and remedy; ``place`` counts from 1 within a query. ``by_equipment``
    names the column of ranked that holds the only equipment a query wants.
    """
    rows = paths.join(ranked, "symptom")
    if by_equipment:
        rows = rows.where(F.col("equipment") == F.col(by_equipment))
    first = F.row_number().over(Window.partitionBy("query_id", "symptom", "cause", "remedy").orderBy("rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "cause", "remedy")
    kept = rows.withColumn("nth", first).where("nth = 1").withColumn("place", F.row_number().over(order).cast("long"))
    return kept.where(F.col("place") <= most).select("query_id", "place", "symptom", "cause", "remedy", "equipment", "score")


def collect_sparse(ranked: DataFrame, most: int = 3) -> DataFrame:
    """Each query's triplets in order of arrival (query_id, triplet_id, rank and the triplet), once each."""
    nth = F.row_number().over(Window.partitionBy("query_id", "triplet_id").orderBy("rank"))
    once = ranked.withColumn("nth", nth).where("nth = 1").drop("nth")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "triplet_id"))
    return once.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("query_id", "place", "triplet_id", "symptom", "cause", "remedy", "equipment", "score")


def property_presence(graph_nodes: DataFrame, *names: str) -> DataFrame:
    """One row: nodes, and for each property how many have it."""
    return graph_nodes.agg(F.count(F.lit(1)).alias("nodes"), *(F.count(n).alias(f"with_{n}") for n in names))


def orphans(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = graph_edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return graph_nodes.join(ends, "name", "left_anti")


def remedy_sharing(paths: DataFrame) -> DataFrame:
    """Counts over ordered pairs of different symptoms with the same cause and remedy."""
    p = paths.select("symptom", "cause", "remedy").dropna().distinct()
    sizes = p.groupBy("cause", "remedy").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = p.join(sizes, ["cause", "remedy"])
    total = sharing_pairs(shared.select("symptom", F.sha2(F.to_json(F.struct("cause", "remedy")), 256).alias("g")))
    return shared.agg(F.count_distinct("remedy").alias("remedies"), F.count_distinct("cause").alias("causes")).crossJoin(total)


def relation_sharing(rows: DataFrame) -> DataFrame:
    """remedy_sharing() of all paths of a relation (symptom, cause, remedy), none of which is written.

    The paths of a symptom are all remedies of its causes, so two symptoms share a cause and remedy where they share a
    cause that has a remedy.
    """
    own = rows.select("symptom", "cause").dropna().distinct()
    treated = rows.select("cause", "remedy").dropna().distinct()
    causes = own.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(treated, "cause", "left_semi")
    total = sharing_pairs(own.join(causes, "cause", "left_semi").select("symptom", F.sha2("cause", 256).alias("g")))
    counts = treated.join(causes, "cause", "left_semi").agg(F.count_distinct("remedy").alias("remedies"), F.count_distinct("cause").alias("causes"))
    return counts.crossJoin(total)


def sharing_pairs(members: DataFrame) -> DataFrame:
    """pairs: how many ordered pairs of different symptoms share a group; members: distinct (symptom, g), g a digest.

    Symptoms with the same set of groups are one profile, groups with the same profiles one class; both are known by
    256-bit digests. A pair of profiles is counted by its sizes, so the pairs within a group are not written; pairs of
    different profiles are those that meet in a class. Each is counted in the first class that both are in and not
    written either. Of a class SHARE profiles at most meet all in one task.
    """
    digest = lambda names: F.sha2(F.array_join(F.array_sort(F.collect_set(names)), ""), 256)
    own = members.groupBy("symptom").agg(digest("g").alias("profile"), F.collect_set("g").alias("groups"))
    profiles = own.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.first("groups").alias("groups"))
    met = profiles.select("profile", "n", F.explode("groups").alias("g"))
    kinds = met.groupBy("g").agg(digest("profile").alias("kind"), F.collect_set(F.struct("profile", "n")).alias("held"))
    classes = kinds.groupBy("kind").agg(F.first("held").alias("held"))
    parted = classes.withColumn("parts", F.ceil(F.size("held") / SHARE).cast("int"))
    each = parted.select(F.struct("kind", "parts").alias("c"), F.explode("held").alias("h")).groupBy("h").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    each = each.select(F.col("h.profile").alias("p"), F.col("h.n").alias("n"), F.col("cs.kind").alias("ks"), F.explode("cs").alias("c")).select("p", "n", "ks", "c.kind", "c.parts")
    left = each.select("kind", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int").alias("part"), F.col("p").alias("p1"), F.col("n").alias("n1"), F.col("ks").alias("ks1"))
    right = each.select("kind", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("p").alias("p2"), F.col("n").alias("n2"), F.col("ks").alias("ks2"))
    pairs = left.join(right, ["kind", "part"]).where("p1 <= p2").where(F.get(F.array_intersect("ks1", "ks2"), F.lit(0)) == F.col("kind"))
    count = F.when(F.col("p1") == F.col("p2"), F.col("n1") * (F.col("n1") - 1)).otherwise(2 * F.col("n1") * F.col("n2"))
    return pairs.agg(F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("pairs"))


def pairwise_cosine(vectors: DataFrame, key: str, least: float = 0.8, k: int = 5) -> DataFrame:
    """src, dst, score: the k nearest others of each vector (key, embedding) above a threshold; a vector is not its own."""
    asked = vectors.select(F.col(key).alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vector_search(asked, vectors, k + 1, least, key).where(F.col(key) != F.col("query_id"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("query_id").alias("src"), F.col(key).alias("dst"), "score")


def cosine_edges(symptoms: DataFrame, least: float = 0.8, k: int = 5, embedder=embed) -> DataFrame:
    """The edges of similarity_edges() by vectors alone: what remains where words and codes cannot be compared."""
    return pairwise_cosine(embedded(symptoms.select("symptom").distinct(), F.col("symptom"), embedder), "symptom", least, k)


def combined_edges(rows: DataFrame, least: float = 0.8, k: int = 5, embedder=embed) -> DataFrame:
    """Edges between symptoms whose combined texts are alike: each text travels with its own symptom."""
    return pairwise_cosine(embedded(with_combined_text(rows), F.col("combined_text"), embedder), "symptom", least, k)


def build_sparse(rows: DataFrame) -> DataFrame:
    """The sparse graph's paths: one a triplet, nothing merged."""
    return rows.select(F.col("row_no").alias("triplet_id"), "symptom", "cause", "remedy", "equipment")


def build_combined(rows: DataFrame, least: float = 0.8, k: int = 5, embedder=embed) -> DataFrame:
    """Paths of the graph with combined texts after its similarity edges and one hop of propagation."""
    return expand(propagate(rows, combined_edges(rows, least, k, embedder)), rows).join(with_combined_text(rows), "symptom")
