"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections, in DataFrame functions only.

A text is cut at line feeds into paragraphs, a paragraph after ``.``, ``!`` or ``?`` and a blank into sentences, and
eight paragraphs in a row make a section. Leaves are SHA-256 digests of sentences; a node is the digest of its
children's, marked with its level. The cuts lose nothing, so equal roots mean equal texts, and where two roots differ,
the differing sections, paragraphs and leaves locate the edit. The likeness of two fingerprints is the Dice
coefficient of their trees' distinct leaves: 1 for equal texts, 0 for texts without a common sentence.

Neighbours by ascending doc_id are found without a global sort: texts are dealt by blocks of doc_id, and the first row
of each block goes to the block before it, too. A block is a range of ids as wide as holds BLOCK rows on average, so dense
and evenly spread (hashed) ids make even blocks; ids in few tight clusters far apart make larger ones.

Defined cases: a null text is the empty one; rows with equal doc_id are ordered by their text's digest; a single row
is its own next document; a null doc_id sorts first; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = 8
BLOCK = 512


def leaves(text: Column) -> Column:
    """array<array<string>>: the sentences' digests of each paragraph."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.split(p, "(?<=[.!?]) "), lambda s: F.sha2(s, 256)))


def paragraphs(tree: Column) -> Column:
    return F.transform(tree, lambda p: F.sha2(F.concat(F.lit("p"), F.array_join(p, "")), 256))


def sections(nodes: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(SECTION))
    return F.transform(starts, lambda k: F.sha2(F.concat(F.lit("s"), F.array_join(F.slice(nodes, k, F.lit(SECTION)), "")), 256))


def root(nodes: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.array_join(nodes, "")), 256)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct leaves."""
    return F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the tree: ``leaves``, ``paragraphs``, ``sections`` and ``fingerprint`` (its root)."""
    out = df.withColumn("leaves", leaves(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("paragraphs", paragraphs(F.col("leaves")))
    out = out.withColumn("sections", sections(F.col("paragraphs")))
    return out.withColumn("fingerprint", root(F.col("sections")))


def differing(a: Column, b: Column) -> Column:
    """0-based indexes at which two arrays of nodes differ, up to the longer one's end."""
    longest = F.greatest(F.size(a), F.size(b))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k)))


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text and the text of the next document, ascending doc_id; after the last comes the first."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high"), F.count("doc_id").alias("n")).first()
    width = max(1, (ids["high"] - ids["low"] + 1) * block // ids["n"]) if ids["n"] else 1
    place = F.coalesce(F.expr(f"doc_id div {min(width, 2**62)}"), F.lit(-(2**62) - 1))
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy(place.alias("place")).agg(F.min("doc_id").alias("first"))
    # The block before each block that holds rows, found within blocks of blocks and across their ends.
    outer = F.expr("floor(place / 4096)")
    tops = used.groupBy(outer.alias("top")).agg(F.max("place").alias("last"))
    before_top = tops.select("top", F.lag("last").over(Window.orderBy("top")).alias("before_top"), F.max("last").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("very_last"))
    linked = used.withColumn("top", outer).withColumn("before_here", F.lag("place").over(Window.partitionBy("top").orderBy("place"))).join(F.broadcast(before_top), "top")
    linked = linked.select("first", F.coalesce("before_here", "before_top", "very_last").alias("before"))
    # A block's first row also goes to the block before it, as a guest that comes last there. There is one such row
    # in `block`; Spark broadcasts them only while they are few, and else shuffles by doc_id.
    guests = own.join(linked, F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("before").alias("place"), F.lit(1).alias("guest"))
    both = own.select("doc_id", "text", place.alias("place"), F.lit(0).alias("guest")).union(guests)
    order = Window.partitionBy("place").orderBy("guest", "doc_id", F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter the next document's beginning replaces."""
    n = F.length("text")
    replaced = F.floor(n / 4).cast("int")
    both = with_next(docs).withColumn("n_chars", n.cast("long"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - replaced), F.substring(F.col("next_text"), F.lit(1), replaced)))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), leaves(F.col("text")).alias("own"), leaves(F.col("edited")).alias("new"), leaves(F.col("next_text")).alias("after"))
    both = both.select("doc_id", "n_chars", "edited_sha256", *(paragraphs(F.col(c)).alias(f"p_{c}") for c in ("own", "new")), *(F.array_distinct(F.flatten(c)).alias(f"l_{c}") for c in ("own", "new", "after")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(sections(F.col("p_own"))).alias("fingerprint"),
        root(sections(F.col("p_new"))).alias("edited_fingerprint"),
        likeness(F.col("l_own"), F.col("l_new")).alias("near_edited"),
        likeness(F.col("l_own"), F.col("l_after")).alias("near_next"),
    )
