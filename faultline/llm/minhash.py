"""MinHash near-duplicate groups: universal hash minima, banding, signature verification, full-set confirmation, and
connected components by alternating large-star and small-star.

A document's set holds its distinct five-word shingles (words split at ASCII white space, A-Z lower-cased); a
document of fewer words is one shingle. Documents with equal sets form a class, and only the smallest doc_id of a
class goes on. ``percent`` is the least similarity, 80 unless the caller sets another (op5 sets 85). Classes that agree
in a band of four minima are candidates; 32 bands miss a pair at similarity 0.80 with a probability of 5e-8, one at
0.85 below 1e-10. Pairs whose 128-value signatures agree in less than six standard deviations below ``percent`` (55 %
for 80, 65 % for 85) are dropped, and so are those whose fine sketches (the least hash in each of 1024 ranges, four
bits each) lie six standard deviations below it; the rest are confirmed on full sets of words, not hashes:
``100 * intersection >= percent * union``. That sets are equal is told by a 128-bit digest of their sorted 64-bit hashes.

All pairs of a bucket are never written out. Pass A compares each member of a bucket with the bucket's smallest
member, and joins what is confirmed. Pass B looks at buckets that still hold several components, and only at pairs
across components. A bucket of over ``bucket_rows`` rows is cut into blocks, and a task compares two of them. That
copies a row once for each block, so a bucket of more blocks than there are bands is first split by the later bands:
twice at 0.85, where a pair shares 17 bands on average and under three with a probability of 3e-8; once at 0.80, where
it shares 13 and under two with a probability of 1e-6. A pair is looked at where its bucket's bands are the first that
it shares. So no task gets an unbounded bucket, and no pair is left out for the size of its bucket.

Defined cases: null texts and texts without words have the empty set (n_shingles 0), link with nothing and are
kept; rows with equal doc_id and equal text fall in one class; empty tables give no rows; other columns are not read.
near_duplicates() labels a row without doc_id with its class's id, or null, and leaves kept null. deduplicate() needs no
ids: it keeps one row of each group, repeated rows and rows without doc_id (which come last in the order) included.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, slices, text_bytes

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Least similarity unless a caller sets another.
PERCENT = 80
BUCKET_ROWS = 2048
#: Buckets of more blocks are split by the later bands: blocks would copy a row more often than bands do.
BANDS_COPIED = BANDS
#: Shingles of earlier texts that a task keeps while it confirms pairs.
KEPT_SHINGLES = 100_000
#: Ranges of the fine sketch.
BINS = 1024
_rng = np.random.default_rng(20240601)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
_S31, _S32 = np.uint64(31), np.uint64(32)


def agree(percent: int) -> float:
    """Least share of equal minima for a pair to be confirmed on full sets: six deviations lower, in steps of 0.05."""
    share = percent / 100
    return math.floor(20 * (share - 6 * math.sqrt(share * (1 - share) / HASHES))) / 20


def splits(percent: int) -> int:
    """How often (twice at most) a large bucket may be split by later bands: a pair must share one band more each time."""
    p = (percent / 100) ** ROWS
    missed = np.cumsum([math.comb(BANDS, k) * p**k * (1 - p) ** (BANDS - k) for k in range(3)])
    return int(np.count_nonzero(missed[1:] <= 1e-5))


class _WordHash(dict):
    """64-bit hashes of words; a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHash()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(words))
    out = codes[: len(codes) - n + 1].copy()
    for j in range(1, n):
        out ^= out >> _S31
        out *= _M
        out += codes[j : len(codes) - n + 1 + j]
    out ^= out >> _S32
    out *= _M
    out ^= out >> _S31
    return np.unique(out)


def signature(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """The minima of HASHES universal hashes of a set (multiply and add); 16 bits of each are kept."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), block):
        part = shingles[at : at + block]
        np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (least >> _S32).astype(np.uint16)


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """Of the least hash in each of BINS equal ranges four bits, two to a byte; 0 for a range without any."""
    out = np.zeros(BINS, dtype=np.uint8)
    bins = (shingles >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.append(len(bins) > 0, bins[1:] != bins[:-1])[: len(bins)])
    out[bins[first]] = shingles[first] % np.uint64(15) + np.uint64(1)
    return out[::2] << 4 | out[1::2]


def unpacked(fine: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(fine), dtype=np.uint8).reshape(-1, BINS // 2)
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(-1, BINS)


def likely(a: np.ndarray, b: np.ndarray, both: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether fine sketches (rows of a and b) are what similar sets may have; both: the sum of the sets' sizes.

    The least hashes are a sample of the union without replacement, so the number of equal ones is hypergeometric.
    Chance agreement of four bits only adds to it.
    """
    equal = np.count_nonzero((a == b) & (a > 0), axis=1)
    drawn = np.count_nonzero(a | b, axis=1)
    share = percent / 100
    left_out = np.maximum(0, 1 - drawn * (1 + share) / np.maximum(both, 1))
    return equal >= share * drawn - 6 * np.sqrt(drawn * share * (1 - share) * left_out) - 2


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit hash as two longs, signature and fine sketch (null for an empty set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, high, low, signatures, fine = [], [], [], [], []
            for text in text_bytes(batch["text"]):
                own = shingle_set(text)
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                sizes.append(len(own))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & (2**64 - 1)) - (1 << 63))
                signatures.append(signature(own).tobytes() if len(own) else None)
                fine.append(fine_sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signatures, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n_shingles", "set_high", "set_low", "signature", "fine"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, n_shingles long, set_high long, set_low long, signature binary, fine binary")


def _band(k: int):
    return F.xxhash64(F.lit(k), F.substring("signature", 2 * ROWS * k + 1, 2 * ROWS))


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough, by a comparison in Arrow batches."""
    both = pairs
    for c in ("b", "a"):
        both = both.join(classes.select(F.col("id").alias(c), F.col("signature").alias(f"s{c}"), F.col("fine").alias(f"f{c}"), F.col("n_shingles").alias(f"n{c}")), c)
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb", "fa", "fb", (F.col("na") + F.col("nb")).alias("n"))

    least = agree(percent) * HASHES

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
            ok = (a == b).sum(axis=1) >= least
            ok &= likely(unpacked(batch["fa"].to_pylist()), unpacked(batch["fb"].to_pylist()), batch["n"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(keep, "a long, b long")


def word_shingles(text: bytes | None) -> set[tuple[bytes, ...]]:
    """A text's shingles themselves."""
    words = text.lower().split() if text else []
    n = min(SHINGLE, len(words))
    return set(zip(*(words[k : len(words) - n + 1 + k] for k in range(n)), strict=True))


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    shared = len(a & b)
    return 100 * shared >= percent * (len(a) + len(b) - shared) and shared > 0


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets; texts of pairs only are moved."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = texts.join(wanted, "id", "left_semi")
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(own.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, set] = OrderedDict()

        def of(key: int, text: bytes) -> set:
            if key not in recent:
                recent[key] = word_shingles(text)
                while len(recent) > 1 and sum(map(len, recent.values())) > KEPT_SHINGLES:
                    recent.popitem(last=False)
            return recent[key]

        for batch in slices(batches, 64):
            ids = zip(batch["a"].to_pylist(), text_bytes(batch["ta"]), text_bytes(batch["tb"]), strict=True)
            keep = [similar(of(a, ta), word_shingles(tb), percent) for a, ta, tb in ids]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _across(rows: DataFrame, classes: DataFrame, bucket_rows: int, percent: int) -> DataFrame:
    """Agreeing pairs across components of each bucket; rows: key, bands, id, component, n (rows of the bucket)."""
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    tiled = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(77)), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiled = tiled.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "bands", "id", "component")

    least = agree(percent) * HASHES

    def pairs(table: pa.Table) -> pa.Table:
        bands, apart = table["bands"][0].as_py(), table["i"][0].as_py() != table["j"][0].as_py()
        ids, comps, sizes, block = (table[c].to_numpy() for c in ("id", "component", "n_shingles", "block"))
        order = np.lexsort((ids, sizes))
        ids, comps, sizes, block = ids[order], comps[order], sizes[order], block[order]
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(-1, HASHES)[order]
        fine = unpacked(table["fine"].to_pylist())[order]
        last = np.searchsorted(sizes, 100 * sizes // percent, side="right")  # no larger set can be similar
        left, right = [], []
        for k in range(len(ids) - 1):
            near = k + 1 + np.flatnonzero(comps[k + 1 : last[k]] != comps[k])
            if apart:
                near = near[block[near] != block[k]]
            if near.size:
                same = sig[near] == sig[k]
                shared = same.reshape(-1, BANDS, ROWS).all(axis=2)[:, : bands[-1] + 1]  # the bands must be the first shared
                near = near[(same.sum(axis=1) >= least) & shared[:, bands].all(axis=1) & (shared.sum(axis=1) == len(bands))]
            if near.size:
                near = near[likely(fine[near], fine[k], sizes[near] + sizes[k], percent)]
                left += [ids[k]] * near.size
                right += ids[near].tolist()
        a, b = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return tiled.join(classes, "id").groupBy("key", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge; alternating large-star and small-star."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = state(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialise(small, "edges", edges)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return members.union(members.select("component", "component").distinct())


def _bands(rows: DataFrame, *carried: str) -> DataFrame:
    return rows.select("id", *carried, F.posexplode(F.array(*[_band(k) for k in range(BANDS)])).alias("band", "key"))


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, n) of the buckets that hold several components."""
    return rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 <> c1").select("key", "n")


def link_classes(classes: DataFrame, texts: DataFrame, bucket_rows: int = BUCKET_ROWS, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the classes that link with another; classes: id, n_shingles, signature, fine."""
    bands = _bands(classes)
    first = bands.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = bands.join(first, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    edges = materialise(_confirmed(_agreeing(stars, classes, percent), texts, percent), "links")
    members = materialise(components(edges), "members")
    # Pass B: what buckets with several components still hide.
    labelled = classes.join(members, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keyed = _bands(labelled, "component")
    open_rows = materialise(keyed.join(_mixed(keyed), "key").select("key", F.array("band").alias("bands"), "id", "component", "n"), "open")
    most = BANDS_COPIED * bucket_rows
    rows, large = open_rows.where(F.col("n") <= most), open_rows.where(F.col("n") > most)
    for _ in range(splits(percent)):
        if large.isEmpty():
            break
        later = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64("key", _band(k)).alias("inner")) for k in range(BANDS)]), lambda x: x["k"] > F.element_at("bands", -1))
        again = large.join(classes.select("id", "signature"), "id").select("id", "component", "bands", F.explode(later).alias("next"))
        again = again.select(F.col("next.inner").alias("key"), F.concat("bands", F.array("next.k")).alias("bands"), "id", "component")
        split = materialise(again.join(_mixed(again), "key"), "open")
        rows, large = rows.union(split.where(F.col("n") <= most)), split.where(F.col("n") > most)
    rows = rows.union(large)
    found = materialise(_across(rows, classes, bucket_rows, percent), "across")
    more = materialise(_confirmed(found, texts, percent), "links")
    if more.isEmpty():
        return members
    return components(edges.union(more))


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    found = materialise(sketches(docs), "sketches")
    classes = found.where("n_shingles > 0").groupBy("set_high", "set_low").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.min("fine").alias("fine"))
    classes = materialise(classes, "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    members = link_classes(classes.select("id", "n_shingles", "signature", "fine"), texts, bucket_rows, percent)
    labels = classes.select("id", "set_high", "set_low").join(members, "id", "left").select(F.col("set_high").alias("h"), F.col("set_low").alias("l"), F.coalesce("component", "id").alias("component"))
    out = found.select("doc_id", "n_shingles", "set_high", "set_low").join(labels, (F.col("set_high") == F.col("h")) & (F.col("set_low") == F.col("l")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which each group keeps one, with all columns.

    Where ids are null or repeat, the place in the order of doc_id stands for them; the order of unique ids is the same.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    kept_id, place, row = (free_name(n, docs) for n in ("kept_id", "place", "row"))
    if ids.isEmpty():
        kept = near_duplicates(docs, percent=percent).where("kept").select(F.col("doc_id").alias(kept_id))
        return docs.join(kept, F.col("doc_id") == F.col(kept_id), "left_semi")
    ordered = docs.withColumn(row, F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), row).drop(row)
    placed = materialise(ordered.withColumn(place, F.monotonically_increasing_id()), "placed")
    kept = near_duplicates(placed.select(F.col(place).alias("doc_id"), "text"), percent=percent).where("kept").select(F.col("doc_id").alias(kept_id))
    return placed.join(kept, F.col(place) == F.col(kept_id), "left_semi").drop(place)


def brute_force(docs: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """The rows of near_duplicates(), by comparing all pairs (tests)."""
    sets = [word_shingles((text or "").encode()) for _, text in docs]
    label = list(range(len(docs)))

    def root(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(docs):
        least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return [(d, len(sets[k]), least[root(k)], least[root(k)] == d) for k, (d, _) in enumerate(docs)]
