"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only lengths matter to a packing, so the packing is planned on the histogram of piece lengths: at most ``capacity``
rows, however many documents there are. The plan is a list of segments "the pieces of length L with ranks a..b go to
sequences s.., at offset o"; each step of the planner uses up a length or a group of equally filled sequences, so the
plan, too, is bounded by the capacity. Pieces are then ranked within their length, and looked up in the plan.

1. Dominance reduction (Martello and Toth), over all remaining pieces j from the longest down, again and again until
   nothing more can be fixed. A set with j dominates if the pieces of any other set with j fit into its pieces' places;
   it is fixed for good and taken from the instance. Let i be the longest piece that fits beside j.
   {j} dominates if no piece fits beside j; {j, i} if it fills the sequence, if no two pieces fit beside j, or if at
   most two do and no pair is longer than i; {j, i, b} if at most two fit, b is the longest third piece, and each pair
   of pieces that are both longer than b fits into the place of i.
2. Best-fit decreasing on what remains: each length goes to the fullest sequences that still have room.

Defined cases: null and empty texts are one token (the end id); rows with equal doc_id get their own pieces; ties of
length are ranked by their place in the stored table of pieces; null doc_ids are packed as any other; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

CAPACITY = 4096
END_ID = 1
#: Words, and pre-tokens, whose ids a Python worker keeps, and the longest that it keeps: about 200 MB together.
CACHE_WORDS = 500_000
CACHE_LENGTH = 64
# The tokenizer's pre-token pattern, for lower-cased texts whose characters are all of _PLAIN.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: Characters on which this pattern, Python's lower() and white space surely agree with the tokenizer's.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")


class WordEncoder:
    """Ids of a tokenizer that lower-cases, drops white space and ends each pre-token with a marked token.

    The ids of a text are those of its pre-tokens in a row, so pre-tokens are encoded once and kept. A text with
    other characters than _PLAIN, or with the strings of special tokens, goes through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def exact(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(missing):  # a vocabulary without marked ends
            return {w: self.exact(w) for w in missing}
        raw, out, at = ids.tobytes(), {}, 0
        for w, stop in zip(missing, (4 * stops).tolist(), strict=True):
            out[w] = raw[at:stop]
            at = stop
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        words = [t.split() if ok else [] for t, ok in zip(texts, plain, strict=True)]
        found = [list(map(self.words.get, own)) for own in words]
        unknown = {w for own, ids in zip(words, found, strict=True) if None in ids for w, i in zip(own, ids, strict=True) if i is None}
        if unknown:
            learnt = self._words(list(unknown))
            for own, ids in zip(words, found, strict=True):
                if None in ids:
                    ids[:] = [learnt[w] if i is None else i for w, i in zip(own, ids, strict=True)]
            if len(self.words) < CACHE_WORDS:
                self.words |= {w: i for w, i in learnt.items() if len(w) <= CACHE_LENGTH}
        return [b"".join(ids) if ok else self.exact(t) for t, ok, ids in zip(texts, plain, found, strict=True)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        parts = [_PRETOKEN.findall(w.lower()) for w in words]
        unknown = list({p for own in parts for p in own if p not in self.pretokens})
        learnt = self._learn(unknown) if unknown else {}
        if len(self.pretokens) < CACHE_WORDS:
            self.pretokens |= {p: i for p, i in learnt.items() if len(p) <= CACHE_LENGTH}
        kept = self.pretokens
        return {w: b"".join([kept[p] if p in kept else learnt[p] for p in own]) for w, own in zip(words, parts, strict=True)}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces of at most ``capacity`` ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), own.ids([t or "" for t in batch["text"].to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY, fit: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, count, first sequence, offset) that place all pieces; see the module's text.

    ``fit=False`` gives the reduction only: the pieces that it fixes.
    """
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(n: int, count: int, sequence: int, offset: int) -> None:
        out.append((n, used[n], count, sequence, offset))
        used[n] += count
        left[n] -= count

    lengths = sorted(left)

    def longest(most: int, without: tuple[int, ...] = ()) -> int:
        """The longest piece up to most, other than those named (once each); 0 if there is none."""
        k = bisect_left(lengths, most + 1) - 1
        while k >= 0 and left[lengths[k]] <= without.count(lengths[k]):
            k -= 1
        return lengths[k] if k >= 0 else 0

    def shortest_three(without: int) -> list[int]:
        out: list[int] = []
        for n in lengths:
            out += [n] * min(3 - len(out), left[n] - (n == without))
            if len(out) == 3:
                break
        return out

    def dominating(j: int) -> tuple[int, ...] | None:
        """The set with j that dominates all others, if one is known to."""
        room = capacity - j
        i = longest(room, (j,))
        if not i:
            return (j,)
        three = shortest_three(j)
        if i == room or len(three) < 2 or three[0] + three[1] > room:
            return (j, i)
        if len(three) == 3 and sum(three) <= room:
            return None
        pairs = [(x, y) for y in lengths if 2 * y <= room and left[y] > (y == j) and (x := longest(room - y, (j, y))) >= y]
        if all(x + y <= i for x, y in pairs):
            return (j, i)
        b = longest(room - i, (j, i))
        return (j, i, b) if b and all(y <= b or x + y <= i for x, y in pairs) else None

    reduced = True
    while reduced:
        reduced = False
        for j in sorted((n for n in lengths if left[n]), reverse=True):
            while left[j] and (found := dominating(j)):
                # What is taken away leaves the reasons as they are, so the set is fixed as often as its pieces last.
                count = min(left[n] // found.count(n) for n in found)
                offset = 0
                for n in found:
                    place(n, count, sequences, offset)
                    offset += n
                sequences += count
                reduced = True
        lengths = [n for n in lengths if left[n]]
    if not fit:
        return out
    # Best-fit decreasing: groups of equally filled sequences, by room.
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for n in reversed(lengths):
        while left[n]:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                each = capacity // n
                full = min(left[n], max(1, left[n] // each) if left[n] >= each else 1)
                first, count = sequences, full
                sequences += full
                add(capacity, first, count)
                continue
            room = rooms[k]
            first, size = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            fit = min(size, max(1, left[n] // (room // n)) if left[n] >= room // n else 1)
            times = min(room // n, left[n] // fit)
            for t in range(times):
                place(n, fit, first, capacity - room + t * n)
            add(room - times * n, first, fit)
            add(room, first + fit, size - fit)
    return out


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank``: 0.. within a length, without one task for a length; found: a stored table.

    Rows are numbered within the files of the table, each of which one task has written; a file's first rank is the
    count of all files before it. Window partitions have a row for each file, or the rows of one file.
    """
    found = found.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    counts = found.groupBy("length", "file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("file")) - F.col("n")
    bases = counts.select(F.col("length").alias("b_length"), F.col("file").alias("b_file"), before.alias("first_rank"))
    row = F.row_number().over(Window.partitionBy("length", "file").orderBy("row_index", "doc_id", "piece", "ids_crc32")) - 1
    numbered = found.withColumn("row", row).join(bases, (F.col("length") == F.col("b_length")) & (F.col("file") == F.col("b_file")))
    return numbered.withColumn("rank", F.col("first_rank") + F.col("row")).drop("file", "row_index", "row", "b_length", "b_file", "first_rank")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = materialise(pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = found.sparkSession.createDataFrame([tuple(map(int, r)) for r in plan(histogram, capacity)], "p_length long, p_rank long, p_count long, p_sequence long, p_offset long")
    by_length = rows.groupBy("p_length").agg(F.sort_array(F.collect_list(F.struct("p_rank", "p_count", "p_sequence", "p_offset"))).alias("segments"))
    placed = ranked(found).join(F.broadcast(by_length), F.col("length") == F.col("p_length"))
    # One segment of the length holds the rank.
    segment = F.expr("filter(segments, s -> s.p_rank <= rank and rank < s.p_rank + s.p_count)[0]")
    return placed.withColumn("segment", segment).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("segment.p_sequence") + F.col("rank") - F.col("segment.p_rank")).alias("sequence_id"), F.col("segment.p_offset").alias("offset"))
