"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training windows.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A window is
ten consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A rolling hash of
word ids finds candidate windows in a bitmap; each candidate is then compared with the window's own words.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text (an item is never cut). A worker turns a block
into arrays: word ids, and for each distinct window its hash, its first place and its items, about 30 bytes a window.
Documents are read in chunks of CHUNK_BYTES; each chunk meets the blocks one after another. Sets of up to KEPT_BYTES are
kept for the next chunk, others are built anew, so memory depends on none of the tables' sizes.

Defined cases: null and empty texts have no words and are clean; an item without words has no window; equal items
count once for each distinct item_id; items without item_id count as one item, which items_sha256 does not name (as in
the SQL); a null doc_id is judged as any other; rows with equal doc_id are judged one by one; empty tables give empty (or all
clean) results; other columns of either table are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Text of the benchmark that one broadcast holds at most.
BLOCK_BYTES = 4_000_000
#: Text of documents that meets all blocks at once, and bytes of window sets that a worker keeps.
CHUNK_BYTES = 16_000_000
KEPT_BYTES = 150_000_000
BITS = 22


def _by_name(item: str | None) -> tuple[bool, str]:
    return item is not None, item or ""


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Windows:
    """The distinct windows of n words: sorted hashes, the place of one of each, and the items of each."""

    def __init__(self, n: int, starts: np.ndarray, owner: np.ndarray, ids: np.ndarray, hashes: np.ndarray):
        def same_words(order: np.ndarray) -> np.ndarray:
            a, b = starts[order[1:]], starts[order[:-1]]
            return np.all([ids[a + j] == ids[b + j] for j in range(n)], axis=0)

        order = np.lexsort((owner, hashes))
        new = np.append(True, ~same_words(order))
        if np.any(new[1:] & (hashes[order[1:]] == hashes[order[:-1]])):  # different windows share a hash
            order = np.lexsort((owner, *(ids[starts + j] for j in range(n)), hashes))
            new = np.append(True, ~same_words(order))
        self.n, self.first, self.hashes = n, starts[order][new], hashes[order][new]
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max())
        group = np.cumsum(new) - 1
        owner = owner[order]
        once = np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1]))
        self.items = owner[once].astype(np.int32)
        self.bounds = np.searchsorted(group[once], np.arange(len(self.first) + 1))
        self.bitmap = np.zeros(1 << BITS, dtype=bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITS)] = True

    def nbytes(self) -> int:
        return self.first.nbytes + self.hashes.nbytes + self.items.nbytes + self.bounds.nbytes + self.bitmap.nbytes

    def hits(self, codes: np.ndarray, stream: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a stream of word ids where a window stands, and which one; compared word by word."""
        if len(codes) < self.n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = rolled(codes, self.n)
        at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITS)])
        left = np.searchsorted(self.hashes, h[at])
        out = []
        for d in range(self.most):
            g = left + d
            ok = g < len(self.hashes)
            p, g = at[ok], g[ok]
            ok = self.hashes[g] == h[p]
            p, g = p[ok], g[ok]
            for j in range(self.n):
                ok = stream[p + j] == ids[self.first[g] + j]
                p, g = p[ok], g[ok]
            out.append((p, g))
        return np.concatenate([p for p, _ in out]), np.concatenate([g for _, g in out])


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    out = codes[: len(codes) - n + 1].copy()
    for j in range(1, n):
        out *= _MULTIPLIER
        out += codes[j : len(codes) - n + 1 + j]
    return out * _MULTIPLIER


class WindowSet:
    """The windows of one block of benchmark items, by word count."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        parts, sizes = [], []
        for _, text in items:
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            parts.append(own)
            sizes.append(len(own))
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.code = np.random.default_rng(7).integers(1, 2**63, len(self.vocabulary) + 1, dtype=np.uint64)
        size = np.array(sizes, dtype=np.int64)
        begin = np.cumsum(size) - size
        lengths = np.minimum(size, window)
        codes = self.code[self.ids]
        self.windows = []
        for n in np.unique(lengths[lengths > 0]).tolist():
            of = np.flatnonzero(lengths == n)
            count = size[of] - n + 1
            owner = np.repeat(of, count)
            starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
            self.windows.append(Windows(n, starts, owner, self.ids, rolled(codes, n)[starts]))

    def nbytes(self) -> int:
        return self.ids.nbytes + self.code.nbytes + 120 * len(self.vocabulary) + sum(w.nbytes() for w in self.windows)

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None]]]:
        """For each text: its word count, the maximal hit runs [start, end) of words, and the items found."""
        docs = [words_of(t) if t else [] for t in texts]
        stream: list[bytes] = []
        starts = []
        for words in docs:
            starts.append(len(stream))
            stream += words
            stream.append(b"\x00")  # no word: windows never cross documents
        ids = np.fromiter(map(self.vocabulary.get, stream, repeat(0)), dtype=np.int32, count=len(stream))
        codes = self.code[ids]
        runs: list[list[tuple[int, int]]] = [[] for _ in docs]
        names: list[set[str | None]] = [set() for _ in docs]
        for own in self.windows:
            p, g = own.hits(codes, ids, self.ids)
            doc = np.searchsorted(starts, p, side="right") - 1
            for at, k in zip(p.tolist(), doc.tolist(), strict=True):
                runs[k].append((at - starts[k], at - starts[k] + own.n))
            for k, window in set(zip(doc.tolist(), g.tolist(), strict=True)):
                names[k].update(self.names[i] for i in own.items[own.bounds[window] : own.bounds[window + 1]].tolist())
        for words, own_runs, own_names in zip(docs, runs, names, strict=True):
            yield len(words), merged(own_runs), own_names


_sets: OrderedDict[str, WindowSet] = OrderedDict()


def _window_set(shared) -> WindowSet:
    """Built in each Python worker; sets of KEPT_BYTES together (one at least) are kept."""
    name = shared.value[0]
    if name not in _sets:
        _sets[name] = WindowSet(shared.value[1], shared.value[2])
        while len(_sets) > 1 and sum(s.nbytes() for s in _sets.values()) > KEPT_BYTES:
            _sets.popitem(last=False)
    return _sets[name]


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark's items as broadcasts, each of a checked size; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    out, rows, size = [], [], 0
    for r in items.toLocalIterator():
        text = r["text"].encode()
        if rows and size + len(text) + 64 > block_bytes:
            out.append(context.broadcast((uuid.uuid4().hex, rows, window)))
            rows, size = [], 0
        rows.append((r["item"], text))
        size += len(text) + 64
    if rows:
        out.append(context.broadcast((uuid.uuid4().hex, rows, window)))
    return out


Found = list[tuple[int, list[tuple[int, int]], set[str | None]]]


def _scanned(batches: Iterator[pa.RecordBatch], blocks: list, answer: Callable[[pa.RecordBatch, list[bytes | None], Found], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents against all blocks; ``answer`` gets slices with their texts and what was found in each."""
    held: list[tuple[pa.RecordBatch, list[bytes | None]]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found: list[Found] = [[(len(words_of(t)) if t else 0, [], set()) for t in texts] for _, texts in held] if not blocks else [[] for _ in held]
        for shared in blocks:
            own = _window_set(shared)
            for k, (_, texts) in enumerate(held):
                new = list(own.scan(texts))
                found[k] = new if not found[k] else [(n, merged(a + b) if b else a, x | y) for (n, a, x), (_, b, y) in zip(found[k], new, strict=True)]
        for (batch, texts), own_found in zip(held, found, strict=True):
            yield answer(batch, texts, own_found)

    for batch in slices(batches):
        texts = text_bytes(batch["text"])
        held.append((batch, texts))
        size += sum(len(t) for t in texts if t)
        if size >= (CHUNK_BYTES if len(blocks) > 1 else 0):
            yield from flush()
            held, size = [], 0
    yield from flush()


_SCANNED = "doc_id long, text string, n_words long, runs array<struct<start:long,stop:long>>, items array<string>"


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, text, n_words, the hit runs of words and the items found."""
    blocks = benchmark_blocks(benchmark, window, block_bytes)

    def answer(batch: pa.RecordBatch, texts: list[bytes | None], found: Found) -> pa.RecordBatch:
        runs = [[{"start": a, "stop": b} for a, b in own] for _, own, _ in found]
        items = [sorted(names, key=_by_name) for _, _, names in found]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "runs", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scanned(batches, blocks, answer), _SCANNED)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(found: DataFrame) -> DataFrame:
    """The digest columns of find_windows()."""
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(runs, 0L, (n, r) -> n + r.stop - r.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def without_spans(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    """The text without the words of the runs and what stands between them."""
    if text is None or not runs:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """Documents without benchmark passages: hit documents go, or (remove="spans") their hit words only."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    columns = docs.columns
    blocks = benchmark_blocks(benchmark, window)

    def answer(batch: pa.RecordBatch, texts: list[bytes | None], found: Found) -> pa.RecordBatch:
        if remove == "documents":
            return batch.filter(pa.array([not own for _, own, _ in found], pa.bool_()))
        left = [without_spans(None if t is None else t.decode(), own) for t, (_, own, _) in zip(texts, found, strict=True)]
        arrays = {name: batch[name] for name in columns} | {"text": pa.array(left, batch["text"].type)}
        if "n_chars" in arrays:
            arrays["n_chars"] = pa.array([n if not own else len(t or "") for n, (_, own, _), t in zip(batch["n_chars"].to_pylist(), found, left, strict=True)], batch["n_chars"].type)
        return pa.RecordBatch.from_arrays([arrays[name] for name in columns], names=columns)

    return docs.mapInArrow(lambda batches: _scanned(batches, blocks, answer), docs.schema)


def brute_force(docs: list[tuple[int, str | None]], benchmark: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The rows of report(), by comparing every window with every position (tests)."""
    items = [(None if i is None else str(i), words_of((t or "").encode())) for i, t in benchmark]
    out = []
    for doc_id, text in docs:
        words, hit, names = words_of((text or "").encode()), set(), set()
        for item, own in items:
            n = min(window, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[a : a + n]:
                        hit.update(range(p, p + n))
                        names.add(item)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), bool(hit)))
    return out
