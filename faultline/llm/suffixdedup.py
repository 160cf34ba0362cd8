"""Exact substring deduplication with a multi-document suffix order that is built column by column.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (smaller doc_id, or same document and
earlier start) is removed. Hashes only route: nothing is removed unless its bytes were compared.

1. Slices. Texts are stored in the shared folder as files of about SLICE_BYTES. A place is a slice, a row in it and a
   start; no text is shuffled after this.
2. Anchors. Each window of LENGTH bytes is owned by the position of the least hash among its 32-byte strings, so
   equal windows have equal anchors. Neighbouring windows with one anchor make a context of 100 to 168 bytes; about
   one byte in 35 is an anchor. Contexts with the same bytes as an earlier one of their slice go at once. For the
   others the anchors' hashes alone are sent to buckets: a context whose anchor is alone equals nothing.
3. Strings. The bytes of the contexts whose anchors repeat are cut from the slices and meet by anchor. Contexts of
   equal bytes are one string of the collection with several places: all but the earliest place go.
4. Suffix order. Strings whose anchor another string shares, cut to the windows that may be in both, are a collection.
   Each round inserts one more symbol of each string, from its end: ranks in the collection's Burrows-Wheeler
   transform give the new suffixes' places, and minima of the common prefixes between equal symbols give theirs (Bauer,
   Cox, Rosone and others). Transform and prefixes are two files in the shared folder, each round read front to back in
   blocks and written front to back anew; memory holds the newest suffixes and a block. Runs with common prefixes of
   LENGTH bytes are equal windows; all but the earliest go.
5. An anchor with over HOT contexts is dealt anew by each single window, and its windows are first made distinct within
   SALTS parts of the slices, so no task gets all copies of a passage.
6. The removed windows return to their slices.

Inserting one symbol of each whole document each round would take as many sequential rounds over all data as the
longest document has bytes; over contexts it takes 168 at most.

Recovery: slices have random names and count only if the written list names them; what is computed from them is a
function of their bytes, so a repeated task gives the same rows.

Defined cases: null texts are empty; texts under LENGTH bytes lose nothing; a text of any length is read in parts that
overlap by LENGTH - 1 bytes; rows with equal doc_id and equal texts are one document, rows with equal doc_id and
different texts are documents of their own, ordered by a hash of the text, and lose bytes of their own only; a document
without doc_id has no place in the order, so it loses nothing and takes nothing from others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_bytes, workspace

LENGTH = 100
GRAM = 32
SLICE_BYTES = 2_000_000
SLICE_ROWS = 65_536
#: Bytes of a slice whose hashes are held at once; the arrays over them take about 80 times as much.
PART_BYTES = 262_144
BUCKET_BYTES = 16_000_000
#: Strings of one collection, contexts of an anchor beyond which it is dealt by windows, parts for such windows.
STRINGS = 8192
HOT = 4096
SALTS = 64
#: Bytes of transform and prefixes that are read at once.
BLOCK = 1 << 20
#: Low bits of a hash that give way to the position, for ties; a part has fewer bytes than this can number.
TIE_BITS = 21
_SPAN = LENGTH - GRAM + 1  # 32-byte strings of a window
_rng = np.random.default_rng(97)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_M = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_U = np.uint64


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_known: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_known.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        _known["up"], _known["down"] = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 2**64))
    return _known["up"], _known["down"]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of parts data[starts[k]:ends[k]]: part k, lo (first window's start in it), n windows, key, ctx.

    ``ctx`` is a hash of the context's bytes. data: fewer than 2**TIE_BITS bytes.
    """
    total = len(data) - LENGTH + 1
    sizes = np.maximum(ends - starts - LENGTH + 1, 0)
    if total <= 0 or not sizes.sum():
        return {"part": np.empty(0, np.int64), "lo": np.empty(0, np.int64), "n": np.empty(0, np.int64), "key": np.empty(0, _U), "ctx": np.empty(0, _U)}
    h, step, factor = _TABLE[data], 1, _M
    while step < GRAM:
        h = h[: len(h) - step] * _U(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    least = ((h >> _U(TIE_BITS)) << _U(TIE_BITS)) | np.arange(len(h), dtype=_U)
    step = 1
    while 2 * step <= _SPAN:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if step < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - step)], least[_SPAN - step :])
    own = (least & _U((1 << TIE_BITS) - 1)).astype(np.int64)
    edge = np.zeros(total + 1, dtype=np.int32)
    some = sizes > 0
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, starts[some] + sizes[some], -1)
    at = np.flatnonzero(np.cumsum(edge[:total]) > 0)
    who = own[at]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(at)))
    lo = at[begin]
    up, down = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    ctx = (sums[lo + n - 1 + _SPAN] - sums[lo]) * down[lo]
    part = np.searchsorted(starts, lo, side="right") - 1
    return {"part": part, "lo": lo - starts[part], "n": n, "key": h[who[begin]], "ctx": ctx + n.astype(_U) * _U(_M)}


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings data[starts[k] : starts[k] + sizes[k]] as an Arrow array."""
    ends = np.cumsum(sizes)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data[places])])


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where rows with the same values begin and end; the columns are in order."""
    if not len(columns[0]):
        return []
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
    heads = np.flatnonzero(new).tolist()
    return list(zip(heads, [*heads[1:], len(new)], strict=True))


def codes_of(strings: pa.Array) -> np.ndarray:
    """A number for each string; equal numbers are equal bytes."""
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def earliest(code: np.ndarray, doc: np.ndarray, tie: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their code by document and start (one each), and rows at a later place."""
    order = np.lexsort((lo, tie, doc, code))
    c, d, t, s = code[order], doc[order], tie[order], lo[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = c[1:] != c[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (d != d[head]) | (t != t[head]) | (s != s[head])
    return order[new], order[later]


class Collection:
    """Suffix order of short strings; transform and prefixes live in two files of ``folder`` that each round rewrites."""

    def __init__(self, strings: list[bytes], folder: str, most: int = LENGTH, block: int = BLOCK):
        self.m, self.most, self.block = len(strings), most, block
        self.store, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.store.create_dir(self.path, recursive=True)
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        width = int(self.sizes.max()) + 1
        self.symbols = np.full((self.m, width), 0xFF, dtype=np.uint8)  # no byte of UTF-8: the string has ended
        for k, s in enumerate(strings):
            self.symbols[k, : len(s)] = np.frombuffer(s, dtype=np.uint8)[::-1]
        try:
            self.round = 0
            with self._files("wb") as files:
                files.write(self.symbols[:, 0], np.zeros(self.m, dtype=np.uint8))
            newest, owner = np.arange(self.m), np.arange(self.m)  # rows of the round before, and their strings
            for size in range(1, width):
                live = self.sizes[owner] >= size
                newest, owner = self._insert(newest[live], owner[live], size)
            self._name()
        finally:
            self.store.delete_dir(self.path)

    def _files(self, mode: str) -> _Pair:
        return _Pair(self.store, f"{self.path}/{self.round}", mode, self.block)

    def _insert(self, newest: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One round: the suffixes of length ``size``, whose first symbols stand in the transform at the rows newest."""
        k = len(newest)
        symbol, rank = np.empty(k, np.uint8), np.empty(k, np.int64)
        before, after = np.full(k, -1, np.int16), np.full(k, -1, np.int16)  # minima to the equal symbols around; -1: none
        count = np.zeros(256, np.int64)
        low = np.full(256, -1, np.int16)  # least prefix since the last occurrence of a symbol; -1: none yet
        last_new = np.full(256, -1, np.int64)  # which newest row that occurrence was; -1: an old one
        at = 0
        with self._files("rb") as files:
            for b, p in files.blocks():
                n = len(b)
                order = np.argsort(b, kind="stable")
                heads = np.append(0, np.cumsum(np.bincount(b, minlength=256)))
                some = np.flatnonzero(heads[1:] > heads[:-1])
                first, last = order[heads[some]], order[heads[some + 1] - 1]
                place = np.empty(n, np.int32)
                place[order] = np.arange(n, dtype=np.int32)
                own = slice(*np.searchsorted(newest, (at, at + n)))
                rows = newest[own] - at
                a, j = b[rows].astype(np.int64), place[rows].astype(np.int64)
                symbol[own], rank[own] = b[rows], count[a] + j - heads[a]
                # Ranges (previous, this] of equal symbols that begin or end at a newest row.
                table = [p]
                while 2 << (len(table) - 1) <= n:
                    half = 1 << (len(table) - 1)
                    table.append(np.minimum(table[-1][:-half], table[-1][half:]))
                inner = j > heads[a]
                before[own][inner] = _lowest(table, order[j[inner] - 1] + 1, rows[inner])
                inner = j + 1 < heads[a + 1]
                after[own][inner] = _lowest(table, rows[inner] + 1, order[j[inner] + 1])
                # Ranges that come from the blocks before: each symbol's first occurrence here.
                seen = low[some] >= 0
                here = np.minimum(low[some], _lowest(table, np.zeros(len(first), np.int64), first))
                w, v = _among(newest[own], first + at, own.start), last_new[some]
                before[w[seen & (w >= 0)]] = here[seen & (w >= 0)]
                after[v[seen & (v >= 0)]] = here[seen & (v >= 0)]
                low = np.where(low >= 0, np.minimum(low, table[0].min()), low)
                low[some], last_new[some] = 0xFF, _among(newest[own], last + at, own.start)
                inner = last + 1 < n
                low[some[inner]] = _lowest(table, last[inner] + 1, np.full(inner.sum(), n - 1))
                count += heads[1:] - heads[:-1]
                at += n
        base = self.m + np.cumsum(count) - count
        target = base[symbol] + rank
        order = np.argsort(target)
        target, owner = target[order], owner[order]
        own_prefix = np.where(before >= 0, np.minimum(before, self.most - 1) + 1, 0)[order].astype(np.uint8)
        next_prefix = np.where(after >= 0, np.minimum(after, self.most - 1) + 1, 0)[order].astype(np.uint8)
        slot = target - np.arange(k)  # the old row before which each comes
        alone = np.append(slot[1:] != slot[:-1], True)  # an old row follows it
        changed = alone & (after >= 0)[order]
        fresh = self.symbols[owner, size]
        at, source = 0, self._files("rb")
        self.round += 1
        with source as old, self._files("wb") as new:
            for b, p in old.blocks():
                n = len(b)
                own = slice(*np.searchsorted(slot, (at, at + n)))
                here = slot[own] - at
                p = p.copy()
                p[here[changed[own]]] = next_prefix[own][changed[own]]
                new.write(np.insert(b, here, fresh[own]), np.insert(p, here, own_prefix[own]))
                at += n
            rest = slice(int(np.searchsorted(slot, at)), k)
            new.write(fresh[rest], own_prefix[rest])
        source.delete()
        return target, owner

    def _name(self) -> None:
        """Which suffix each row is: from the empty suffixes, row k of string k, each step adds a symbol in front."""
        with self._files("rb") as files:
            parts = list(files.blocks())
        bwt = np.concatenate([b for b, _ in parts])
        self.prefix = np.concatenate([p for _, p in parts])
        step = np.empty(len(bwt), np.int64)
        step[np.argsort(bwt, kind="stable")] = np.arange(self.m, self.m + len(bwt))
        self.string, self.length = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
        row = owner = np.arange(self.m)
        for size in range(int(self.sizes.max()) + 1):
            self.string[row], self.length[row] = owner, size
            more = self.sizes[owner] > size
            row, owner = step[row[more]], owner[more]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, suffix length and common prefix with the row before, in suffix order."""
        return self.string, self.length, self.prefix


class _Pair:
    """The files of the transform and of the prefixes, read or written front to back."""

    def __init__(self, store: fs.FileSystem, path: str, mode: str, block: int):
        self.store, self.block = store, block
        self.names = (f"{path}.transform", f"{path}.prefixes")
        open_one = store.open_input_stream if mode == "rb" else store.open_output_stream
        self.files = [open_one(n) for n in self.names]

    def __enter__(self) -> _Pair:
        return self

    def __exit__(self, *_) -> None:
        for f in self.files:
            f.close()

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while part := self.files[0].read(self.block):
            yield np.frombuffer(part, np.uint8), np.frombuffer(self.files[1].read(len(part)), np.uint8)

    def write(self, transform: np.ndarray, prefixes: np.ndarray) -> None:
        for f, part in zip(self.files, (transform, prefixes), strict=True):
            f.write(np.ascontiguousarray(part).tobytes())

    def delete(self) -> None:
        for n in self.names:
            self.store.delete_file(n)


def _lowest(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of table[0][a..b], by its minima over powers of two."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int16)
    for x in np.unique(level):
        own = level == x
        out[own] = np.minimum(table[x][a[own]], table[x][b[own] + 1 - (1 << int(x))])
    return out


def _among(rows: np.ndarray, wanted: np.ndarray, start: int) -> np.ndarray:
    """Where each wanted number stands in ascending rows, counted from ``start``; -1 if it does not."""
    at = np.searchsorted(rows, wanted)
    return np.where(np.append(rows, -1)[at] == wanted, at + start, -1)


def repeated_windows(strings: list[bytes], doc: np.ndarray, lo: np.ndarray, folder: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that also start earlier; doc and lo: the order and place of the strings."""
    made = Collection(strings, folder, block=block)
    string, length, prefix = made.rows()
    long = length >= LENGTH
    group = np.cumsum(~((prefix >= LENGTH) & long))  # rows of one run share their first LENGTH bytes
    string, group = string[long], group[long]
    offset = made.sizes[string] - length[long]
    zero = np.zeros(len(string), np.int64)
    _, later = earliest(group, doc[string], zero, lo[string] + offset)
    return string[later], offset[later]


# A pack holds places of one slice: rows in it, starts, numbers of windows, and what a step needs besides.
_PACK = "slice long, kind int, idx binary, lo binary, n binary, key binary"
_GONE, _OPEN, _CROWDED = 0, 1, 2
_CUT = "group int, salt int, slice long, idx binary, lo binary, n binary, key binary, doc binary, tie binary, bytes binary"
_KINDS = {"idx": np.int32, "lo": np.int32, "n": np.uint8, "key": np.uint64, "doc": np.int64, "tie": np.int64}


def _pack(table: dict[str, np.ndarray], rows: np.ndarray, names: tuple[str, ...]) -> dict[str, bytes]:
    return {c: table[c][rows].astype(_KINDS[c]).tobytes() for c in names}


def _unpack(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The packs' columns, joined; ``slice`` says which slice each place is in."""
    out = {c: np.frombuffer(b"".join(table[c].to_pylist()), dtype=_KINDS[c]).astype(np.uint64 if c == "key" else np.int64) for c in names}
    sizes = [len(x) // 4 for x in table["idx"].to_pylist()]
    return out | {"slice": np.repeat(table["slice"].to_numpy(), sizes)}


def _packs(place: dict[str, np.ndarray], rows: np.ndarray, kind: int | np.ndarray, key: bool = True) -> list[dict]:
    """Rows of _PACK, one for each slice and kind."""
    kinds = np.broadcast_to(kind, len(rows))
    order = np.lexsort((place["lo"][rows], place["idx"][rows], kinds, place["slice"][rows]))
    rows, kinds = rows[order], kinds[order]
    s = place["slice"][rows]
    out = []
    for a, b in runs_of(s, kinds):
        own = rows[a:b]
        out.append({"slice": int(s[a]), "kind": int(kinds[a]), **_pack(place, own, ("idx", "lo", "n")), "key": place["key"][own].astype(np.uint64).tobytes() if key else None})
    return out


_PACK_ARROW = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("idx", "lo", "n", "key"))])
_CUT_ARROW = pa.schema([("group", pa.int32()), ("salt", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("idx", "lo", "n", "key", "doc", "tie", "bytes"))])


def _store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the texts as slices into the folder: slice, rows, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = uuid.uuid4().int >> 65
            part = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
            with store.open_output_stream(f"{path}/{name:016x}.slice") as out, ipc.new_stream(out, part.schema, options=ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(part)
            return pa.RecordBatch.from_pydict({"slice": [name], "rows": [len(ids)], "bytes": [size]})

        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), strict=True):
                if texts and (size + len(text or b"") > SLICE_BYTES or len(texts) >= SLICE_ROWS):
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(text or b"")
        if texts:
            yield close()

    return docs.mapInArrow(write, "slice long, rows long, bytes long")


def _load(folder: str, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A slice's bytes, the texts' offsets, the ids (0 where null) and whether there is an id."""
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name:016x}.slice") as source, ipc.open_stream(source) as reader:
        part = reader.read_all().combine_chunks()
    text, ids = part["text"].chunk(0), part["doc_id"].chunk(0)
    _, offsets, data = text.buffers()
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), np.frombuffer(offsets, np.int64)[: len(text) + 1], ids.fill_null(0).to_numpy(), ids.is_valid()


def _ties(data: np.ndarray, offsets: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """A hash of the text of each named row; it orders rows of equal doc_id."""
    used, where = np.unique(idx, return_inverse=True)
    return np.array([xxhash.xxh3_64_intdigest(data[offsets[k] : offsets[k + 1]]) >> 1 for k in used.tolist()], dtype=np.int64)[where]


def contexts_of(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """The contexts of a slice's rows that have an id: idx, lo, n, key, ctx; long texts are read in parts."""
    most = min(SLICE_BYTES, PART_BYTES)
    parts: list[tuple[int, int, int]] = []  # row, first byte in the text, size
    for k in np.flatnonzero(known & (np.diff(offsets) >= LENGTH)).tolist():
        size = int(offsets[k + 1] - offsets[k])
        for a in range(0, size - LENGTH + 1, most - LENGTH + 1):
            parts.append((k, a, min(most, size - a)))
    found, at = [], 0
    while at < len(parts):
        stop, total = at, 0
        while stop < len(parts) and total + parts[stop][2] <= most:
            total += parts[stop][2]
            stop += 1
        row, first, size = (np.array(x, dtype=np.int64) for x in zip(*parts[at:stop], strict=True))
        ends = np.cumsum(size)
        own = anchors(np.concatenate([data[offsets[k] + a : offsets[k] + a + n] for k, a, n in parts[at:stop]]), ends - size, ends)
        part = own.pop("part")
        found.append(own | {"idx": row[part], "lo": own["lo"] + first[part]})
        at = stop
    return {c: np.concatenate([f[c] for f in found]) if found else np.empty(0, _U if c in ("key", "ctx") else np.int64) for c in ("idx", "lo", "n", "key", "ctx")}


def _routed(stored: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Of each slice: packs of anchors by bucket; packs in buckets below 0 hold what the slice itself has earlier."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["slice"].to_pylist():
                data, offsets, ids, known = _load(folder, name)
                found = contexts_of(data, offsets, known.to_numpy(zero_copy_only=False))
                if not len(found["idx"]):
                    continue
                gone = np.empty(0, np.int64)
                _, where, counts = np.unique(found["ctx"], return_inverse=True, return_counts=True)
                if len(twice := np.flatnonzero(counts[where] > 1)):
                    idx, lo = found["idx"][twice], found["lo"][twice]
                    code = codes_of(gathered(data, offsets[idx] + lo, found["n"][twice] + LENGTH - 1))
                    gone = twice[earliest(code, ids[idx], _ties(data, offsets, idx), lo)[1]]
                left = np.ones(len(found["idx"]), dtype=bool)
                left[gone] = False
                kept = np.flatnonzero(left)
                bucket = ((found["key"][kept] >> _U(20)) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                kept, bucket = kept[order], bucket[order]
                out = [{"bucket": int(bucket[a]), **_pack(found, kept[a:b], ("idx", "lo", "n", "key"))} for a, b in runs_of(bucket)]
                if len(gone):
                    out.append({"bucket": -1 - name % buckets, **_pack(found, gone, ("idx", "lo", "n", "key"))})
                yield pa.RecordBatch.from_pylist([r | {"slice": name} for r in out], schema=pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("idx", "lo", "n", "key"))]))

    return stored.select("slice").mapInArrow(scan, "bucket int, slice long, idx binary, lo binary, n binary, key binary")


def _repeating(hot: int):
    """Of one bucket: the places whose anchor another place has."""

    def find(table: pa.Table) -> pa.Table:
        place = _unpack(table, ("idx", "lo", "n", "key"))
        if table["bucket"][0].as_py() < 0:
            return pa.Table.from_pylist(_packs(place, np.arange(len(place["idx"])), _GONE, key=False), schema=_PACK_ARROW)
        _, where, counts = np.unique(place["key"], return_inverse=True, return_counts=True)
        many = counts[where]
        rows = np.flatnonzero(many > 1)
        return pa.Table.from_pylist(_packs(place, rows, np.where(many[rows] > hot, _CROWDED, _OPEN)), schema=_PACK_ARROW)

    return find


def _cut(folder: str, groups: int):
    """Of one slice: the bytes of its open contexts, packed by group; crowded anchors are dealt by single windows."""

    def cut(table: pa.Table) -> pa.Table:
        name = table["slice"][0].as_py()
        data, offsets, ids, _ = _load(folder, name)
        out = []
        for kind in (_OPEN, _CROWDED):
            own = table.filter(pa.array(table["kind"].to_numpy() == kind))
            if not own.num_rows:
                continue
            place = _unpack(own, ("idx", "lo", "n", "key"))
            if kind == _CROWDED:
                n = place["n"]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = {"idx": np.repeat(place["idx"], n), "lo": np.repeat(place["lo"], n) + offset, "n": np.ones(len(offset), np.int64)}
            starts = offsets[place["idx"]] + place["lo"]
            if kind == _CROWDED:
                place["key"] = np.array([xxhash.xxh3_64_intdigest(data[a : a + LENGTH]) for a in starts.tolist()], dtype=np.uint64)
            place |= {"doc": ids[place["idx"]], "tie": _ties(data, offsets, place["idx"])}
            group = ((place["key"] >> _U(20)) % _U(groups)).astype(np.int64)
            order = np.lexsort((place["lo"], place["idx"], group))
            g = group[order]
            for a, b in runs_of(g):
                rows = order[a:b]
                text = gathered(data, starts[rows], place["n"][rows] + LENGTH - 1)
                out.append({"group": int(g[a]), "salt": -1 if kind == _OPEN else name % SALTS, "slice": name, **_pack(place, rows, tuple(_KINDS)), "bytes": text.buffers()[2].to_pybytes()})
        return pa.Table.from_pylist(out, schema=_CUT_ARROW)

    return cut


def _strings(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, pa.Array]:
    place = _unpack(table, tuple(_KINDS))
    sizes = place["n"] + LENGTH - 1
    data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(data)])
    return place, codes_of(strings), strings


def _distinct(table: pa.Table) -> pa.Table:
    """Of some slices' crowded windows: later places of the same bytes (salt -2), and those that are left (salt -1)."""
    place, code, strings = _strings(table)
    _, later = earliest(code, place["doc"], place["tie"], place["lo"])
    left = np.ones(len(code), dtype=bool)
    left[later] = False
    out, group = [], table["group"][0].as_py()
    for salt, rows in ((-2, later), (-1, np.flatnonzero(left))):
        rows = rows[np.argsort(place["slice"][rows], kind="stable")]
        s = place["slice"][rows]
        for a, b in runs_of(s):
            own = rows[a:b]
            text = b"".join(strings.take(pa.array(own)).to_pylist()) if salt == -1 else None
            out.append({"group": group, "salt": salt, "slice": int(s[a]), **_pack(place, own, tuple(_KINDS)), "bytes": text})
    return pa.Table.from_pylist(out, schema=_CUT_ARROW)


def trimmed(strings: list[bytes]) -> list[tuple[int, int, int]]:
    """(string, first byte, size): the strings cut to what lies between windows whose hash another window has.

    Windows that are alone by their hash equal none, so the suffix order need not hold them.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    h, step, factor, powers = _TABLE[np.frombuffer(b"".join(strings), dtype=np.uint8)], 1, _M, {}
    total = len(h) - LENGTH + 1
    while step <= 64:
        if step in (4, 32, 64):  # they make up LENGTH
            powers[step] = h
        if len(h) > step:
            h = h[: len(h) - step] * _U(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
    whole = powers[64][:total] * _U(_BASE) ^ powers[32][64 : 64 + total]
    whole = whole * _U(_BASE) ^ powers[4][96 : 96 + total]
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    _, where, counts = np.unique(whole[starts[row] + offset], return_inverse=True, return_counts=True)
    shared = counts[where] > 1
    row, offset = row[shared], offset[shared]
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
    tails = np.append(heads[1:], len(row)) - 1 if len(row) else heads
    return list(zip(row[heads].tolist(), offset[heads].tolist(), (offset[tails] - offset[heads] + LENGTH).tolist(), strict=True))


def _ordered(folder: str, strings_of: int = STRINGS):
    """Of one group of anchors: the places to remove."""

    def order(table: pa.Table) -> pa.Table:
        place, code, strings = _strings(table)
        first, later = earliest(code, place["doc"], place["tie"], place["lo"])
        out = _packs(place, later, _GONE, key=False)
        # Strings that share an anchor with others, by anchor.
        first = first[np.argsort(place["key"][first], kind="stable")]
        _, where, counts = np.unique(place["key"][first], return_inverse=True, return_counts=True)
        first = first[counts[where] > 1]
        if not len(first):
            return pa.Table.from_pylist(out, schema=_PACK_ARROW)
        texts = strings.take(pa.array(first)).to_pylist()
        cut = trimmed(texts)
        key = place["key"][first]
        gone_row, gone_lo = [], []
        at = 0
        while at < len(cut):
            stop = min(len(cut), at + strings_of)
            while at < stop < len(cut) and key[cut[stop][0]] == key[cut[stop - 1][0]]:  # an anchor stays whole
                stop -= 1
            if stop == at:
                stop += strings_of
                while stop < len(cut) and key[cut[stop][0]] == key[cut[stop - 1][0]]:
                    stop += 1
            which, begin, size = (np.array(x, dtype=np.int64) for x in zip(*cut[at:stop], strict=True))
            row = first[which]
            _, doc = np.unique(np.stack([place["doc"][row], place["tie"][row]]), axis=1, return_inverse=True)
            lo = place["lo"][row] + begin
            string, offset = repeated_windows([texts[w][a : a + n] for w, a, n in cut[at:stop]], doc.reshape(-1), lo, folder)
            gone_row.append(row[string])
            gone_lo.append(lo[string] + offset)
            at = stop
        if gone_row:
            row, lo = np.concatenate(gone_row), np.concatenate(gone_lo)
            # Rows of one document that stand twice in the table are at the same place as the first.
            head = np.full(code.max() + 1, -1, np.int64)
            head[code[first]] = first
            twin = np.flatnonzero(head[code] >= 0)
            h = head[code[twin]]
            twin = twin[(twin != h) & (place["doc"][twin] == place["doc"][h]) & (place["tie"][twin] == place["tie"][h]) & (place["lo"][twin] == place["lo"][h])]
            for t in twin.tolist():
                own = row == head[code[t]]
                row, lo = np.append(row, np.full(own.sum(), t)), np.append(lo, lo[own])
            windows = {"slice": place["slice"][row], "idx": place["idx"][row], "lo": lo, "n": np.ones(len(row), np.int64)}
            out += _packs(windows, np.arange(len(row)), _GONE, key=False)
        return pa.Table.from_pylist(out, schema=_PACK_ARROW)

    return order


_ROW = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _removed(folder: str, kept: bool):
    """Of one slice: its documents without the removed windows."""
    schema = pa.schema([*_ROW, ("kept", pa.binary())] if kept else _ROW)

    def remove(own: pa.Table, packs: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        data, offsets, ids, known = _load(folder, own["slice"][0].as_py())
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        if packs.num_rows:
            place = _unpack(packs, ("idx", "lo", "n"))
            starts = offsets[place["idx"]] + place["lo"]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + place["n"] - 1 + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            off = gone[a:b]
            left = data[a:b][~off].tobytes() if off.any() else data[a:b].tobytes()
            spans = int(off[0]) + int(np.count_nonzero(off[1:] & ~off[:-1])) if b > a else 0
            out.append((int(ids[k]) if known[k].as_py() else None, b - a, int(off.sum()), spans, hashlib.sha256(left).hexdigest(), *([left] if kept else [])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return remove


def deduplicate(docs: DataFrame, kept: bool = True, hot: int = HOT, strings: int = STRINGS) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and (``kept``) the bytes that are left."""
    spark = docs.sparkSession
    folder = workspace(spark, "slices")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = materialise(_store(own, folder), "stored")
    total = stored.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, -(-total // BUCKET_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-total // BUCKET_BYTES)))
    routed = _routed(stored.repartition(tasks, "slice"), folder, buckets)
    found = materialise(routed.groupBy("bucket").applyInArrow(_repeating(hot), _PACK), "places")
    open_places = found.where(F.col("kind") != _GONE).repartition(tasks, "slice")
    texts = materialise(open_places.groupBy("slice").applyInArrow(_cut(folder, 4 * buckets), _CUT), "strings")
    crowded = materialise(texts.where("salt >= 0").groupBy("group", "salt").applyInArrow(_distinct, _CUT), "crowded")
    meeting = texts.where("salt = -1").union(crowded.where("salt = -1"))
    ordered = meeting.groupBy("group").applyInArrow(_ordered(folder, strings), _PACK)
    places = ["slice", "idx", "lo", "n"]
    gone = found.where(F.col("kind") == _GONE).select(places).union(ordered.select(places)).union(crowded.where("salt = -2").select(places))
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    return stored.repartition(tasks, "slice").groupBy("slice").cogroup(gone.repartition(tasks, "slice").groupBy("slice")).applyInArrow(_removed(folder, kept), fields)


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, with a set of all windows (tests); ids are not null."""
    seen: set[bytes] = set()
    done: dict[tuple, tuple] = {}
    out = []
    for doc_id, text in sorted(((d, (t or "").encode()) for d, t in docs), key=lambda d: (d[0], xxhash.xxh3_64_intdigest(d[1]) >> 1)):
        if (doc_id, text) not in done:
            gone = bytearray(len(text))
            for k in range(len(text) - length + 1):
                w = text[k : k + length]
                if w in seen:
                    gone[k : k + length] = b"\1" * length
                seen.add(w)
            left = bytes(b for b, g in zip(text, gone, strict=True) if not g)
            done[doc_id, text] = (doc_id, len(text), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(left).hexdigest())
        out.append(done[doc_id, text])
    return sorted(out)
