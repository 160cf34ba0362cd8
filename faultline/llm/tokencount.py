"""Edit-aware token counts: a segment tree of pre-tokens per document; an edit re-encodes only what it touches.

Byte-level BPE counts add up over pre-tokens, and the pre-token pattern looks at most CONTEXT code points beyond the
end of a match and never behind its start. So an edit can only change pre-tokens that end within CONTEXT before it or
later, and as soon as a new boundary after the edit falls on an old one, all further pre-tokens are the old ones. The
tree's leaves hold runs of pre-tokens; inner nodes hold sums of code points and tokens. An edit finds its leaves by
descent, splits and encodes the region, and updates the sums on the paths to the root.

Trees are kept in a table: the text, and for each leaf its code points, pre-tokens and tokens. apply_edits() reads them
back, builds the inner sums by addition and splits only the leaves that edits touch: a leaf begins and ends at
boundaries, so with CONTEXT code points of what follows it splits as it did within the text. It returns the new trees,
for the next edits.

Defined cases: a null text is empty (0 tokens); null or empty lists of edits change nothing; offsets are code points
of the text as the edits before left it, and are clipped to it; rows with equal doc_id, or without, are counted one by
one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

# Fixed value: the pre-token pattern of the public byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 4
LEAF = 32
#: Pre-tokens whose counts a worker keeps, and the longest of them.
KEPT, KEPT_LENGTH = 300_000, 64
_SPLIT = regex.compile(PATTERN)


class Counter(dict):
    """Token counts of pre-tokens; a bounded number is kept."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= KEPT_LENGTH:
            if len(self) > KEPT:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _SPLIT.findall(text)))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class TokenTree:
    """Pre-tokens of one text in a segment tree; ``tokens`` is the count, ``encoded`` how many pre-tokens edits cost."""

    def __init__(self, text: str, counts: Counter):
        self.counts = counts
        self.encoded = 0
        self._build(_SPLIT.findall(text))

    @classmethod
    def stored(cls, text: str, chars: list[int], pieces: list[int], tokens: list[int], counts: Counter) -> TokenTree:
        """The tree of a text from its leaves' figures; nothing is split or encoded."""
        tree = cls.__new__(cls)
        tree.counts, tree.encoded = counts, 0
        ends = list(accumulate(chars))
        tree._plant([text[e - n : e] for e, n in zip(ends, chars, strict=True)], chars, pieces, tokens)
        return tree

    def _build(self, pieces: list[str]) -> None:
        leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self._plant(["".join(leaf) for leaf in leaves], [sum(map(len, leaf)) for leaf in leaves], list(map(len, leaves)), [sum(map(self.counts.__getitem__, leaf)) for leaf in leaves])

    def _plant(self, leaves: list[str], chars: list[int], pieces: list[int], tokens: list[int]) -> None:
        self.leaves, self.pieces = leaves, pieces
        self.size = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (self.size - len(leaves))
        self.chars, self.sums = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def figures(self) -> tuple[list[int], list[int], list[int]]:
        """Code points, pre-tokens and tokens of each leaf."""
        own = slice(self.size, self.size + len(self.leaves))
        return self.chars[own], self.pieces, self.sums[own]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _split(self, first: int, last: int) -> list[str]:
        """The pre-tokens of the leaves first..last."""
        text, ahead = "".join(self.leaves[first : last + 1]), ""
        for k in range(last + 1, len(self.leaves)):
            if len(ahead) >= CONTEXT:
                break
            ahead += self.leaves[k][:CONTEXT]
        out, at = [], 0
        both = text + ahead
        while at < len(text):
            m = _SPLIT.match(both, at)
            out.append(m[0])
            at = m.end()
        return out

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last one for the text's end), and its first offset."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if offset - before >= self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _set(self, k: int, pieces: list[str]) -> None:
        self.leaves[k], self.pieces[k] = "".join(pieces), len(pieces)
        k += self.size
        self.chars[k] = sum(map(len, pieces))
        self.sums[k] = sum(map(self.counts.__getitem__, pieces))
        while k := k // 2:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace the code points [start, stop)."""
        start = min(max(0, start), self.chars[1])
        stop = min(max(start, stop), self.chars[1])
        first, base = self._leaf_at(max(0, start - CONTEXT))
        last, _ = self._leaf_at(stop)
        last = max(first, last)
        old = self._split(first, last)
        # Whole pre-tokens of the first leaf before the context stay.
        keep = 0
        while keep < len(old) and base + len(old[keep]) + CONTEXT <= start:
            base += len(old[keep])
            keep += 1
        kept, tail = old[:keep], old[keep:]
        text = "".join(tail)
        text = text[: start - base] + replacement + text[stop - base :]
        shift = len(replacement) - (stop - start)
        ends, at = {}, 0  # old boundaries, as offsets in the new text -> pre-tokens before
        for n, piece in enumerate(tail):
            ends[at + shift] = n
            at += len(piece)
        ends[at + shift] = len(tail)
        done = start - base + len(replacement)
        new: list[str] = []
        at = 0
        while True:
            if at >= done and at in ends:
                rest = tail[ends[at] :]
                break
            m = _SPLIT.match(text, at) if at < len(text) else None
            if (m is None or m.end() + CONTEXT > len(text)) and last + 1 < len(self.leaves):
                last += 1  # the match may reach on into the next leaf
                n, end, more = len(tail), len(text), self._split(last, last)
                for piece in more:
                    ends[end] = n
                    end, n = end + len(piece), n + 1
                ends[end] = n
                tail += more
                text += self.leaves[last]
                continue
            if m is None:
                rest = []
                break
            new.append(m[0])
            at = m.end()
        self.encoded += len(new)
        pieces = kept + new + rest
        if len(pieces) > 4 * LEAF * (last - first + 1):
            # The region grew: it gets leaves of its own, the others keep their figures.
            chars, counted, tokens = self.figures()
            new = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
            parts = (self.leaves, ["".join(p) for p in new]), (chars, [sum(map(len, p)) for p in new]), (counted, list(map(len, new))), (tokens, [sum(map(self.counts.__getitem__, p)) for p in new])
            self._plant(*([*whole[:first], *own, *whole[last + 1 :]] for whole, own in parts))
            return
        spread = -(-len(pieces) // (last - first + 1)) or 1
        for k in range(first, last + 1):
            self._set(k, pieces[(k - first) * spread : (k - first + 1) * spread])


_TREE = "doc_id long, text string, n_tokens long, n_pretokens long, leaf_chars array<int>, leaf_pretokens array<int>, leaf_tokens array<int>"
_KINDS = {"doc_id": pa.int64(), "text": pa.string(), "n_tokens": pa.int64(), "n_pretokens": pa.int64(), **dict.fromkeys(("leaf_chars", "leaf_pretokens", "leaf_tokens"), pa.list_(pa.int32()))}


def _row(doc_id: int | None, tree: TokenTree) -> dict:
    chars, pieces, tokens = tree.figures()
    return {"doc_id": doc_id, "text": tree.text(), "n_tokens": tree.tokens, "n_pretokens": sum(pieces), "leaf_chars": chars, "leaf_pretokens": pieces, "leaf_tokens": tokens}


def build_trees(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The trees of all texts, a row each; every pre-token is encoded once, here."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary_path)
        for batch in slices(batches):
            rows = [_row(d, TokenTree(t or "", counts)) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in _KINDS.items()], names=list(_KINDS))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, _TREE)


def apply_edits(trees: DataFrame, edits: Column, vocabulary_path: str, keep: bool = True) -> DataFrame:
    """Stored trees after their edits, n_tokens_before, and n_encoded: how many pre-tokens the edits cost.

    edits: array<struct<start, stop, replacement>>, of the trees' columns. ``keep=False`` gives the counts only.
    """
    kind = "array<struct<start:int,stop:int,replacement:string>>"
    kinds = {c: k for c, k in _KINDS.items() if keep or c in ("doc_id", "n_tokens", "n_pretokens")}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary_path)
        for batch in slices(batches):
            out, extra = [], []
            for r in batch.to_pylist():
                tree = TokenTree.stored(r["text"], r["leaf_chars"], r["leaf_pretokens"], r["leaf_tokens"], counts)
                for e in r["edits"] or ():
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        tree.edit(e["start"], e["stop"], e["replacement"] or "")
                out.append(_row(r["doc_id"], tree))
                extra.append((r["n_tokens"], r["n_pretokens"], tree.encoded))
            before = [pa.array(c, pa.int64()) for c in zip(*extra, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in out], k) for c, k in kinds.items()), *before], names=[*kinds, "n_tokens_before", "n_pretokens_before", "n_encoded"])

    fields = _TREE if keep else "doc_id long, n_tokens long, n_pretokens long"
    return trees.withColumn("edits", edits.cast(kind)).mapInArrow(scan, f"{fields}, n_tokens_before long, n_pretokens_before long, n_encoded long")


def count_edited(docs: DataFrame, edits: Column, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_pretokens, n_encoded: trees are stored, read back and edited."""
    edited = apply_edits(materialise(build_trees(docs, vocabulary_path), "trees"), edits, vocabulary_path, keep=False)
    return edited.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_pretokens_before").alias("n_pretokens"), "n_encoded")


def standard_edits(text: Column) -> Column:
    """Three edits of each text: a passage replaced at a third, one deleted at a half, one added at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    third, half = F.floor(n / 3), F.floor(n / 2)
    new = "a revised passage, 2024"
    end = n - F.least(F.lit(20), n - third) + len(new)
    return F.array(
        F.struct(third.alias("start"), (third + 20).alias("stop"), F.lit(new).alias("replacement")),
        F.struct(half.alias("start"), (half + 15).alias("stop"), F.lit("").alias("replacement")),
        F.struct((end + 20).alias("start"), (end + 20).alias("stop"), F.lit(" The end.").alias("replacement")),
    )
