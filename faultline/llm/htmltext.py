"""Main text of web pages: a host's suffix array finds what its pages repeat, structure says which blocks may be main text.

A page is cut into blocks of visible text with their zone: ``article`` (inside article or main), ``chrome`` (inside
menus, headers, footers, sidebars, notices, adverts, forms or comments, by element, role, class or id) or ``open``.
The main text is what the host's boilerplate leaves of the article's blocks, or of the open ones on a page without any.

Boilerplate is found on the token streams of whole pages, all zones. The streams of a host's different contents are
concatenated and sorted as a suffix array to a depth of RUN tokens. A run of RUN tokens within a block, or outside of
articles whole blocks that have UNIT tokens together (one block, or consecutive short ones as in a menu), is boilerplate
if it occurs on at least PERCENT of the host's contents, and on PAGES at least. Inside a marked article only runs on
ARTICLE_PERCENT and ARTICLE_PAGES count: an article is main text unless the host repeats it nearly everywhere. So a
phrase, a quotation, a licence line or a lone heading stays.

Most contents share no long run with others, and their streams need not be sorted. Each content has prints: of each
RUN tokens the least hash of PRINT tokens in a row, and the hashes of its units. Equal runs have equal prints, so a
boilerplate run's print is on at least as many pages as the run; only contents with such a print go on. Their streams
are dealt by hash into groups of about CHUNK contents and CHARS characters, so no task gets an unbounded host. A
group's suffix array names its runs (64-bit hashes) and counts the contents of each; a content is in one group, so the
sum over a host's groups is the number of contents on the whole host. The runs that are boilerplate go back to the
groups that have them. The result is the same for any dealing.

A class or id never hides an article or main element, nor does that of an element around it, except for comments. Words
such as no, with or off take a hint back. A line break (br) is white space within its block, as the standard has it;
images and inputs do not end a block.

Defined cases: null or empty html gives an empty text; a null url belongs to the host ''; a page that is cut off
within a tag loses the tag only; rows with equal page_id are extracted one by one, and rows with equal contents are one
witness of a host; null page_ids stay null; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

RUN = 30
UNIT = 8
PAGES = 3
PERCENT = 10
#: What a run inside a marked article must be on.
ARTICLE_PAGES = 10
ARTICLE_PERCENT = 50
PRINT = 5
CHUNK = 400
CHARS = 4_000_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|textarea|select|title|object|canvas)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^<>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element names and the names that mark parts of a page.
_SILENT = frozenset("area base col embed img input link meta param source track wbr".split())  # without content, and no block
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CHROME = frozenset("nav aside footer form dialog menu button fieldset head".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_COMMENT_WORDS = frozenset("comment comments discussion disqus respond".split())
_CHROME_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager".split()
)
_TAKEN_BACK = frozenset("no not non has with without off layout".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


_HARD, _SOFT = 2, 1


def _chrome(name: str, attributes: str, inside: bool) -> int:
    """_HARD for what an element, a role or a comment's class marks, _SOFT for other classes and ids, else 0."""
    if name in _CHROME or (name == "header" and not inside):
        return _HARD
    found = 0
    for kind, *values in _NAMED.findall(attributes) if attributes and name not in ("html", "body") else ():
        value = next(filter(None, values), "")
        if kind.lower() == "role":
            if value.lower() in _CHROME_ROLES:
                return _HARD
            continue
        for one in value.split():
            own = {w.lower() for w in _WORDS.findall(one)}
            if own & _CHROME_WORDS and not own & _TAKEN_BACK:
                found = max(found, _HARD if own & _COMMENT_WORDS else _SOFT)
    return 0 if found and name in ("article", "main") and not found == _HARD else found


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block of visible text, in page order."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # name, and what hard, soft and inside were before it
    hard = soft = inside = 0
    at, page = 0, page or ""

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(("chrome" if hard or soft else "article" if inside else "open", text))

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _SILENT or (name in _INLINE and not m[4]):
            continue
        if m[2]:
            if name not in _INLINE:
                flush()
            if any(s[0] == name for s in stack):
                flush()
                while stack:
                    own, hard, soft, inside = stack.pop()
                    if own == name:
                        break
            continue
        if name not in _INLINE:
            flush()
            if stack and stack[-1][0] == "p":  # a block ends a paragraph
                _, hard, soft, inside = stack.pop()
        if name == "hr" or m[4].endswith("/") and name in _INLINE:
            continue
        kind = _chrome(name, m[4], inside > 0)
        is_inside = kind == 0 and (name in ("article", "main") or bool(re.search(r"\brole\s*=\s*[\"']?main\b", m[4])))
        if kind or is_inside:
            flush()
        if kind or is_inside or name not in _INLINE:
            stack.append((name, hard, soft, inside))
            hard += kind == _HARD
            soft = 0 if is_inside else soft + (kind == _SOFT)
            inside += is_inside
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_M = np.uint64(0x9E3779B97F4A7C15)
_S31 = np.uint64(31)


#: A content: its blocks, and for each whether it is loose (outside of an article).
Content = tuple[list[str], list[bool]]


def _hashed(flat: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n tokens in a row, by first token."""
    out = flat[: max(0, len(flat) - n + 1)].copy()
    for j in range(1, n if len(out) else 0):
        out ^= out >> _S31
        out *= _M
        out += flat[j : j + len(out)]
    return out


def _stream(contents: list[Content], run: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The concatenated token hashes, each one's content, the first token of each block (and the end) for each content,
    where a run of ``run`` tokens within a block starts, and the name of the run at each place."""
    codes, sizes, edges = [], [], []
    at = 0
    for blocks_of, _ in contents:
        own = [b.split(" ") for b in blocks_of]
        codes += [xxhash.xxh3_64_intdigest(t) for b in own for t in b]
        edges.append(at + np.cumsum([0, *map(len, own)]))
        at = int(edges[-1][-1])
        sizes.append(edges[-1][-1] - edges[-1][0])
    flat = np.array(codes, dtype=np.uint64)
    starts = np.zeros(at, dtype=bool)
    for own in edges:
        for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            starts[a : max(a, b - run + 1)] = True
    names = _hashed(flat, run)
    names = np.append(names, np.zeros(at - len(names), dtype=np.uint64))
    return flat, np.repeat(np.arange(len(contents)), sizes), edges, starts, names


def _units(blocks_of: list[str], loose: list[bool], unit: int = UNIT) -> list[tuple[int, int, int]]:
    """Whole loose blocks (first, stop, name): from each block on, as many in a row as have ``unit`` tokens together."""
    sizes, out = [b.count(" ") + 1 for b in blocks_of], []
    for first in range(len(blocks_of)):
        stop, tokens = first, 0
        while stop < len(blocks_of) and loose[stop] and tokens < unit:
            tokens += sizes[stop]
            stop += 1
        if tokens >= unit:
            out.append((first, stop, xxhash.xxh3_64_intdigest("\n".join(["", *blocks_of[first:stop]]))))
    return out


def prints(content: Content, run: int = RUN) -> np.ndarray:
    """Distinct hashes such that contents with an equal run or unit have one of them in common."""
    blocks_of, loose = content
    long = [b.split(" ") for b in blocks_of if b.count(" ") + 1 >= run]
    out = [np.array([name for _, _, name in _units(blocks_of, loose)], dtype=np.uint64)]
    if long:
        least = _hashed(np.array([xxhash.xxh3_64_intdigest(t) for b in long for t in b], dtype=np.uint64), PRINT)
        span, step = run - PRINT + 1, 1
        while 2 * step <= span:
            least = np.minimum(least[: len(least) - step], least[step:])
            step *= 2
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        ends = np.cumsum([len(b) for b in long])
        out += [least[e - len(b) : e - run + 1] for b, e in zip(long, ends.tolist(), strict=True)]
    return np.unique(np.concatenate(out))


def repeats(contents: list[Content], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The names of all runs and units of different contents, and on how many of these each occurs.

    The suffix array of the concatenated streams is built by prefix doubling as far as depth ``run``: suffixes of equal
    rank share their first ``run`` tokens. Runs that cross blocks are left out.
    """
    flat, who, _, starts, names = _stream(contents, run)
    n = len(flat)
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    at, depth = np.arange(n), 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        order = np.lexsort((ahead, rank))
        new = np.ones(n, dtype=np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        depth += step
    ranks, first = np.unique(rank[starts], return_index=True)
    pairs = np.unique(np.stack([rank[starts], who[starts]]), axis=1)
    counts = np.bincount(pairs[0], minlength=n + 1)[ranks]
    units: dict[int, int] = {}
    for blocks_of, loose in contents:
        for name in {name for _, _, name in _units(blocks_of, loose)}:
            units[name] = units.get(name, 0) + 1
    return np.append(names[starts][first], np.array(list(units), dtype=np.uint64)), np.append(counts, np.array(list(units.values()), dtype=np.int64))


def without(contents: list[Content], names: np.ndarray, strong: np.ndarray, run: int = RUN) -> list[list[str | None]]:
    """The blocks of contents without the tokens of named runs and units; null for a block that goes whole.

    Blocks that are not loose lose the runs of ``strong`` only.
    """
    flat, _, edges, starts, own = _stream(contents, run)
    loose_at = np.zeros(len(flat), dtype=bool)
    for (_, loose), at in zip(contents, edges, strict=True):
        loose_at[at[0] : at[-1]] = np.repeat(np.array(loose, dtype=bool), np.diff(at))
    hit = np.flatnonzero(starts & np.where(loose_at, np.isin(own, names), np.isin(own, strong)))
    ends = np.zeros(len(flat) + run + 1, dtype=np.int64)
    ends[hit] += 1
    ends[hit + run] -= 1
    known = set(names.tolist())
    for (blocks_of, loose), at in zip(contents, edges, strict=True):
        for a, b, name in _units(blocks_of, loose):
            if name in known:
                ends[at[a]] += 1
                ends[at[b]] -= 1
    gone = np.cumsum(ends) > 0
    out = []
    for (blocks_of, _), at in zip(contents, edges, strict=True):
        kept = [" ".join(w for w, c in zip(b.split(" "), gone[a:], strict=False) if not c) for b, a in zip(blocks_of, at.tolist(), strict=False)]
        out.append([b or None for b in kept])
    return out


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, zones and texts of the blocks, the contents' hash and their prints."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [blocks(page) for page in batch["html"].to_pylist()]
            texts, zones = [[t for _, t in own] for own in found], [[z for z, _ in own] for own in found]
            hashes = [xxhash.xxh3_128_digest("\n".join([*t, "", *z])) for t, z in zip(texts, zones, strict=True)]
            marks = [prints((t, [x != "article" for x in z])).view(np.int64) for t, z in zip(texts, zones, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(zones, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string())), pa.array(hashes, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["page_id", "url", "zones", "texts", "content", "prints"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(scan, "page_id long, url string, zones array<string>, texts array<string>, content binary, prints array<long>")


def _contents(table: pa.Table) -> list[Content]:
    return [(t, [x != "article" for x in z]) for t, z in zip(table["texts"].to_pylist(), table["zones"].to_pylist(), strict=True)]


def _find(table: pa.Table) -> pa.Table:
    """The runs of one group, with the number of its contents that have them."""
    names, counts = repeats(_contents(table))
    return pa.table({"host": pa.repeat(table["host"][0], len(names)), "part": pa.repeat(table["part"][0], len(names)), "name": pa.array(names.view(np.int64)), "n": pa.array(counts, pa.int64())})


def _mask(table: pa.Table, hits: pa.Table) -> pa.Table:
    """The contents of one group without the host's boilerplate."""
    names, strong = hits["name"].to_numpy().astype(np.int64).view(np.uint64), hits["strong"].to_numpy(zero_copy_only=False).astype(bool)
    kept = without(_contents(table), names, names[strong])
    return pa.table({"host": table["host"], "content": table["content"], "kept": pa.array(kept, pa.list_(pa.string()))})


def _main_text(texts: str):
    """The article's blocks, or the open ones of a page without an article, that are left."""
    wanted = F.when(F.array_contains("zones", "article"), F.lit("article")).otherwise(F.lit("open"))
    both = F.filter(F.arrays_zip(F.col(texts).alias("t"), F.col("zones").alias("z")), lambda x: (x["z"] == wanted) & x["t"].isNotNull())
    return F.array_join(F.transform(both, lambda x: x["t"]), "\n")


def extract(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))
    parsed = materialise(_parsed(pages).withColumn("host", host), "html")
    least = lambda percent, most: F.greatest(F.lit(most), F.ceil(F.count(F.lit(1)) * percent / 100))
    hosts = parsed.select("host", "content").distinct().groupBy("host").agg(least(PERCENT, PAGES).alias("need"), least(ARTICLE_PERCENT, ARTICLE_PAGES).alias("strong_need"))
    hosts = materialise(hosts, "hosts")
    marks = parsed.select("host", "content", F.explode("prints").alias("print"))
    frequent = marks.groupBy("host", "print").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host").where("n >= need").select("host", "print")
    # Written first, so that Spark knows its size: a small table is broadcast, and the texts stay where they are.
    some = materialise(marks.join(materialise(frequent, "prints"), ["host", "print"], "left_semi").select("host", "content").distinct(), "some")
    alone = parsed.join(some, ["host", "content"], "left_anti").select("page_id", "url", _main_text("texts").alias("text"))
    shared = parsed.join(some, ["host", "content"], "left_semi").select("page_id", "url", "host", "content", "zones", "texts")
    contents = shared.groupBy("host", "content").agg(F.first("texts").alias("texts"), F.first("zones").alias("zones"))
    contents = materialise(contents.withColumn("chars", F.length(F.array_join("texts", " "))), "contents")
    parts = contents.groupBy("host").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("chars") / CHARS)).cast("int").alias("parts"))
    dealt = contents.join(parts, "host").select("host", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int").alias("part"), "content", "zones", "texts")
    found = materialise(dealt.groupBy("host", "part").applyInArrow(_find, "host string, part int, name long, n long"), "runs")
    whole = found.groupBy("host", "name").agg(F.sum("n").alias("n")).join(hosts, "host").where("n >= need").select("host", "name", (F.col("n") >= F.col("strong_need")).alias("strong"))
    hits = found.select("host", "part", "name").join(whole, ["host", "name"]).select("host", "part", "name", "strong")
    kept = dealt.groupBy("host", "part").cogroup(hits.groupBy("host", "part")).applyInArrow(_mask, "host string, content binary, kept array<string>")
    rest = shared.drop("texts").join(kept, ["host", "content"]).select("page_id", "url", _main_text("kept").alias("text"))
    return alone.union(rest).withColumn("n_chars", F.length("text").cast("long"))


def brute_force(pages: list[tuple[int, str | None, str | None]]) -> list[tuple]:
    """page_id and text, by counting every run and unit of every page in one dictionary (tests)."""
    parsed = [(page_id, re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*))?", url or "")[1] or "", blocks(page)) for page_id, url, page in pages]
    by_host: dict[str, dict] = {}
    for _, host, own in parsed:
        by_host.setdefault(host.lower(), {})[tuple(own)] = own

    def names(own: list[tuple[str, str]]) -> dict[tuple, list[tuple[int, int, int]]]:
        """Runs and units with where they are: block, first and last token."""
        out: dict[tuple, list] = {}
        for k, (zone, text) in enumerate(own):
            tokens = text.split(" ")
            for a in range(len(tokens) - RUN + 1):
                out.setdefault(tuple(tokens[a : a + RUN]), []).append((k, a, a + RUN))
            last = next((j for j in range(k + 1, len(own) + 1) if sum(len(t.split(" ")) for _, t in own[k:j]) >= UNIT), None)
            if last and all(z != "article" for z, _ in own[k:last]):
                out.setdefault(("unit", *(t for _, t in own[k:last])), []).extend((j, 0, len(own[j][1].split(" "))) for j in range(k, last))
        return out

    counts: dict[str, dict[tuple, int]] = {}
    for host, contents in by_host.items():
        own = counts[host] = {}
        for content in contents.values():
            for name in names(content):
                own[name] = own.get(name, 0) + 1
    out = []
    for page_id, host, own in parsed:
        n = len(by_host[host.lower()])
        gone = set()
        for name, places in names(own).items():
            for k, a, b in places:
                few, percent = (ARTICLE_PAGES, ARTICLE_PERCENT) if own[k][0] == "article" else (PAGES, PERCENT)
                if counts[host.lower()][name] >= max(few, -(-n * percent // 100)):
                    gone.update((k, j) for j in range(a, b))
        wanted = "article" if any(z == "article" for z, _ in own) else "open"
        left = [" ".join(w for j, w in enumerate(t.split(" ")) if (k, j) not in gone) for k, (z, t) in enumerate(own) if z == wanted]
        out.append((page_id, "\n".join(t for t in left if t)))
    return out
