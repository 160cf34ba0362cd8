"""WARC archives in Zstandard with a dictionary: writer, and reader that validates every record.

Layout: a skippable frame (magic 0x184D2A5D) with the dictionary leads; then one frame for each record. A record is
``WARC/1.1``, header lines, a blank line, a block of Content-Length bytes and two line ends. A response's block is an
HTTP header and the payload; a revisit's block is the HTTP header alone, whose Content-Length and the record's
WARC-Payload-Digest are those of the full payload.

Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest page_id is the response and
the others revisit it. Digests, counts and maxima are aggregated before they are shuffled, and the join that tells each
page its response is salted by page into ``SALTS`` parts, so a group of copies is never in one task. Archives roll over
at ``ARCHIVE_BYTES``, so that a reader's memory is bounded. Each attempt of a task writes under names of its own and
returns them with their numbers of records; the list that Spark commits holds the successful attempts only, the reader
reads what it names and compares the numbers. So what a lost attempt has left behind is never read.

The dictionary is trained on the driver from a bounded sample (``SAMPLE`` pages by a hash of page_id, at most
``SAMPLE_BYTES`` each); where that is impossible (few or tiny pages) the archives have no dictionary frame.

Defined cases: null html is an empty payload; a null url or page_id has no header and comes back null; rows that
repeat the largest page_id of a group are responses as well; other columns are not read, whatever their names; an empty
table writes no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_bytes, workspace

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES = 65_536
SAMPLE, SAMPLE_BYTES = 400, 20_000
SALTS = 32
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class InvalidRecord(ValueError):
    """A record or archive that breaks the format."""


def record_id(page_id: int | None, salt: bytes = b"") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else 'page:' + salt.hex())}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one record; refers_to: the response's page_id for a revisit."""
    digest = hashlib.sha1(payload)  # noqa: S324  the format's digest
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest.digest())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",  # noqa: S324
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, first: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(first):
        raise InvalidRecord(f"starts with {lines[0][:20]!r}, not {first!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise InvalidRecord(f"no header: {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read_record(raw: bytes) -> dict:
    """Parse and validate one record: required headers, lengths, block and payload digests."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise InvalidRecord("no end of headers")
    headers = _headers(head, b"WARC/1.")
    if missing := [h for h in REQUIRED if h not in headers]:
        raise InvalidRecord(f"lacks {', '.join(missing)}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise InvalidRecord(f"content-length {length}, {len(rest) - 4} bytes of block")
    block = rest[:-4]
    sha1 = lambda data: hashlib.sha1(data).digest()  # noqa: E731, S324
    digest = {}
    for name in ("warc-block-digest", "warc-payload-digest"):
        kind, _, value = headers.get(name, "").partition(":")
        if kind != "sha1":
            raise InvalidRecord(f"{name} is not a SHA-1")
        digest[name] = base64.b32decode(value)
    if sha1(block) != digest["warc-block-digest"]:
        raise InvalidRecord("the block's digest differs")
    http_head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise InvalidRecord("no end of HTTP headers")
    size = _headers(http_head, b"HTTP/1.").get("content-length", "")
    if not size.isdigit():
        raise InvalidRecord("no HTTP content-length")
    kind, refers = headers["warc-type"], headers.get("x-refers-to-page-id")
    if kind == "response":
        if len(payload) != int(size) or sha1(payload) != digest["warc-payload-digest"]:
            raise InvalidRecord("the payload's length or digest differs")
    elif kind != "revisit" or payload or refers is None or headers.get("warc-profile") != REVISIT_PROFILE or headers.get("warc-refers-to") != record_id(int(refers)):
        raise InvalidRecord(f"no valid {kind}")
    own = headers.get("x-page-id")
    return {
        "page_id": int(own) if own is not None else None,
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": int(size),
        "payload_digest": digest["warc-payload-digest"].hex(),
        "refers_to": int(refers) if refers is not None else None,
        "payload": payload if kind == "response" else None,
    }


class ArchiveWriter:
    """Collects an archive's bytes."""

    def __init__(self, dictionary: bytes | None, level: int = 3):
        self.dictionary = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if self.dictionary:
            self.dictionary.precompute_compress(level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=self.dictionary, write_content_size=True)
        self.lead = SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""
        self.start()

    def start(self) -> None:
        self.parts, self.size, self.records = [self.lead], len(self.lead), 0

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)
        self.records += 1

    def take(self) -> bytes:
        out = b"".join(self.parts)
        self.start()
        return out


def read_archive(raw: bytes) -> Iterator[dict]:
    """The records of an archive, one frame each; the dictionary comes from the leading skippable frame."""
    view, at, dictionary = memoryview(raw), 0, None
    if len(raw) >= 8 and int.from_bytes(raw[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(raw[4:8], "little")
        if at > len(raw):
            raise InvalidRecord("the dictionary frame is cut off")
        data = raw[8:at]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data) if data[:4] == FRAME else data)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(raw):
        if bytes(view[at : at + 4]) != FRAME:
            raise InvalidRecord(f"no frame at byte {at}")
        one = decompressor.decompressobj()
        record = one.decompress(view[at:])
        if not one.eof:
            raise InvalidRecord(f"the frame at byte {at} is cut off")
        used = len(raw) - at - len(one.unused_data)
        yield read_record(record)
        at += used


def train_dictionary(pages: DataFrame) -> bytes | None:
    # Ids first: each task then sends the driver a few numbers, not its own SAMPLE pages.
    ids = [r["page_id"] for r in pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()]
    rows = pages.where(F.col("page_id").isin(ids)).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"), F.col("url").cast("string").alias("url")).limit(SAMPLE).collect() if ids else []
    samples = [warc_record(0, r["url"], r["html"].encode(), None) for r in rows]
    if len(samples) < 8 or sum(map(len, samples)) < 16 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return None


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    key = (F.sha1("html"), F.xxhash64("html"), F.octet_length("html"))
    names = ("k_sha1", "k_hash", "k_bytes")
    repeated = rows.where(key[2] >= least).select("page_id", *(k.alias(n) for k, n in zip(key, names, strict=True))).groupBy(*names).agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    salted = repeated.withColumn("k_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    own = rows.select("*", *(k.alias(f"o_{n}") for k, n in zip(key, names, strict=True)), salt.alias("o_k_salt"))
    joined = own.join(salted, [F.col(f"o_{n}") == F.col(n) for n in (*names, "k_salt")], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes | None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write page_id, url, html, refers_to as archives into a shared folder; their names and numbers of records."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        writer, attempt, n = ArchiveWriter(shared.value), uuid.uuid4().hex, 0

        def close() -> pa.RecordBatch:
            nonlocal n
            name, records = f"part-{attempt}-{n:04d}.warc.zst", writer.records
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(writer.take())
            n += 1
            return pa.RecordBatch.from_pydict({"name": [name], "records": [records]})

        for batch in slices(batches, 64):
            for page_id, url, html, refers_to in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), text_bytes(batch["html"]), batch["refers_to"].to_pylist(), strict=True):
                writer.add(warc_record(page_id, url, html, refers_to))
                if writer.size >= archive_bytes:
                    yield close()
        if writer.records:
            yield close()

    return materialise(rows.mapInArrow(write, "name string, records long"), "archives")


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """One row a record of the folder's archives that are named (name, records); payload=True adds the payload.

    An archive whose number of records is not the given one is invalid; a null number is not compared.
    """
    schema = _RECORD + (", payload binary" if payload else "")
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch["name"].to_pylist(), batch["records"].to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{name}") as source:
                    raw = source.read()
                rows: list[dict] = []
                found = 0
                for record in read_archive(raw):
                    rows.append(record)
                    found += 1
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], t) for n, t in kinds.items()})
                        rows = []
                if expected is not None and found != expected:
                    raise InvalidRecord(f"{name} has {found} records, not {expected}")
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], t) for n, t in kinds.items()})

    tasks = min(20_000, max(1, archives.count()))
    return archives.select("name", F.col("records").cast("long").alias("records")).repartition(tasks).mapInArrow(read, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back."""
    folder = workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(with_roles(pages), folder, train_dictionary(pages)), folder)
