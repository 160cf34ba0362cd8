"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers set the boundaries.

Anchors are at-signs, plus signs, digits, ``://`` and words that announce an account or a secret. Around each anchor a parser
that reads no further than the span itself expands and validates:

- ``email``, ``ip``, ``card``, ``phone``: the base kinds. Each gives what a leftmost non-overlapping scan with its
  pattern gives, since every match of a pattern holds its anchor and the parsers try anchors from left to right.
- ``url``: an address after a scheme, if it names a user (``user:password@host``).
- ``account``: an identifier after an account cue (``iban``, ``account``, ``acct``), or an IBAN that passes mod 97.
- ``secret``: the value assigned to a secret cue (``token``, ``password``, ``api_key`` and the like), if it holds letters
  and digits and is long enough to be opaque.

Offsets are code points, ends are exclusive. Defined cases: null texts are empty; an empty text has no spans; texts of
any length are scanned whole, in time proportional to it; rows with equal doc_id (or none) are scanned one by one; of
spans that overlap within a kind the leftmost stays; an empty table gives an empty table; other columns are not read by
detect() and stay as they are in mask(), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
_URL_REST = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s@/<>\"]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"]*)?")
_ACCOUNT_REST = re.compile(r"[\s:#.=]{0,4}(?:(?:no|nr|number)\b[\s:#.=]{0,4})?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9][0-9-]{6,20}[0-9])(?![A-Za-z0-9])")
_SECRET_REST = re.compile(r"[\"']?\s{0,4}(?::=|=>|[=:])\s{0,4}[\"'`]?([A-Za-z0-9+/_.~$%^&*!@#=-]{8,})")

#: Words that announce a secret, and the fewest characters of its value. Blanks in a cue stand for nothing, "_", "-" or " ".
SECRET_CUES = {"password": 8, "passwd": 8, "passphrase": 8, "token": 16, "secret": 16, "api key": 16, "access key": 16, "secret key": 16, "private key": 16}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))


def valid_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in text) <= 15


def valid_account(text: str) -> bool:
    compact = text.replace(" ", "").upper()
    if compact[:2].isalpha():
        return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    return 8 <= sum(c.isdigit() for c in compact) <= 18


def valid_secret(text: str, least: int) -> bool:
    """Long enough, with a letter and two digits, so that a word or a name in code is not one."""
    return len(text) >= least and any(c.isalpha() for c in text) and sum(c.isdigit() for c in text) >= 2


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, "digit")
    for cue, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        automaton.add_word(cue, kind)
    for cue in ("iban", "account", "acct"):
        for form in (cue, cue.capitalize(), cue.upper()):
            automaton.add_word(form, "account")
    for cue, least in SECRET_CUES.items():
        for between in ("", "_", "-", " ") if " " in cue else ("",):
            spelt = cue.replace(" ", between)
            for form in (spelt, spelt.capitalize(), spelt.upper(), cue.title().replace(" ", between)):
                automaton.add_word(form, least)
    automaton.make_automaton()
    return automaton


_AUTOMATON = build_automaton()


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind as in KINDS, then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    ends = dict.fromkeys(KINDS, 0)
    run_end = 0  # digits before it belong to a run whose start has been tried

    def keep(kind: str, start: int, end: int, valid: bool) -> None:
        ends[kind] = end
        if valid:
            found[kind].append((start, end))

    for last, cue in _AUTOMATON.iter(text):
        if cue == "digit":
            if last >= run_end or last >= ends["card"]:
                m = CARD.match(text, last) if last >= ends["card"] else None
                if m:
                    keep("card", m.start(), m.end(), valid_card(m[0]))
            if last >= run_end and last >= ends["ip"]:
                run_end = last + 1
                while run_end < len(text) and "0" <= text[run_end] <= "9":
                    run_end += 1
                if text[run_end : run_end + 1] == "." and (m := IP.match(text, last)):
                    keep("ip", m.start(), m.end(), valid_ip(m[0]))
        elif cue == "at":
            start, least = last, ends["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                keep("email", start, m.end(), True)
        elif cue == "plus":
            if last >= ends["phone"] and (m := PHONE.match(text, last)):
                keep("phone", m.start(), m.end(), valid_phone(m[0]))
        elif cue == "scheme":
            begin = last - 2
            if (s := _SCHEME.search(text[max(0, begin - 16) : begin])) and (m := _URL_REST.match(text, last + 1)):
                start = begin - len(s[0])
                if start >= ends["url"]:
                    keep("url", start, m.end(), True)
        elif isinstance(cue, int):
            if last >= ends["secret"] and (m := _SECRET_REST.match(text, last + 1)):
                ends["secret"] = m.end()
                value = m[1].rstrip(".!")
                if valid_secret(value, cue):
                    found["secret"].append((m.start(1), m.start(1) + len(value)))
        elif m := _ACCOUNT_REST.match(text, last + 1):
            if m.start(1) >= ends["account"]:
                keep("account", m.start(1), m.end(1), valid_account(m[1]))
    return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans, by running each pattern over the text (tests)."""
    text = text or ""
    checks = ((EMAIL, "email", lambda s: True), (IP, "ip", valid_ip), (CARD, "card", valid_card), (PHONE, "phone", valid_phone))
    return [(kind, m.start(), m.end()) for pattern, kind, valid in checks for m in pattern.finditer(text) if valid(m[0])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Columns that follow those of the base kinds: counts of the kinds that the method adds, and of all spans.
_ADDED = (*(f"n_{k}" for k in KINDS[len(BASE_KINDS) :]), "n_spans")
_REPORT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), *((c, pa.int64()) for c in _ADDED)])


def detect(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, all spans, counts of the other kinds and of all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [find_spans(t or "") for t in batch["text"].to_pylist()]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in rows]
            counts = {k: [sum(s[0] == k for s in spans) for spans in rows] for k in KINDS}
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array([joined(s) for s in rows], pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS[len(BASE_KINDS) :]), pa.array([len(s) for s in rows], pa.int64())], schema=_REPORT)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + ", ".join(f"{c} long" for c in _ADDED)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def masked(text: str) -> str:
    """The text with each span, and each run of overlapping spans, replaced by the kind of its first."""
    out, last, run = [], 0, None
    for kind, a, b in sorted(find_spans(text), key=lambda s: (s[1], -s[2], s[0])):
        if run and a < run[2]:
            run[2] = max(run[2], b)
            continue
        if run:
            out += [text[last : run[1]], f"[{run[0].upper()}]"]
            last = run[2]
        run = [kind, a, b]
    if run:
        out += [text[last : run[1]], f"[{run[0].upper()}]"]
        last = run[2]
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data in text replaced by its kind; n_chars follows."""
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before = batch["text"].to_pylist()
            after = [None if t is None else masked(t) for t in before]
            arrays = {name: batch[name] for name in columns} | {"text": pa.array(after, batch["text"].type)}
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([n if a == b else len(a) for n, a, b in zip(batch["n_chars"].to_pylist(), after, before, strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays([arrays[name] for name in columns], names=columns)

    return docs.mapInArrow(scan, docs.schema)
