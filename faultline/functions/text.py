"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English stop words of a standard analyzer.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your"]
# Patterns of error codes.
LOOSE_CODE = r"[A-Z]+-\d+"
STRICT_CODE = r"\b[A-Z]{3,5}-\d{3,4}\b"


def words(text: Column) -> Column:
    """Words between white space; none for blank or null texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def clean_query(text: Column) -> Column:
    """Document queries: quotes, brackets, ``! ? *`` go; ``: ; + - / \\ | &`` become blanks."""
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\"'()\[\]{}!?*]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(gone, r"[:;+\-/\\|&]", " "), r"\s+", " "))


def clean_symptom_query(text: Column) -> Column:
    """Symptom queries keep letters, digits, underscores and hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s-]", " "), r"\s+", " "))


def token_set(text: Column) -> Column:
    """Distinct lower-case words; hyphens stay inside words."""
    return F.array_distinct(words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s-]", " ")))


def analyzed(text: Column) -> Column:
    """Index terms: word characters, lower case, without stop words and single letters."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def loose_codes(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOOSE_CODE), F.lit(0))


def strict_codes(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(STRICT_CODE), F.lit(0))


def first_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, LOOSE_CODE, 0), F.lit(""))


def code_prefix(code: Column) -> Column:
    return F.split_part(code, F.lit("-"), F.lit(1))


def clean_manual(text: Column) -> Column:
    """Repair of extracted manual pages: glued words, page marks, section numbers; one line of text results."""
    steps = [
        (r"(\p{Ll})(\p{Lu})", "$1 $2"),
        (r"\.(\p{Lu})", ". $1"),
        (r"(\p{L})([,;:!?])(\p{L})", "$1$2 $3"),
        (r"(\p{L})(\d)", "$1 $2"),
        (r"(\d)(\p{L})", "$1 $2"),
        (r"\b\d+\.\d+\.\d+\.\d+ ", ""),
        (r"\b\d{1,2} – \d{1,4}\b", ""),
        (r"(^|\s)\d{1,2}\.(?=\s|$)", "$1"),
        (r"\s+", " "),
    ]
    out = F.coalesce(text, F.lit(""))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def clean_triplet(text: Column) -> Column:
    """Fields of a triplet: one line, printable Latin only."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    out = F.trim(F.regexp_replace(out, r"[^\x20-\x7EÀ-ÿ]", ""))
    return F.regexp_replace(F.regexp_replace(out, r"\$.\$", ""), r"\^\d", "")


def long_words(text: Column, over: int = 15) -> Column:
    return F.size(F.filter(words(text), lambda w: F.length(w) > over)).cast("long")


def quality_score(text: Column) -> Column:
    """1 less the share of words of over 15 characters; 0 without words."""
    n = word_count(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - long_words(text) / n))


def content_hash(text: Column) -> Column:
    return F.md5(F.trim(text))


def contains_keyword(text: Column, keyword: str) -> Column:
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def shortened(text: Column, n: int = 50) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.lit("..."))


def sentences(text: Column) -> Column:
    """Sentences end with ``. ! ?`` before white space; nothing is lost but that white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    return F.floor(word_count(text) * 0.75).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def json_in_prose(text: Column) -> Column:
    """The first fenced JSON object, else the first brace block of at most one nested level; null if none."""
    fenced = F.regexp_extract(text, r"(?is)```json\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{(?:[^{}]|\{[^{}]*\})*\}", 0)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")))


def filled(template: str, **values: Column) -> Column:
    """A template's ``{name}`` places filled with columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def sequence_ratio(left: Column | str, right: Column | str) -> Column:
    """Matching-block ratio of two texts, trimmed and in lower case (no SQL function gives it)."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([difflib.SequenceMatcher(None, (x or "").lower().strip(), (y or "").lower().strip()).ratio() for x, y in zip(a, b, strict=True)])

    return ratio(left, right)


def glued_word_splitter(dictionary: frozenset[str], least: int = 3):
    """A vectorised function that splits glued words by a dictionary, longest last part first (bounded input)."""

    def split(word: str) -> str:
        core = word.rstrip(".,;:!?")
        if len(core) < 8 or core.lower() in dictionary:
            return word
        best: list[list[str] | None] = [[]] + [None] * len(core)
        for end in range(1, len(core) + 1):
            for begin in range(end - least + 1):
                if best[begin] is not None and core[begin:end].lower() in dictionary:
                    best[end] = [*best[begin], core[begin:end]]
                    break
        parts = best[-1]
        return " ".join(parts) + word[len(core) :] if parts and len(parts) > 1 else word

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(split(w) for w in t.split()))

    return apply
