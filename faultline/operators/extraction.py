"""Symptom, cause and remedy triplets from manual text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_MARK = "\x01"


def code_windows(manuals: DataFrame) -> DataFrame:
    """document_id, window_no, position, code, window: text from each error code to the next."""
    marked = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"({T.LOOSE_CODE})", _MARK + "$1"), _MARK)
    rows = manuals.select("document_id", marked.alias("parts"))
    rows = rows.select("document_id", F.posexplode("parts").alias("window_no", "window"))
    # A part starts where all parts before it end: a running sum within the document.
    before = F.sum(F.length("window")).over(Window.partitionBy("document_id").orderBy("window_no")) - F.length("window")
    rows = rows.withColumn("position", before).where("window_no > 0")
    return rows.select("document_id", F.col("window_no").cast("long").alias("window_no"), F.col("position").cast("long").alias("position"), T.first_code(F.col("window")).alias("code"), "window")


def with_last_cut(windows: DataFrame, last: int = 2000) -> DataFrame:
    """The windows, the last one of each document cut to ``last`` characters."""
    final = F.lead("window_no").over(Window.partitionBy("document_id").orderBy("window_no")).isNull()
    return windows.withColumn("window", F.when(final, F.left("window", F.lit(last))).otherwise(F.col("window")))


def sequential_triplets(manuals: DataFrame, window: int = 1500, first_occurrence: bool = False) -> DataFrame:
    """document_id, code_no, code, symptom, cause, remedy of each code's window; nothing is cleaned or left out by length.

    The last window, and one whose next code is the same, has ``window`` characters. ``first_occurrence`` reproduces a
    known defect: a repeated code is always read at its first place, up to the next code's first place after that.
    """
    text = F.coalesce("text", F.lit(""))
    codes = manuals.select("document_id", text.alias("text"), T.loose_codes(text).alias("codes"))
    rows = codes.select("document_id", "text", F.posexplode("codes").alias("code_no", "code"), F.size("codes").alias("n"), "codes")
    rows = rows.withColumn("next_code", F.get("codes", F.col("code_no") + 1))
    if first_occurrence:
        rows = rows.withColumn("begin", F.expr("locate(code, text)")).withColumn("end", F.expr("coalesce(locate(next_code, text, begin + length(code)), 0)"))
        part = F.expr(f"case when end > 0 then substring(text, begin, end - begin) else substring(text, begin, {window}) end")
        rows = rows.select("document_id", "code_no", "code", part.alias("window"))
    else:
        own = code_windows(manuals).select("document_id", (F.col("window_no") - 1).alias("code_no"), "code", "window")
        final = F.lead("code_no").over(Window.partitionBy("document_id").orderBy("code_no")).isNull()
        rows = own.withColumn("window", F.when(final, F.left("window", F.lit(window))).otherwise(F.col("window")))
    w = F.col("window")
    rows = rows.where(w.rlike("(?i)Cause:") & w.rlike("(?i)Remedy:"))
    cause = F.trim(F.regexp_extract(w, r"(?is)Cause:\s*(.*?)(?:Remedy:|$)", 1))
    remedy = F.trim(F.regexp_extract(w, r"(?is)Remedy:\s*(.*?)(?:\n\n|\d+\.\d+|$)", 1))
    symptom = F.trim(F.split_part(w, F.lit("\n"), F.lit(1)))
    return rows.select("document_id", F.col("code_no").cast("long").alias("code_no"), "code", symptom.alias("symptom"), cause.alias("cause"), remedy.alias("remedy"))


def with_equipment(rows: DataFrame, equipment: str) -> DataFrame:
    """The rows of one document with its equipment, a name of two characters at least."""
    if len(equipment.strip()) < 2:
        raise ValueError("an equipment's name has two characters at least")
    return rows.withColumn("equipment", F.lit(equipment.strip()))


def triplets(manuals: DataFrame, least: int = 10) -> DataFrame:
    """document_id, window_no, position, code, symptom, cause, remedy; cause and remedy longer than ``least``."""
    w = F.col("window")
    found = code_windows(manuals).where(w.rlike("(?i)Cause:") & w.rlike("(?i)Remedy:"))
    cause = F.regexp_extract(w, r"(?is)Cause:\s*(.*?)(?:Remedy:|$)", 1)
    remedy = F.regexp_extract(w, r"(?is)Remedy:\s*(.*?)(?:\n\n|\d+\.\d+|$)", 1)
    symptom = F.regexp_extract(w, r"(?is)^(.*?)\s*Cause:", 1)
    out = found.select("document_id", "window_no", "position", "code", T.clean_triplet(symptom).alias("symptom"), T.clean_triplet(cause).alias("cause"), T.clean_triplet(remedy).alias("remedy"))
    return out.where((F.length("cause") > least) & (F.length("remedy") > least))


def with_page(found: DataFrame, pages: DataFrame) -> DataFrame:
    """As-of lookup: the page with the largest start not after a position (1 if none); pages: document_id, page, start."""
    both = found.select("document_id", "position", "window_no", F.lit(None).cast("long").alias("page")).union(pages.select("document_id", F.col("start").alias("position"), F.lit(None).cast("long"), F.col("page").cast("long")))
    order = Window.partitionBy("document_id").orderBy("position", F.col("window_no").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(order), F.lit(1))).where("window_no is not null")
    return found.join(at.select("document_id", "window_no", "page"), ["document_id", "window_no"])


def clean_triplet_rows(rows: DataFrame) -> DataFrame:
    """Rows with all four fields, first of equal ones by row_no; the usual null words count as null."""
    # The texts that a data-frame CSV reader takes as missing.
    missing = ["", "None", "NA", "N/A", "NaN", "nan", "null", "NULL", "n/a", "<NA>", "#N/A", "-nan", "-NaN", "#NA"]
    keys = ("symptom", "cause", "remedy", "equipment")
    out = rows.select(*(F.when(~F.col(c).isin(missing), F.col(c)).alias(c) if c in keys else F.col(c) for c in rows.columns)).na.drop(subset=list(keys))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))).where("nth = 1").drop("nth")
