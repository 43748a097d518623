"""OCR output processing: word confidence, language, gate, barcodes.

All of these are row-local: the annotation of one document is one row, so the
mean word confidence is a fold over its nested arrays (no shuffle, no explode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCR_CONFIDENCE_THRESHOLD = 0.7  # default of the reference's settings
WS_TRIM = r"^\s+|\s+$"


def _all_words(pages: Column) -> Column:
    return F.flatten(F.transform(pages, lambda p: F.flatten(F.transform(
        p["blocks"], lambda b: F.flatten(F.transform(b["paragraphs"], lambda q: q["words"]))))))


def ocr_confidence(ann: DataFrame, pages: str = "pages") -> DataFrame:
    """Unweighted mean of word confidences over all pages/blocks/paragraphs; no words -> 0.0."""
    words = _all_words(F.coalesce(F.col(pages), F.array()))
    n = F.size(words)
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + w["confidence"])
    return (ann.withColumn("n_words", n)
            .withColumn("ocr_confidence", F.when(F.col("n_words") > 0, total / F.col("n_words"))
                        .otherwise(F.lit(0.0))))


def ocr_language(ann: DataFrame, pages: str = "pages") -> DataFrame:
    """First detected language of the first page, else ``unknown``."""
    first = F.get(F.get(F.col(pages), 0)["langs"], 0)
    return ann.withColumn("language", F.coalesce(first, F.lit("unknown")))


def confidence_gate(df: DataFrame, conf: str = "ocr_confidence",
                    threshold: float = OCR_CONFIDENCE_THRESHOLD) -> DataFrame:
    """``needs_manual_edit`` = confidence strictly below the threshold."""
    return df.withColumn("needs_manual_edit", F.col(conf) < F.lit(threshold))


def ws_trim(c: Column) -> Column:
    """Trim all whitespace (``trim`` strips spaces only)."""
    return F.regexp_replace(c, WS_TRIM, "")


def barcode_candidate(df: DataFrame, entities: str = "entities", full_text: str = "full_text") -> DataFrame:
    """First entity containing ``PDF417`` or longer than 60 chars (trimmed); else the
    full text when longer than 60 (trimmed); else null."""
    pick = F.get(F.filter(F.col(entities), lambda e: e.contains("PDF417") | (F.length(e) > 60)), 0)
    fallback = F.when(F.length(F.col(full_text)) > 60, ws_trim(F.col(full_text)))
    raw = F.coalesce(F.nullif(ws_trim(pick), F.lit("")), fallback)
    return df.withColumn("raw", raw)


def bcbp_fields(df: DataFrame, raw: str = "raw", year: int = 2024) -> DataFrame:
    """Fixed-width boarding-pass barcode decode (0-based slices 30-33, 33-36, 36-39,
    39-44, 44-47). Fewer than 51 chars or a non-numeric day -> every field null, raw
    kept. The date is Jan 1 of ``year`` + day - 1 with no range check."""
    r = F.col(raw)

    def part(start0: int, n: int) -> Column:
        return ws_trim(F.substring(r, start0 + 1, n))

    long_enough = F.length(r) >= 51
    day = part(44, 3).try_cast("int")
    ok = long_enough & day.isNotNull()
    carrier, number = part(36, 3), F.regexp_replace(part(39, 5), "^0+", "")
    flight = F.concat(carrier, number)
    return df.select(
        "*",
        F.when(ok, F.nullif(part(30, 3), F.lit(""))).alias("airport_iata"),
        F.when(ok, F.nullif(part(33, 3), F.lit(""))).alias("destination"),
        F.when(ok, F.nullif(flight, F.lit(""))).alias("flight_number"),
        F.when(ok, F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), day - 1)).alias("date"),
    )
