"""Query callables for OCR output (§2.4) and pass text (§2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import ocr
from concourse.operators import passes as pt
from concourse.plans import fixtures as fx


# ---------------------------------------------------------------------- 2.4
def q_ocr_confidence(spark, sf_dir):
    a = ocr.ocr_confidence(fx.ocr_annotations(spark, sf_dir))
    return a.select("doc_id", "ocr_confidence", "n_words")


def q_ocr_language(spark, sf_dir):
    return ocr.ocr_language(fx.ocr_annotations(spark, sf_dir)).select("doc_id", "language")


def q_confidence_gate(spark, sf_dir):
    a = ocr.confidence_gate(ocr.ocr_confidence(fx.ocr_annotations(spark, sf_dir)))
    return a.select("doc_id", "ocr_confidence", "needs_manual_edit")


def q_barcode_candidate(spark, sf_dir):
    b = ocr.barcode_candidate(fx.ocr_annotations(spark, sf_dir))
    return b.select("doc_id", F.length("raw").alias("raw_length"), F.md5("raw").alias("raw_md5"))


def q_bcbp_fields(spark, sf_dir):
    b = ocr.bcbp_fields(fx.barcodes(spark, sf_dir), year=2024)
    return b.select("order_key", F.length("raw").alias("raw_length"), "airport_iata", "destination",
                    "flight_number", F.date_format("date", "yyyy-MM-dd").alias("date"))


# ---------------------------------------------------------------------- 2.5
def q_strip_code_fence(spark, sf_dir):
    return pt.strip_code_fence(fx.model_texts(spark, sf_dir)).select("pass_id", "anchored", "extracted")


def q_json_contract(spark, sf_dir):
    c = pt.json_contract(fx.json_texts(spark, sf_dir))
    return c.select("pass_id", "valid", "reject_reason", "gate", "flight_number",
                    "dest_confidence", "terminal_confidence")


def q_extract_route(spark, sf_dir):
    r = pt.extract_route(fx.pass_text(spark, sf_dir), fx.cities(spark, sf_dir))
    return r.select("pass_id", "dep_city", "dest_city", "route_source", "route_confidence")


def q_extract_iata(spark, sf_dir):
    return pt.extract_iata(fx.pass_text(spark, sf_dir)).select("pass_id", "dep_iata", "dest_iata")


def q_extract_times(spark, sf_dir):
    return pt.extract_times(fx.pass_text(spark, sf_dir)).select("pass_id", "boarding_time", "departure_time")


def q_extract_flight_gate(spark, sf_dir):
    return pt.extract_flight_gate(fx.pass_text(spark, sf_dir)).select("pass_id", "flight_number", "gate")


def q_extract_terminal(spark, sf_dir):
    t = pt.extract_terminal(pt.extract_flight_gate(fx.pass_text(spark, sf_dir)))
    return t.select("pass_id", "terminal_value", "terminal_source", "terminal_confidence")


def q_confidence_assumptions(spark, sf_dir):
    parsed = pt.parse_pass_text(fx.pass_text(spark, sf_dir), fx.cities(spark, sf_dir))
    return pt.confidence_violations(parsed)


def q_apply_manual_edits(spark, sf_dir):
    edited = pt.apply_manual_edits(fx.passes(spark, sf_dir), fx.edits(spark, sf_dir))
    return edited.withColumn("n_assumptions", F.size("assumptions")).drop("assumptions")


QUERIES = {
    "ocr_confidence": q_ocr_confidence,
    "ocr_language": q_ocr_language,
    "confidence_gate": q_confidence_gate,
    "barcode_candidate": q_barcode_candidate,
    "bcbp_fields": q_bcbp_fields,
    "strip_code_fence": q_strip_code_fence,
    "json_contract": q_json_contract,
    "extract_route": q_extract_route,
    "extract_iata": q_extract_iata,
    "extract_times": q_extract_times,
    "extract_flight_gate": q_extract_flight_gate,
    "extract_terminal": q_extract_terminal,
    "confidence_assumptions": q_confidence_assumptions,
    "apply_manual_edits": q_apply_manual_edits,
}
