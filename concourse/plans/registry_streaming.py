"""Query callables for streaming (§2.7)."""

from __future__ import annotations

from concourse.plans import fixtures as fx
from concourse.session import scratch_path
from concourse.streaming import micro_batch as mb


def q_recommend_stream(spark, sf_dir):
    base = scratch_path(spark, "recommend-stream")
    return mb.recommend_stream(spark, fx.passes(spark, sf_dir), lambda: fx.lounges(spark, sf_dir),
                               f"{base}/src", f"{base}/out", f"{base}/checkpoint")


def q_parse_stream(spark, sf_dir):
    base = scratch_path(spark, "parse-stream")
    return mb.parse_stream(spark, fx.pass_text(spark, sf_dir), fx.cities(spark, sf_dir), f"{base}/src", f"{base}/out",
                           f"{base}/checkpoint")


def q_parse_ocr_stream(spark, sf_dir):
    base = scratch_path(spark, "parse-ocr-stream")
    return mb.parse_ocr_stream(spark, fx.pass_annotations(spark, sf_dir), fx.cities(spark, sf_dir), f"{base}/src", f"{base}/out",
                               f"{base}/checkpoint")


QUERIES = {
    "recommend_stream": q_recommend_stream,
    "parse_stream": q_parse_stream,
    "parse_ocr_stream": q_parse_ocr_stream,
}
