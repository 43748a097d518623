"""Query callables for scans and sinks (§2.1). Each sink writes under the shared
folder, reads its output back and returns flat columns for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.plans import fixtures as fx
from concourse.plans import flows
from concourse.plans.registry_serving import advisory_records, nested_catalog
from concourse.session import scratch_path
from concourse.sources import catalog_io as io
from concourse.streaming.micro_batch import incremental_publish


def _lounge_rows(records):
    flat = records.select("airport_code", F.explode("lounges").alias("l"))
    return flat.select("airport_code", F.col("l.lounge_id").alias("lounge_id"),
                       F.col("l.amenities").alias("amenities"),
                       F.array_join("l.conditions", "|").alias("conditions_text"))


def _per_airport(records):
    return records.groupBy("airport_code").agg(
        F.sum(F.coalesce(F.size("lounges"), F.lit(0))).cast("long").alias("n_lounges"))


def q_scan_pages(spark, sf_dir):
    return io.scan_pages(spark, sf_dir)


def q_scan_catalog_json(spark, sf_dir):
    path = scratch_path(spark, "catalog-json")
    io.write_json_arrays(nested_catalog(spark, sf_dir), path)
    return _lounge_rows(io.scan_catalog_json(spark, path))


def q_write_ndjson(spark, sf_dir):
    path = scratch_path(spark, "catalog-ndjson")
    io.write_ndjson(nested_catalog(spark, sf_dir), path)
    lines = spark.read.text(path)
    marker = '"amenities":null'
    nulls = ((F.length("value") - F.length(F.replace(F.col("value"), F.lit(marker), F.lit(""))))
             / len(marker)).cast("long")
    per_line = lines.select(F.get_json_object("value", "$.airport_code").alias("airport_code"),
                            F.coalesce(F.expr("json_array_length(get_json_object(value, '$.lounges'))"),
                                       F.lit(0)).alias("n"),
                            nulls.alias("nulls"))
    return per_line.groupBy("airport_code").agg(F.sum("n").cast("long").alias("n_lounges"),
                                                F.sum("nulls").cast("long").alias("n_null_amenities"))


def q_load_catalog_overwrite(spark, sf_dir):
    pages, details = fx.airport_pages(spark, sf_dir), fx.detail_pages(spark, sf_dir)
    io.load_catalog_overwrite(spark, flows.catalog_from_pages(pages, details))
    return _per_airport(spark.table("concourse.lounge_catalog"))


def q_incremental_publish(spark, sf_dir):
    """Each page is crawled twice in one delivery, and an old crawl of it comes late: the newest one stays."""
    base = scratch_path(spark, "publish")
    new = nested_catalog(spark, sf_dir).withColumn("crawled_at", F.lit(2))
    old = new.withColumn("lounges", F.slice(F.coalesce("lounges", F.array().cast(new.schema["lounges"].dataType)), 1, 1))
    args = f"{base}/src", f"{base}/out", f"{base}/checkpoint"
    incremental_publish(spark, new.unionByName(old.withColumn("crawled_at", F.lit(1))), *args, crawled="crawled_at")
    return _per_airport(incremental_publish(spark, old.withColumn("crawled_at", F.lit(0)), *args, crawled="crawled_at"))


def q_sink_advisory_json(spark, sf_dir):
    path = scratch_path(spark, "advisory-json")
    record = advisory_records(spark, sf_dir)
    io.sink_advisory_json(record, path)
    docs = spark.read.text(path)
    return docs.select(
        F.get_json_object("value", "$.pass_id").cast("long").alias("pass_id"),
        F.expr("json_array_length(get_json_object(value, '$.recommendations'))").alias("n_recommendations"),
        (~F.col("value").contains('"time_window":null')).alias("has_window"))


QUERIES = {
    "scan_pages": q_scan_pages,
    "scan_catalog_json": q_scan_catalog_json,
    "write_ndjson": q_write_ndjson,
    "load_catalog_overwrite": q_load_catalog_overwrite,
    "incremental_publish": q_incremental_publish,
    "sink_advisory_json": q_sink_advisory_json,
}
