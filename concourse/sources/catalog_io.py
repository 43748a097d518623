"""Scans and sinks.

All paths live under the cluster's shared folder (``spark.checkpoint.dir``): a
fresh sub-folder per call, never a machine-local temp dir. Writers are
idempotent per path (``overwrite``), so a retried task or job rewrites the same
output instead of duplicating it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concourse.session import exists, folders, read_table, remove, shared_dir

LOUNGE_TYPE = T.StructType([
    T.StructField("lounge_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("terminal", T.StringType()), T.StructField("opening_hours", T.StringType()),
    T.StructField("image_url", T.StringType()), T.StructField("detail_url", T.StringType()),
    T.StructField("amenities", T.StringType()), T.StructField("access_notes", T.StringType()),
    T.StructField("conditions", T.ArrayType(T.StringType())),
])
CATALOG_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("airport_name", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("airport_code", T.StringType()),
    T.StructField("airport_location", T.StringType()), T.StructField("total_experiences", T.IntegerType()),
    T.StructField("lounges", T.ArrayType(LOUNGE_TYPE)),
])


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetched page corpus; only the needed columns reach the parquet reader."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


#: What separates the records of a pretty-printed array: a line that opens an object at the first level.
RECORD_START = "\n  {"


def _array_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one JSON array; only one record is held back, for the comma behind it."""
    last = None
    for b in batches:
        rows = ([last] if last is not None else []) + b["j"].tolist()
        if rows:
            first, last = last is None, rows.pop()
            yield pd.DataFrame({"value": ["["] * first + [f"  {r}," for r in rows]})
    if last is not None:
        yield pd.DataFrame({"value": [f"  {last}", "]"]})


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Write records as JSON-array files (one array per partition, in bounded pieces), the layout the crawler
    hands to the loader. Null fields are kept as keys."""
    j = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    j.mapInPandas(_array_lines, "value string").write.mode("overwrite").text(path)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the records of pretty-printed JSON arrays, each as JSON text. A file is split at the records, so one
    large array is read by several tasks."""
    pieces = spark.read.option("lineSep", RECORD_START).text(path)
    # what stands before a file's first record is its opening bracket; what follows a record's end is ignored by the reader
    return pieces.filter(~F.trim(F.col("value")).isin("[", "[]", "")).select(F.concat(F.lit("{"), F.col("value")).alias("value"))


def infer_schema(spark: SparkSession, path: str, sampling: float = 1.0) -> T.StructType:
    """Schema of the records by Spark's own inference, from a share of them."""
    texts = array_records(spark, path)
    texts = texts.select(F.regexp_replace("value", r"\s*(?:,|\])\s*$", "").alias("value"))
    return spark.read.option("samplingRatio", sampling).json(texts.rdd.map(lambda r: r.value)).schema


def scan_catalog_json(spark: SparkSession, path: str, schema: T.StructType | None = CATALOG_SCHEMA,
                      pretty: bool = True) -> DataFrame:
    """Files each holding one JSON array of airport records. Pretty-printed ones (a record begins a line, two blanks in)
    are read in splits; others, with ``pretty=False``, a file at a time. Without a schema it is inferred."""
    if not pretty:
        reader = spark.read.option("multiLine", "true")
        return (reader.schema(schema) if schema is not None else reader).json(path)
    own = infer_schema(spark, path) if schema is None else schema
    return array_records(spark, path).select(F.from_json("value", own).alias("r")).select("r.*")


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object per line, null fields kept as keys, UTF-8 text as is."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


KEPT_LOADS = 2     # the current load of a table and the one before it, for readers that still hold it


def load_catalog_overwrite(spark: SparkSession, df: DataFrame, table: str = "lounge_catalog",
                           database: str = "concourse") -> int:
    """Create the database if absent, load ``df`` as the table's whole content, return its
    row count. The data goes to a new folder of the shared storage, and the name, a view, is switched to
    it when it is whole, with whatever schema it has: readers see the old load or the new one, and a load that
    fails leaves the old one in place. Loads are no scratch data: ``release`` leaves them. KEPT_LOADS stay, older
    ones are removed after the switch."""
    home = f"{shared_dir(spark)}/{database}.db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{home}'")
    loads = f"{home}/{table}-loads"
    path = f"{loads}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    name = f"{database}.{table}"
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    there = [x for x in sorted(folders(spark, loads)) if f"{loads}/{x}" <= path]
    kept = [x for x in there if exists(spark, f"{loads}/{x}/_SUCCESS")][-KEPT_LOADS:]
    for old in set(there) - set(kept):
        remove(spark, f"{loads}/{old}")
    return rows


def sink_advisory_json(records: DataFrame, path: str, key: str = "pass_id") -> None:
    """One JSON document per pass with a fixed key order; null values kept as keys. The text files are gzipped: a document
    has some two KB, most of it wording that all documents share."""
    keys = [key, "time_window", "available_terminals", "advisory", "recommendations", "assumptions",
            "destination_context"]
    doc = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    records.select(doc.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
