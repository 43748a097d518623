"""Structured Streaming jobs.

The reference has no stream API; its endpoints consume an unbounded sequence of
requests against a slowly changing catalog. Re-aimed as file-source streams with
``trigger(availableNow=True)`` and a checkpoint in the shared folder, so a
restarted query resumes where it stopped. ``foreachBatch`` reuses the batch
functions (row_number windows are not allowed on streams) and writes each
micro-batch to ``batch_id=<n>`` with ``overwrite``: a replayed batch rewrites
its own output, which makes the sink idempotent (exactly-once end to end).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concourse.operators import ocr
from concourse.operators import passes as pt
from concourse.plans import recommend as plan
from concourse.session import exists, folders, materialize, remove, scratch_scope, tasks_for


def _run(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise RuntimeError(str(q.exception()))


def _dealt(batch: DataFrame) -> DataFrame:
    """A micro-batch dealt out over all cores: a file of one row group is read by one task, whatever its splits."""
    return batch.repartition(tasks_for(batch, batch.count()))


COMPACT_EVERY = 8    # micro-batches after which the published state is written anew


def incremental_publish(spark: SparkSession, records: DataFrame, src: str, out: str, checkpoint: str,
                        files_per_trigger: int = 5, crawled: str | None = None) -> DataFrame:
    """Publish page records as they arrive, ``files_per_trigger`` files per micro-batch; returns
    the published state: of each page (``url``) the record of latest ``crawled``, or of the latest micro-batch
    without that column. A micro-batch holds one record of a page at most; every COMPACT_EVERY of them are merged with the
    state before, so what a reader scans is the state and a few batches, however long the history."""
    # Dealt by page, so the pages of a hot airport are written by many tasks.
    records.repartition("url").write.mode("append").json(src)

    def publish(batch: DataFrame, batch_id: int) -> None:
        _latest(batch.withColumn("_batch", F.lit(batch_id).cast("long")), crawled).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if (batch_id + 1) % COMPACT_EVERY == 0:
            state, used = _state(spark, out, batch_id)
            _latest(state, crawled).write.mode("overwrite").parquet(f"{out}/state={batch_id}")
            for folder in used:      # the state that this one was made of stays, for a replay and for readers that began before
                if _number(folder) < batch_id - COMPACT_EVERY:
                    remove(spark, f"{out}/{folder}")

    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", files_per_trigger).json(src)
    _run(stream, publish, checkpoint)
    return published(spark, out, crawled)


def _latest(rows: DataFrame, crawled: str | None) -> DataFrame:
    """One record of each page: the latest crawl, then the latest batch; of records that agree in both the one of larger hash."""
    cols = [c for c in rows.columns if c != "url"]
    order = F.struct(*([crawled] if crawled else []), "_batch", F.xxhash64(*cols))
    best = rows.groupBy("url").agg(F.max_by(F.struct(*cols), order).alias("best"))
    return best.select("url", "best.*").select(*rows.columns)


def _number(folder: str) -> int:
    return int(folder.split("=")[1])


def _state(spark: SparkSession, out: str, upto: int | None = None) -> tuple[DataFrame, list[str]]:
    """The last whole state before ``upto`` with the batches after it, and all folders there are."""
    there = [f for f in folders(spark, out) if re.fullmatch(r"(?:state|batch)=\d+", f) and exists(spark, f"{out}/{f}/_SUCCESS")]
    there = [f for f in there if upto is None or _number(f) <= upto - f.startswith("state")]
    base = max((_number(f) for f in there if f.startswith("state")), default=-1)
    used = [f for f in there if _number(f) == base and f.startswith("state") or f.startswith("batch") and _number(f) > base]
    frames = [spark.read.parquet(f"{out}/{f}") for f in sorted(used, key=_number)]
    return functools.reduce(DataFrame.unionByName, frames), there


def published(spark: SparkSession, out: str, crawled: str | None = None) -> DataFrame:
    """The latest record of each page; a page that was crawled again replaces its old record."""
    return _latest(_state(spark, out)[0], crawled).drop("_batch")


def recommend_stream(spark: SparkSession, passes: DataFrame, catalog: Callable[[], DataFrame], src: str, out: str,
                     checkpoint: str, files_per_trigger: int = 1, n_files: int = 4) -> DataFrame:
    """Passes arrive as files; ``catalog()`` is read anew for each micro-batch, which is ranked
    against that snapshot. What a batch writes besides its result is removed with it.
    Returns all published recommendation rows."""
    passes.repartition(n_files, "pass_id").write.mode("append").parquet(src)

    def rank(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            plan.recommend_batch(_dealt(batch), catalog()).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream = spark.readStream.schema(passes.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    _run(stream, rank, checkpoint)
    return spark.read.parquet(out).drop("batch_id")


PARSED_COLS = ["pass_id", "dep_city", "dest_city", "dep_iata", "boarding_time", "departure_time",
               "flight_number", "gate", "terminal_value", "reject_reason"]


def parsed_passes(texts: DataFrame, cities: DataFrame) -> DataFrame:
    """Pass records of (pass_id, text) with ``reject_reason``: a pass without a departure city or code is rejected."""
    reason = F.when(F.col("dep_city").isNull() & F.col("dep_iata").isNull(), F.lit("no departure airport"))
    return pt.parse_pass_text(texts, cities).withColumn("reject_reason", reason).select(*PARSED_COLS)


def parsed_annotations(annotations: DataFrame, cities: DataFrame, threshold: float = ocr.OCR_CONFIDENCE_THRESHOLD) -> DataFrame:
    """OCR annotations (pass_id, full_text, pages) -> (pass_id, status, ocr_confidence, pass fields). Status ``low_confidence``: the
    gate asks for manual editing and nothing is parsed; else ``accepted`` or ``rejected``, as for texts."""
    gated = ocr.confidence_gate(ocr.ocr_confidence(annotations), threshold=threshold)
    gated = gated.select("pass_id", "full_text", "ocr_confidence", "needs_manual_edit")
    read = parsed_passes(gated.filter(~F.col("needs_manual_edit")).select("pass_id", F.col("full_text").alias("text")), cities)
    status = (F.when(F.col("needs_manual_edit"), F.lit("low_confidence")).when(F.col("reject_reason").isNotNull(), F.lit("rejected"))
              .otherwise(F.lit("accepted")))
    return gated.drop("full_text").join(read, "pass_id", "left").withColumn("status", status) \
        .select("pass_id", "status", "ocr_confidence", *PARSED_COLS[1:])


def _split_by_status(spark: SparkSession, rows: DataFrame, names: list[str], out: str, batch_id: int) -> None:
    """Write a micro-batch's rows once and each status as an output of its own."""
    with scratch_scope(spark):
        whole = materialize(rows, "parsed")
        for name in names:
            whole.filter(F.col("status") == name).drop("status").write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")


def _outputs(spark: SparkSession, out: str, names: list[str], cols: list[str]) -> DataFrame:
    both = [spark.read.parquet(f"{out}/{s}").select(*cols).withColumn("status", F.lit(s)) for s in names]
    return functools.reduce(DataFrame.unionByName, both)


def parse_stream(spark: SparkSession, texts: DataFrame, cities: DataFrame, src: str, out: str, checkpoint: str,
                 files_per_trigger: int = 1, n_files: int = 4) -> DataFrame:
    """Raw pass text -> pass records by the batch parser, rejected ones as a side output. Returns both, read back."""
    texts.repartition(n_files, "pass_id").write.mode("append").parquet(src)
    names = ["accepted", "rejected"]

    def split(batch: DataFrame, batch_id: int) -> None:
        status = F.when(F.col("reject_reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
        _split_by_status(spark, parsed_passes(_dealt(batch), cities).withColumn("status", status), names, out, batch_id)

    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    _run(stream, split, checkpoint)
    return _outputs(spark, out, names, PARSED_COLS)


def parse_ocr_stream(spark: SparkSession, annotations: DataFrame, cities: DataFrame, src: str, out: str, checkpoint: str,
                     files_per_trigger: int = 1, n_files: int = 4) -> DataFrame:
    """OCR annotations -> confidence, gate, text rules -> three outputs of one query: accepted passes, rejected ones, and those
    of low confidence. Returns all, read back; equals ``parsed_annotations``."""
    annotations.repartition(n_files, "pass_id").write.mode("append").parquet(src)
    names, cols = ["accepted", "rejected", "low_confidence"], ["pass_id", "ocr_confidence", *PARSED_COLS[1:]]

    def split(batch: DataFrame, batch_id: int) -> None:
        _split_by_status(spark, parsed_annotations(_dealt(batch), cities), names, out, batch_id)

    stream = spark.readStream.schema(annotations.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    _run(stream, split, checkpoint)
    return _outputs(spark, out, names, cols)
