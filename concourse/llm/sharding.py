"""Sharding by sampled splitters.

Keys are (hash of the text, hash of the id), so equal texts lie side by side and yet a group
of copies of any size can be cut. A sample of keys is drawn, each row with a chance that grows
with its size; its quantiles cut the keys into ranges of like size. The ranges' true sizes are
summed; a range over ``OVERFULL`` times its due is cut again by a sample of its own rows,
until none is. Within the ranges, rows are summed in key order, and a row's shard is where the
middle of its bytes falls when all bytes are laid out in key order: sizes of shards differ by
no more than a document at each cut.

The driver sees splitters only: about ``SAMPLES`` per range, ranges of about ``RANGE_ROWS``
rows while these are no more than ``MOST_RANGES``; beyond, ranges hold more rows, whose windows Spark sorts with
spilling. So what the driver holds has a bound. Windows run in one range.

Law ``bytes``: sizes near equal. Defined results: a null text has 16 bytes of size, like an empty one, and
checksum 0; null texts lie together. Repeated rows are rows of their own, side by side. Null ids are
rows as others. Documents larger than a shard's share take more than one share. Fewer documents
than shards leave shards empty. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.common import fresh, staged

OVERHEAD = 16          # bytes of a record besides its text
RANGE_ROWS = 100_000   # rows of a range, about
LEAST_RANGES = 16
MOST_RANGES = 10_000
SAMPLES = 32           # keys drawn per range, about
OVERFULL = 2.0


class Splitters:
    """Cuts in the order of (a, b) keys: range i holds the keys from cut i - 1 up to cut i."""

    def __init__(self, cuts: list[tuple[int, int]]):
        self.cuts = sorted(set(cuts))
        self.a = np.array([c[0] for c in self.cuts], np.int64)
        self.b = np.array([c[1] for c in self.cuts], np.int64)

    def range_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.a, a, side="left")
        high = np.searchsorted(self.a, a, side="right")
        for at in np.unique(low[low < high]):   # cuts within one hash value
            rows = np.flatnonzero((low == at) & (high > at))
            low[rows] = at + np.searchsorted(self.b[at:high[rows[0]]], b[rows], side="right")
        return low

    def column(self):
        @F.pandas_udf("int")
        def numbers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series(self.range_of(a.to_numpy(), b.to_numpy()).astype(np.int32))

        return numbers("a", "b")


def sized_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, a, b) of every document: one pass over the texts."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("a"), F.xxhash64("doc_id", F.lit(1)).alias("b"))


def _draw(rows: DataFrame, rate) -> DataFrame:
    """Rows drawn with chance size * rate, by hash, so that reruns agree."""
    drawn = F.pmod(F.xxhash64("a", "b", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(drawn < F.col("size") * rate).select("a", "b")


def quantile_cuts(keys: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    keys = sorted(keys)
    return [keys[len(keys) * i // n] for i in range(1, n)] if keys else []


def splitters(keys: DataFrame, rows: int, size: int) -> tuple[Splitters, DataFrame]:
    """Splitters of ranges of like size, and the sums per range."""
    n = min(MOST_RANGES, max(LEAST_RANGES, rows // RANGE_ROWS))
    sample = [tuple(r) for r in _draw(keys, n * SAMPLES / size).collect()]
    cut, due = Splitters(quantile_cuts(sample, n)), size / n
    while True:
        ranged = keys.withColumn("range", cut.column())
        sums = (ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"),
                                            (F.min(F.struct("a", "b")) < F.max(F.struct("a", "b"))).alias("cuttable"))
                .collect())                      # a row per range
        over = [r for r in sums if r["bytes"] > OVERFULL * due and r["cuttable"]]
        if not over:
            return cut, sums
        again = ranged.filter(F.col("range").isin([r["range"] for r in over]))
        drawn = _draw(again, 4 * SAMPLES / due).union(
            again.groupBy("range").agg(F.max(F.struct("a", "b")).alias("m")).select("m.a", "m.b"))
        fresh = [(r["a"], r["b"]) for r in drawn.collect()]
        by: dict[int, list] = {}
        at = cut.range_of(*(np.array(x, np.int64) for x in zip(*fresh)))
        for r, k in zip(at.tolist(), fresh):
            by.setdefault(r, []).append(k)
        more = [c for r in over for c in
                [*quantile_cuts(by[r["range"]], max(2, int(np.ceil(r["bytes"] / due)))), max(by[r["range"]])]]
        if set(more) <= set(cut.cuts):
            return cut, sums
        cut = Splitters([*cut.cuts, *more])


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, a, b, shard, slot) of every document; ``slot`` counts from 0
    in its shard, in key order."""
    keys = staged(sized_keys(docs), "keys")
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return keys.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    cut, sums = splitters(keys, n, size)
    sums = sorted(sums, key=lambda r: r["range"])
    before = np.cumsum([0] + [r["bytes"] for r in sums])
    offsets = keys.sparkSession.createDataFrame(
        [(r["range"], int(s)) for r, s in zip(sums, before)], "range int, before long")
    by = Window.partitionBy("range").orderBy("a", "b", "doc_id", "size")
    upto = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))
    laid = keys.withColumn("range", cut.column()).withColumn("upto", upto)
    laid = laid.join(F.broadcast(offsets), "range")      # a row per range
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.floor(middle * shards / float(size)), F.lit(shards - 1)).cast("int")
    laid = laid.withColumn("shard", shard)
    at = F.row_number().over(Window.partitionBy("range", "shard").orderBy("a", "b", "doc_id", "size", "upto")) - 1
    placed = staged(laid.withColumn("at", at).select(*keys.columns, "range", "shard", "at"), "placed")
    cells = placed.groupBy("range", "shard").agg(F.count("*").alias("n"))   # ranges + shards rows
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    cells = staged(cells.select("range", "shard", F.coalesce(ahead, F.lit(0)).alias("ahead")), "cells")
    return placed.join(F.broadcast(cells), ["range", "shard"]).select(
        *keys.columns, "shard", (F.col("ahead") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Write ``docs`` as Parquet partitioned by shard, rows in slot order within a file; the added columns are ``shard`` and
    ``slot``, with underscores before them where ``docs`` has such columns."""
    a, b, n, i = (fresh(docs, x) for x in ("_a", "_b", "_n", "_i"))
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    placed = assign_shards(docs, shards).select(
        F.col("a").alias(a), F.col("b").alias(b), F.col("shard").alias(shard), F.col("slot").alias(slot))
    # rows that repeat id and text are alike: any of them may take any of their slots
    by = Window.partitionBy(a, b).orderBy(n)
    left = docs.withColumn(a, F.xxhash64("text")).withColumn(b, F.xxhash64("doc_id", F.lit(1)))
    left = left.withColumn(n, F.monotonically_increasing_id()).withColumn(i, F.row_number().over(by))
    right = placed.withColumn(n, F.col(slot)).withColumn(i, F.row_number().over(by)).drop(n)
    rows = left.drop(n).join(right, [a, b, i]).drop(a, b, i)
    rows.repartition(shard, F.floor(F.col(slot) / RANGE_ROWS)).sortWithinPartitions(shard, slot) \
        .write.partitionBy(shard).parquet(path)
