"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are each due ``target / size of the source`` copies. The whole part
is taken as it is; the fractions are rounded together: two fractional units meet, words
of probability are moved from one to the other, in a random direction that keeps each
unit's expectation, until one of them is 0 or 1, and the other goes on. Moving words, not
counts, keeps the source's expected words unchanged at every step, so what is taken
differs from the target by less than the one unit that is rounded at the end.

The meetings form a tree. Documents are dealt by hash into blocks of one source of
about ``BLOCK`` rows (a hot source has many); each block leaves one fractional unit;
those units are dealt into blocks again until a source has one left, whose fraction is
drawn. In the first blocks a unit meets the pool of all smaller ones, largest first, so
that what is left is small. Draws depend on
the rows alone (seeded by source and block, rows in a fixed order), so reruns agree on any
partitioning.

Targets: sources in order of code points, null last, weigh 1, 2, 3, 1, 2, 3, ... and
share all words by weight; none gets more than ``MOST`` times its size, and what is over
is shared again by weight among the others. They are the fixed point of a few sums over
the source table; documents are not collected.

Defined results: null and empty texts have size 0 and are taken 0 times; a source without
words has target 0; repeated rows are units of their own; an empty table gives an empty
mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.common import fresh, staged, whole_text

MOST = 3          # copies of a document, and a source's target over its size, at most
WEIGHTS = (1, 2, 3)
BLOCK = 4_096     # units of a block
WORD_BYTES = r"[^\x20\x09-\x0D]+"
UNITS = "row long, doc_id long, source string, size long, p double, mark long"


def word_count(text: str = "text") -> Column:
    return F.size(F.regexp_extract_all(whole_text(text), F.lit(WORD_BYTES), F.lit(0))).cast("long")


def weighted_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight, n). One row per source; the window that numbers them
    sees one narrow row per source."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # Spark compares strings as UTF-8 bytes, which is the order of code points.
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (at % len(WEIGHTS) + 1).cast("int"))
    return own.withColumn("weight", weight.cast("double"))


def with_targets(sources: DataFrame) -> DataFrame:
    """``sources`` with ``target``. ``level`` is what a weight of 1 gets; sources that
    reach their limit leave, and the level rises, until no more leave."""
    limit, level = F.col("source_size") * float(MOST), 0.0
    while True:
        full = limit <= F.col("weight") * level
        s = sources.agg(F.sum("source_size").alias("all"),
                        F.sum(F.when(full, limit)).alias("full"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open"),
                        F.count(F.when(full, 1)).alias("n")).first()
        up = ((s["all"] or 0) - (s["full"] or 0)) / s["open"] if s["open"] else level
        if up <= level:
            return sources.withColumn("target", F.least(limit, F.col("weight") * level))
        level = up


def _meet(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding along the units: their p after it, and the one left open or -1."""
    size, p = size.tolist(), p.tolist()
    open_ = -1
    for j, u in enumerate(draws.tolist()):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i, r = open_, size[j] / size[open_]      # a step of 1 of j's p is r of i's
        up, down = min(1 - p[i], p[j] * r), min(p[i], (1 - p[j]) * r)
        if u * (up + down) < down:               # i gains with chance down / (up + down)
            p[i], p[j] = (1.0 if up == 1 - p[i] else p[i] + up), (0.0 if up == p[j] * r else p[j] - up / r)
        else:
            p[i], p[j] = (0.0 if down == p[i] else p[i] - down), (1.0 if down == (1 - p[j]) * r else p[j] + down / r)
        open_ = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    return np.array(p), open_


def _meet_pool(size: np.ndarray, q: float, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """The same for units of one common probability, largest first: each meets the pool of
    all smaller ones, whose common probability takes the other side of the move, so a large
    unit is settled against many small ones at once."""
    p, rest = np.empty(len(size)), np.append(np.cumsum(size[::-1])[::-1][1:], 0.0)
    for i, (s, r, u) in enumerate(zip(size.tolist(), rest.tolist(), draws.tolist())):
        if q < 1e-12 or q > 1 - 1e-12:
            p[i:] = round(q)
            return p, -1
        if not r:
            p[i] = q
            return p, i
        up, down = min(1 - q, q * r / s), min(q, (1 - q) * r / s)
        if u * (up + down) < down:
            p[i], pool = (1.0, q - up * s / r) if up == 1 - q else (q + up, 0.0)
        else:
            p[i], pool = (0.0, q + down * s / r) if down == q else (q - down, 1.0)
        if 0.0 < p[i] < 1.0:
            p[i + 1:] = pool
            return p, i
        q = pool
    return p, -1


def round_block(level: int, last: bool):
    """One block of one source: each unit decided but for one, which stays fractional unless
    this is the last block of the source. On level 0 all units have the source's fraction."""
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["size", "mark", "doc_id"], ascending=False, kind="stable")
        seed = pd.util.hash_array(np.array([f"{level}|{key[0]}|{key[1]}"], dtype=object))[0]
        draws = np.random.default_rng(int(seed)).random(len(b) + 1)
        size, p = b["size"].to_numpy(float), b["p"].to_numpy(float)
        p, left = _meet(size, p, draws[:-1]) if level else _meet_pool(size, float(p[0]), draws[:-1])
        if last and left >= 0:
            p[left] = float(draws[-1] < p[left])
        return b.assign(p=p)[["row", "doc_id", "source", "size", "p", "mark"]]
    return run


def rounded(units: DataFrame, most: int) -> DataFrame:
    """The units with p 0 or 1. ``most``: units of the largest source."""
    done, blocks, level = None, -(-most // BLOCK), 0
    while True:
        blocks = max(1, blocks)
        block = F.pmod(F.xxhash64("mark", F.lit(level)), F.lit(blocks))
        out = staged(units.groupBy("source", block.alias("block"))
                     .applyInPandas(round_block(level, blocks == 1), UNITS), "mix")
        part = out if blocks == 1 else out.filter("p = 0 OR p = 1")
        done = part if done is None else done.union(part)
        if blocks == 1:
            return done
        units, blocks, level = out.filter("p > 0 AND p < 1"), -(-blocks // BLOCK), level + 1


def mix_plan(docs: DataFrame) -> DataFrame:
    """(mark, doc_id, source, size, source_size, target, copies) of every document; ``mark``
    is the hash of its id and text."""
    sized = staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), word_count().alias("size"),
        F.xxhash64("doc_id", "text").alias("mark")), "sizes")
    sources = staged(weighted_sources(sized), "sources")
    sources = staged(with_targets(sources), "targets")
    most = sources.agg(F.max("n")).first()[0] or 0
    # One row per source: Spark broadcasts it by its size on disk, or else splits hot sources.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "row", "doc_id", "source", "size", "mark", "source_size", "target", rate.alias("rate"))
    share = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    open_ = due.withColumn("p", share).filter("p > 0").select("row", "doc_id", "source", "size", "p", "mark")
    extra = rounded(open_, most).filter("p = 1").select(F.col("row").alias("_row"))
    whole = F.when(F.col("size") > 0, F.floor("rate")).otherwise(0)
    return due.join(extra, F.col("row") == F.col("_row"), "left").select(
        "mark", "doc_id", "source", "size", "source_size", "target",
        (whole + F.when(F.col("_row").isNotNull(), 1).otherwise(0)).cast("int").alias("copies"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mix itself: every document of ``docs`` as many times as it is taken, with all its
    columns. Documents without words are not part of a mix by words and stay once."""
    mark, nth, times = fresh(docs, "mark"), fresh(docs, "nth"), fresh(docs, "copies")
    plan = mix_plan(docs).select(
        F.col("mark").alias("_mix_mark"), F.col("source").alias("_mix_source"),
        F.when(F.col("size") > 0, F.col("copies")).otherwise(1).alias("_mix_n"))
    by = Window.partitionBy("_mix_mark", "_mix_source")
    plan = plan.withColumn("_mix_nth", F.row_number().over(by.orderBy("_mix_n"))).filter("_mix_n > 0")
    # rows of one id, text and source are alike: each takes one of their places
    own = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
    own = own.withColumn(nth, F.row_number().over(Window.partitionBy(mark, "source").orderBy(F.xxhash64(*docs.columns))))
    taken = own.join(plan, (own[mark] == plan["_mix_mark"]) & own["source"].eqNullSafe(plan["_mix_source"])
                     & (own[nth] == plan["_mix_nth"]))
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*docs.columns)
