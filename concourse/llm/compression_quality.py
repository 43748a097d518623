"""Quality by compression with two dictionaries.

A zstandard dictionary is built from pieces of texts labelled good, another from pieces of texts
labelled bad. A whole text is cut into pieces of ``PIECE`` bytes, each compressed with either
dictionary; its raw score is the size with the bad one less the size with the good one, over the
text's bytes. A logistic curve turns raw scores into the rate of label 1.

Fit: the labelled rows are at most ``MAX_LABELLED`` (those of smallest id hash). Three quarters of
their texts, by text hash, give the pieces: all of them are hashed and the ``PIECES`` of smallest
hash of each label are taken (4 MB at most, the only texts sent to the driver). The other quarter
calibrates: its raw scores go into a histogram of ``BINS`` bins, on which the curve is fitted.
Scoring is row-local: no shuffle of texts.

Defined results: null and empty texts hold nothing to compress and get the rate of label 1 among
labelled texts of that kind, drawn towards the rate of all. Repeated labelled texts count once,
with their mean label (from 0.5 on they are good). Labels that are null, or of unknown documents,
are left out; of several for one document the largest holds. If the pieces have one label only,
every score is the rate of label 1; without labelled rows it is 0. Too few pieces for zstandard to
build a dictionary from (some hundreds) are used as they are. Columns of other names stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.common import staged, whole_text

MAX_LABELLED = 20_000        # labelled rows the model is fitted on, at most
PIECE = 256                  # bytes of text that are compressed on their own
PIECES = 16_384              # pieces of either label that its dictionary is built from, at most
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BINS = 2_000                 # of raw scores between -LIMIT and LIMIT, for the calibration
LIMIT = 0.5
KEEP_AT = 0.7


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2


def pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


def build_dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """Bytes of a dictionary, and whether zstandard built it (else the samples as they are)."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:], False


def _compressor(content: bytes, built: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if built else zstandard.DICT_TYPE_RAWCONTENT
    own = zstandard.ZstdCompressionDict(content, dict_type=kind)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


@dataclass
class QualityModel:
    bad: tuple[bytes, bool]
    good: tuple[bytes, bool]
    rate: float                     # of label 1 among the labelled texts
    empty: float                    # the same among empty ones
    slope: float = 0.0
    offset: float = 0.0

    def raw_scores(self, texts) -> np.ndarray:
        """Size with the bad dictionary less size with the good one, per byte; nan for empty texts."""
        bad, good = _compressor(*self.bad).compress, _compressor(*self.good).compress
        out = np.full(len(texts), np.nan)
        for i, t in enumerate(texts):
            own = t.encode()
            if own:
                out[i] = sum(len(bad(p)) - len(good(p)) for p in pieces(own)) / len(own)
        return out

    def scores(self, texts) -> np.ndarray:
        if not (self.bad[0] and self.good[0]):
            return np.array([self.rate if t else self.empty for t in texts], float)
        raw = self.raw_scores(texts)
        known = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))
        return np.where(np.isnan(raw), self.empty, known)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(key, text, label, part) of the distinct texts of at most MAX_LABELLED labelled rows outside
    the held-out part; part 0 calibrates."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    )
    own = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text"))
    return (
        own.join(F.broadcast(chosen), "_id")  # MAX_LABELLED rows of 16 bytes
        .groupBy(F.md5("_text").alias("key"))
        .agg(F.min("_text").alias("text"), F.avg("_y").alias("label"))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(4)))
    )


def _samples(texts: DataFrame) -> list[bytes]:
    """The PIECES pieces of smallest hash, by hash."""
    def cut(batches):
        for b in batches:
            found = [p for t in b["text"] for p in pieces(t.encode())]
            yield pd.DataFrame({"piece": pd.Series(found, dtype=object)})

    rows = texts.select("text").mapInPandas(cut, "piece binary").distinct().orderBy(F.xxhash64("piece"), "piece").limit(PIECES)
    return [bytes(p) for p in rows.toArrow()["piece"].to_pylist()]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Fit on labelled rows of ``docs`` that are not held out."""
    texts = staged(labelled_texts(docs, labels, label), "labelled")
    n, total, bare, bare_total = texts.select(
        F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), F.count_if(F.col("text") == ""),
        F.coalesce(F.sum(F.when(F.col("text") == "", F.col("label"))), F.lit(0.0))).first()
    rate = total / n if n else 0.0
    parts = texts.filter("part > 0 AND text <> ''")
    bad, good = (build_dictionary(_samples(parts.filter(side))) for side in ("label < 0.5", "label >= 0.5"))
    model = QualityModel(bad, good, rate, (bare_total + 2 * rate) / (bare + 2))
    if bad[0] and good[0]:
        model.slope, model.offset = _calibrated(texts.filter("part = 0 AND text <> ''"), model, rate)
    return model


def _calibrated(texts: DataFrame, model: QualityModel, rate: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve, from a histogram of raw scores and labels. A weak
    pull towards the rate of all keeps the curve finite where the labels are told apart wholly."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"raw": shared.value.raw_scores(b["text"]), "label": b["label"]})

    width = 2 * LIMIT / BINS
    at = F.least(F.greatest(F.floor((F.col("raw") + LIMIT) / width), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    found = (texts.select("text", "label").mapInPandas(rows, "raw double, label double")
             .groupBy(at).agg(F.count("*").alias("n"), F.sum("label").alias("good")).toArrow().to_pandas())
    shared.unpersist()
    x = (found["bin"].to_numpy(float) + 0.5) * width - LIMIT
    n, good = found["n"].to_numpy(float), found["good"].to_numpy(float)
    x, n, good = np.append(x, [-LIMIT, LIMIT]), np.append(n, [1, 1]), np.append(good, [0, 1])
    spread = np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)) or 1.0
    z, w = x / spread, np.array([np.log((rate + 0.01) / (1.01 - rate)), 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * z, -40, 40)))
        slope = np.array([np.sum(good - n * p), np.sum((good - n * p) * z)]) - 0.01 * w
        v = n * p * (1 - p)
        curve = np.array([[v.sum(), (v * z).sum()], [(v * z).sum(), (v * z * z).sum()]]) + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[1] / spread), float(w[0])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    own = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(own, labels, label))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts))

    return own.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                      scored(whole_text()).alias("score")) \
        .withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))
