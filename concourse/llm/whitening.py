"""Whitening of embeddings from an exact covariance, by bit-sliced scatter.

An entry c becomes the integer floor(1024 * c) + 100000. Rows are taken in blocks of ``BLOCK``. In
a block each dimension is shifted by its least value and cut into bit planes; the bits of a plane
are packed across the rows into 64-bit words. The sum of products of two dimensions is the sum over
their planes of popcount(plane AND plane) * 2^(a + b), and a popcount of a plane alone gives the
sums, so cross-products are exact and no row is multiplied out. A task adds its blocks up and sends
one row per pair of dimensions, as 32-bit limbs that Spark sums as longs. The driver gets one row per
pair (``MAX_DIMENSIONS`` bounds them), takes n * products - sums x sums as integers, and only then
goes over to doubles and ``eigh``. Rows are projected in one more pass.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped.
Vectors of several lengths: those of the most frequent length (of equals the longest) are the fit
list, the others are dropped too. Integers beyond +-2^62 are held there (c beyond +-4.5e15).
Repeated and null ids stay as they are, a result per row. Components whose variance is not above the
rounding of the largest (rank-deficient or constant data, one row) don't exist and give no rows.
``deviation`` is null where it exceeds a long. Equal variances leave the choice of axes open, as
eigenvectors do. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.common import staged

SCALE, SHIFT = 1024, 100_000
HELD = 1 << 62
BLOCK = 4096
LIMBS = 5            # of 32 bits: products of two 63-bit integers, summed over a block
COMPONENTS = 8
MAX_DIMENSIONS = 4096  # 8.4 million pairs on the driver at most; longer vectors are an error


def usable(vector: Column) -> Column:
    """Not null, not empty, all entries there and finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 of double entries."""
    return np.clip(np.floor(vectors * float(SCALE)), -HELD, HELD - 2 * SHIFT).astype(np.int64) + SHIFT


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of ``x`` above each column's least value: words (plane, word), the
    column and the power of two of each plane, and the least values."""
    least = x.min(axis=0)
    y = x.view(np.uint64) - least.view(np.uint64)  # wraps round to the true difference
    top = y.max(axis=0)
    rows = -(-len(x) // 64) * 64
    words, column, power = [], [], []
    for b in range(int(top.max()).bit_length()):
        own = np.flatnonzero(top >> np.uint64(b))
        bits = np.zeros((len(own), rows), np.uint8)
        bits[:, :len(x)] = ((y[:, own] >> np.uint64(b)) & np.uint64(1)).T
        words.append(np.packbits(bits, axis=1).view(np.uint64))
        column.append(own)
        power.append(np.full(len(own), b))
    if not words:
        return np.empty((0, rows // 64), np.uint64), np.empty(0, int), np.empty(0, int), least
    column, power, words = np.concatenate(column), np.concatenate(power), np.concatenate(words)
    order = np.lexsort((power, column))
    return words[order], column[order], power[order], least


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and sums of products (d, d; upper triangle) of the integer rows ``x``, as
    Python integers where they may leave 64 bits."""
    n, d = x.shape
    words, column, power, least = bit_planes(x)
    bits = int(power.max()) + 1 if len(power) else 0
    reach = max(abs(int(x.max())), abs(int(x.min())), 1)
    kind = np.int64 if n * reach * reach < 1 << 61 and 2 * bits + n.bit_length() < 62 else object
    weight = np.array([1 << int(p) for p in power], kind)
    first = np.searchsorted(column, np.arange(d))
    there = np.flatnonzero(np.bincount(column, minlength=d)) if len(column) else np.empty(0, int)
    sums, products = np.zeros(d, kind), np.zeros((d, d), kind)
    if len(there):
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(kind)
        sums[there] = np.add.reduceat(ones * weight, first[there])
        for p in range(len(words)):
            i, start = column[p], first[column[p]]
            shared = np.bitwise_count(words[start:] & words[p]).sum(axis=1, dtype=np.int64).astype(kind)
            own = there[there >= i]
            products[i, own] += np.add.reduceat(shared * weight[start:], first[own] - start) * weight[p]
    m = least.astype(kind)
    products += np.triu(np.outer(m, sums) + np.outer(sums, m) + np.outer(m, m) * n)
    return sums + m * n, products


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Two's-complement digits of 32 bits; the last one holds the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append((values & 0xFFFFFFFF).astype(np.int64))
        values = values >> 32
    return [*out, values.astype(np.int64)]


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


@dataclass
class Whitening:
    n: int
    sums: list[int]
    variances: np.ndarray   # falling
    axes: np.ndarray        # a unit eigenvector per row
    total: float            # trace of the covariance

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - S/n) on each axis, over the root of its variance."""
        return (self._centred(x).astype(np.float64) / self.n) @ (self.axes / np.sqrt(self.variances)[:, None]).T

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + 1) >= 1 << 62
        return self.n * x.astype(object if wide else np.int64) - np.array(self.sums, object if wide else np.int64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        c = self._centred(x)
        if c.dtype != object and len(c) and x.shape[1] * float(np.abs(c).max()) ** 2 < 2.0 ** 62:
            return (c * c).sum(axis=1).tolist()
        found = [sum(v * v for v in row) for row in c.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def dimension(vectors: DataFrame) -> int:
    """The most frequent length; of equals the longest; 0 without rows."""
    top = vectors.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is not None and top.d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {top.d} entries; at most {MAX_DIMENSIONS}")
    return top.d if top is not None else 0


def scatter(vectors: DataFrame, d: int) -> DataFrame:
    """(i, j, l0, l1, ...) sums of products of the dimensions i <= j, j = -1: the sum of i,
    i = -1: the number of rows; one row each, in limbs."""
    def rows(batches):
        n, sums, products = 0, np.zeros((LIMBS, d), np.int64), np.zeros((LIMBS, d, d), np.int64)
        for b in batches:
            x = integers(_stacked(b["_v"]))
            for at in range(0, len(x), BLOCK):
                s, p = cross_products(x[at:at + BLOCK])
                sums += np.stack(_limbs(s))
                products += np.stack(_limbs(p))
            n += len(x)
        if n:
            i, j = np.triu_indices(d)
            out = {"i": np.concatenate([i, np.arange(d), [-1]]), "j": np.concatenate([j, np.full(d + 1, -1)])}
            for k in range(LIMBS):
                out[f"l{k}"] = np.concatenate([products[k][i, j], sums[k], [n if k == 0 else 0]])
            yield pd.DataFrame(out)

    limbs = [f"l{k}" for k in range(LIMBS)]
    found = vectors.select("_v").mapInPandas(rows, "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    return found.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in limbs))


def fit_whitening(vectors: DataFrame, d: int, components: int) -> Whitening | None:
    """From usable vectors ``_v`` of ``d`` entries; None without rows."""
    rows = scatter(vectors, d).toArrow().to_pandas()  # d * (d + 3) / 2 + 1 rows
    if not len(rows):
        return None
    value = sum(rows[f"l{k}"].to_numpy(object) * (1 << 32 * k) for k in range(LIMBS))
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    n = int(value[i < 0][0])
    sums = np.zeros(d, object)
    own = (j < 0) & (i >= 0)
    sums[i[own]] = value[own]
    products = np.zeros((d, d), object)
    products[i[j >= 0], j[j >= 0]] = value[j >= 0]
    centred = n * products - np.triu(np.outer(sums, sums))
    covariance = np.array([[int(centred[min(a, b), max(a, b)]) / (n * n) for b in range(d)] for a in range(d)], float)
    e, axes = np.linalg.eigh(covariance)
    e, axes = e[::-1], axes[:, ::-1].T
    there = np.arange(d)[(e > 0) & (e > e[0] * d * np.finfo(float).eps)][:components]
    return Whitening(n, [int(s) for s in sums], e[there].copy(), axes[there].copy(), float(np.trace(covariance)))


def projected(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, z: the whitened entries of each row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # components x MAX_DIMENSIONS doubles at most

    def rows(batches):
        for b in batches:
            if len(b):
                x = integers(_stacked(b["_v"]))
                yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": pd.array(shared.value.deviations(x), "Int64"),
                                    "z": list(shared.value.project(x))})

    return vectors.mapInPandas(rows, "vec_id long, deviation long, z array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest entry of the covariance of ``z`` less the identity. ``z`` is centred by the exact
    mean before it was projected; what its mean still has from rounding is taken off."""
    z = [F.get("z", F.lit(a)) for a in range(k)]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = rows.agg(*(F.avg(c) for c in z), *(F.avg(z[a] * z[b]) for a, b in pairs)).first()
    return max(abs(v - found[a] * found[b] - (a == b)) for v, (a, b) in zip(found[k:], pairs))


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    usable vector and component."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    own = own.filter(usable(F.col("_v")))
    d = dimension(own)
    own = own.filter(F.size("_v") == d)
    model = fit_whitening(own, d, components) if d else None
    k = 0 if model is None else len(model.variances)
    if not k:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = staged(projected(own, model), "whitened")
    error = identity_error(rows, k)
    shares = F.array(*(F.lit(float(e / model.total)) for e in model.variances))
    return (
        rows.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
    )
