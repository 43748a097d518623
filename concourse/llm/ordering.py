"""Ranges of ascending doc_id, for work that needs the documents' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -(1 << 63)


def order_key(doc_id: str = "doc_id") -> Column:
    """doc_id with null as the smallest."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST).cast("long"))


def range_starts(df: DataFrame, rows: int, most: int) -> list[int]:
    """First order key of each range of about ``rows`` rows; ``most`` ranges at most. One
    pass over doc_id; the summary sent to the driver has a number per range."""
    n, least = df.select(order_key().alias("k")).agg(F.count("*"), F.min("k")).first()
    ranges = max(1, min(most, -(-n // rows)))
    if ranges == 1:
        return [] if least is None else [least]
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.select(F.percentile_approx(order_key(), shares, max(10_000, 20 * ranges))).first()[0]
    return sorted({least, *cuts})


def range_of(key: Column, starts: list[int]) -> Column:
    """Number of the range that holds ``key``, by binary search."""
    n = len(starts)
    all_ = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")  # folded once
    steps = [1 << i for i in reversed(range(max(1, n.bit_length())))]

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to < n) & (F.get(all_, to) <= key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
