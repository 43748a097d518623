"""Nest flat lounge rows back into the records of their pages.

A record is one crawled page: its header and the lounges on it, in page order. The key is
the page's URL, as several pages may lack an airport code. A group holds the cards of one
HTML document, so its size is bounded by the page, however many pages an airport has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest_by_page(items: DataFrame, pages: DataFrame, fields: list[str], url: str = "url",
                 order_col: str = "pos") -> DataFrame:
    """``items`` (url, order_col, *fields) + ``pages`` (header columns with ``url``) -> one row per
    page with a ``lounges`` array in page order and their number, ``total_experiences``. Pages without items keep their record with an
    empty array (left join); the items are read once."""
    grouped = items.groupBy(url).agg(F.array_sort(F.collect_list(
        F.struct(F.col(order_col).alias("_pos"), *[F.col(f) for f in fields]))).alias("_arr"))
    grouped = grouped.withColumn("lounges", F.transform(
        "_arr", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).drop("_arr")
    none = F.array().cast(grouped.schema["lounges"].dataType)
    out = pages.join(grouped, url, "left").withColumn("lounges", F.coalesce("lounges", none))
    return out.withColumn("total_experiences", F.size("lounges"))
