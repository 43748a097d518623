"""Catalog serving: unnest, parameterised lookup, contract, cap, terminals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERVED_FIELDS = ["lounge_id", "name", "terminal", "opening_hours", "amenities",
                 "access_notes", "conditions", "image_url", "detail_url"]
REQUIRED_FIELDS = ["lounge_id", "name", "airport_code", "opening_hours"]


def unnest_lounges(airports: DataFrame) -> DataFrame:
    """Lateral unnest of ``lounges``; inner, so airports with an empty or null array
    vanish. Projects the ten served fields; nested-schema pruning reads only these."""
    return (airports.select("airport_code", F.explode("lounges").alias("lounge"))
            .select("airport_code", *[F.col(f"lounge.{f}").alias(f) for f in SERVED_FIELDS]))


LOOKUP_SQL = """
SELECT airport_code, lounge.lounge_id, lounge.name, lounge.terminal, lounge.opening_hours,
       lounge.amenities, lounge.access_notes, lounge.conditions, lounge.image_url, lounge.detail_url
FROM {table} LATERAL VIEW explode(lounges) l AS lounge
WHERE airport_code = :airport
"""


def lounges_for_airport(spark: SparkSession, table: str, airport: str) -> DataFrame:
    """The catalog query with a bound parameter (never string-formatted user input)."""
    return spark.sql(LOOKUP_SQL.format(table=table), args={"airport": airport})


def with_contract(lounges: DataFrame) -> DataFrame:
    """Apply serve-time defaults and name the first violated requirement.

    Null amenities -> ``''``, null conditions -> ``[]``; a row missing a required
    field gets ``reject_reason`` (no per-row exception, the job never aborts)."""
    reason = None
    for f in REQUIRED_FIELDS:
        cond = F.col(f).isNull()
        reason = F.when(cond, F.lit(f"missing {f}")) if reason is None else reason.when(cond, F.lit(f"missing {f}"))
    return (lounges
            .withColumn("amenities", F.coalesce(F.col("amenities"), F.lit("")))
            .withColumn("conditions", F.coalesce(F.col("conditions"), F.array().cast("array<string>")))
            .withColumn("reject_reason", reason))


def catalog_contract(lounges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(served, rejected) split of the contract; both read one shared projection."""
    checked = with_contract(lounges)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = checked.filter(F.col("reject_reason").isNotNull())
    return good, bad


def with_airport_check(passes: DataFrame, iata: str = "airport_code") -> DataFrame:
    blank = F.col(iata).isNull() | (F.trim(F.col(iata)) == "")
    return passes.withColumn("reject_reason", F.when(blank, F.lit("Airport IATA required")))


def require_airport(passes: DataFrame, iata: str = "airport_code") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a pass without a departure airport code is rejected with a reason."""
    checked = with_airport_check(passes, iata)
    return (checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.filter(F.col("reject_reason").isNotNull()))


def cap_per_airport(lounges: DataFrame, cap: int = 50) -> DataFrame:
    """At most ``cap`` lounges per airport, the lowest ``lounge_id`` first.

    ``row_number() <= cap`` is planned as a ``WindowGroupLimit`` that also runs
    before the shuffle, so a hot airport ships at most ``cap`` rows per map task."""
    w = Window.partitionBy("airport_code").orderBy("lounge_id")
    return (lounges.withColumn("catalog_pos", F.row_number().over(w))
            .filter(F.col("catalog_pos") <= cap))


def available_terminals(capped: DataFrame) -> DataFrame:
    """Sorted distinct non-empty terminals per airport, computed on the capped set.
    ``N/A`` is a value; order is by code point (``T10`` < ``T2``)."""
    term = F.when(F.col("terminal") != "", F.col("terminal"))
    return (capped.groupBy("airport_code")
            .agg(F.array_sort(F.collect_set(term)).alias("available_terminals")))
