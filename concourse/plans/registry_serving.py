"""Query callables for catalog serving (§2.3) and recommendation (§2.6).

Each callable takes ``(spark, sf_dir)``, reads the driver tables through the
fixtures and returns flat columns matching the DuckDB oracle of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concourse.operators import advisory as adv
from concourse.operators import catalog as cat
from concourse.operators import recommend as rec
from concourse.operators.nesting import nest_by_page
from concourse.plans import fixtures as fx
from concourse.plans import recommend as plan
from concourse.session import materialize

LOUNGE_FIELDS = ["lounge_id", "name", "terminal", "opening_hours", "image_url", "detail_url",
                 "amenities", "access_notes", "conditions"]


# ------------------------------------------------------------------ fixtures
def nested_catalog(spark: SparkSession, sf_dir: str, airport: str | None = None) -> DataFrame:
    """F1n: F1 nested per page, plus lounge-less airports (empty / null arrays); of one
    airport only, if given: both sides are filtered before anything is nested."""
    last = fx.read_table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    lounges = fx.on_pages(fx.lounges(spark, sf_dir), F.substring("lounge_id", 2, 9))
    pages = fx.catalog_pages(fx.airports(spark, sf_dir), last)
    if airport is not None:
        lounges, pages = (x.filter(F.col("airport_code") == airport) for x in (lounges, pages))
    nested = nest_by_page(lounges, pages, LOUNGE_FIELDS)
    return (nested.withColumn("lounges", F.when(F.col("_null_array"), F.lit(None)).otherwise(F.col("lounges")))
            .drop("_null_array"))


def _flat_out(df: DataFrame) -> DataFrame:
    return df.select("airport_code", "lounge_id", "name", "terminal", "opening_hours", "amenities",
                     "access_notes", F.array_join("conditions", "|").alias("conditions_text"),
                     "image_url", "detail_url")


# ---------------------------------------------------------------------- 2.3
def q_unnest_lounges(spark, sf_dir):
    return _flat_out(cat.unnest_lounges(nested_catalog(spark, sf_dir)))


def q_lounges_for_airport(spark, sf_dir, airport: str = "A07"):
    view = "concourse_catalog_nested"
    nested_catalog(spark, sf_dir, airport).createOrReplaceTempView(view)
    return _flat_out(cat.lounges_for_airport(spark, view, airport))


def q_catalog_contract(spark, sf_dir):
    lounges = cat.unnest_lounges(nested_catalog(spark, sf_dir))
    # null out required fields on a deterministic slice so the reject side is exercised
    k = F.substring("lounge_id", 2, 9).cast("long")
    lounges = lounges.withColumn("name", F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("name")))
    checked = cat.with_contract(lounges)
    return checked.select("airport_code", "lounge_id", "amenities",
                          F.size("conditions").alias("n_conditions"), "reject_reason")


def q_require_airport(spark, sf_dir):
    p = fx.passes(spark, sf_dir)
    p = p.withColumn("airport_code", F.when(F.col("pass_id") % 13 == 0, F.lit(None))
                     .when(F.col("pass_id") % 13 == 1, F.lit("")).otherwise(F.col("airport_code")))
    return cat.with_airport_check(p).select("pass_id", "airport_code", "reject_reason")


def q_cap_per_airport(spark, sf_dir):
    return cat.cap_per_airport(fx.lounges(spark, sf_dir), 50).select("airport_code", "lounge_id", "catalog_pos")


def q_available_terminals(spark, sf_dir):
    t = cat.available_terminals(fx.lounges(spark, sf_dir))
    return t.select("airport_code", F.array_join("available_terminals", ",").alias("terminals"),
                    F.size("available_terminals").alias("n_terminals"))


# ---------------------------------------------------------------------- 2.6
def _ctx(spark, sf_dir, source="customer") -> tuple[DataFrame, plan.Catalog]:
    catalog = plan.Catalog(fx.lounges(spark, sf_dir, source))
    return plan.pass_context(fx.passes(spark, sf_dir), catalog), catalog


def q_pass_lounge_join(spark, sf_dir):
    return plan.candidate_counts(*_ctx(spark, sf_dir))


def q_stay_window(spark, sf_dir):
    w = rec.stay_window(fx.passes(spark, sf_dir))
    return w.select("pass_id", "window_status", "start_hhmm", "end_hhmm", "overnight", "duration_min",
                    F.array_join("window_assumptions", " | ").alias("window_assumptions"))


def _explode_week(hours: DataFrame, col: str) -> DataFrame:
    return hours.select("opening_hours", F.explode_outer(col).alias("iv")).select(
        "opening_hours", F.col("iv.o").alias("o"), F.col("iv.c").alias("c"))


def q_hours_to_intervals(spark, sf_dir):
    h = rec.hours_dimension(fx.lounges(spark, sf_dir))
    iv = _explode_week(h, "raw_intervals")
    day = F.floor(F.col("o") / 1440).cast("int")
    return iv.select("opening_hours", day.alias("day"), (F.col("o") - day * 1440).cast("int").alias("open_min"),
                     (F.col("c") - day * 1440).cast("int").alias("close_min"))


def q_merge_intervals(spark, sf_dir):
    h = rec.hours_dimension(fx.lounges(spark, sf_dir))
    return _explode_week(h, "intervals").filter(F.col("o").isNotNull())


def q_hours_cover_window(spark, sf_dir):
    return plan.covered_counts(*_ctx(spark, sf_dir))


def q_covering_groups(spark, sf_dir):
    return plan.covering_groups(*_ctx(spark, sf_dir))


def q_group_members(spark, sf_dir):
    return plan.Catalog(fx.lounges(spark, sf_dir)).members


def q_exclusion_summary(spark, sf_dir):
    counts = plan.with_kept(*_ctx(spark, sf_dir), ["window_status", "n_lounges", "n_unknown_hours"])
    return adv.exclusion_summary(counts)


def q_terminal_match(spark, sf_dir):
    return _ctx(spark, sf_dir)[0].select("pass_id", "effective_terminal", "terminal_tier",
                                         F.coalesce("terminal_assumption", F.lit("")).alias("terminal_assumption"))


def q_terminal_spread(spark, sf_dir):
    ctx, catalog = _ctx(spark, sf_dir, "supplier")
    rows = plan.spreads(ctx, catalog, []).select("pass_id", F.posexplode("picks").alias("pos", "p"))
    return rows.select("pass_id", F.col("p.lounge_id").alias("lounge_id"), (F.col("pos") + 1).alias("spread"))


def q_top_lounges(spark, sf_dir):
    rows = plan.ranked(*_ctx(spark, sf_dir), []).select("pass_id", F.posexplode("top").alias("pos", "t"))
    return rows.select("pass_id", F.col("t.id").alias("lounge_id"), (F.col("pos") + 1).alias("rank"))


def q_recommendation_rows(spark, sf_dir):
    r = plan.recommend_batch(fx.passes(spark, sf_dir), fx.lounges(spark, sf_dir, "supplier"))
    return r.select("pass_id", "rank", "lounge_id", "name", "terminal", "opening_hours",
                    "amenities", "access_notes", "source_url", "why_recommended")


def _routes(spark, sf_dir):
    return materialize(adv.routes_from_orders(fx.read_table(spark, sf_dir, "orders").select("o_custkey")), "routes")


def q_destination_context(spark, sf_dir):
    p = fx.passes(spark, sf_dir)
    return adv.destination_context(p, _routes(spark, sf_dir))


def _summary(spark, sf_dir, source="supplier"):
    return adv.pass_summary(plan.with_top(*_ctx(spark, sf_dir, source)), _routes(spark, sf_dir))


def q_assumptions_rollup(spark, sf_dir):
    return _summary(spark, sf_dir).select("pass_id", F.size("all_assumptions").alias("n_assumptions"),
                                          F.array_join("all_assumptions", " | ").alias("assumptions"))


def q_advisory_text(spark, sf_dir):
    return _summary(spark, sf_dir).select("pass_id", "advisory")


def advisory_records(spark, sf_dir, source="supplier", keep=()):
    return adv.advisory_record(_summary(spark, sf_dir, source), keep)


def recommendations_text() -> Column:
    """All fields of the recommendations in one string, null shown as ``-``."""
    fields = [*adv.REC_FIELDS, "source_url", "why_recommended"]
    return F.array_join(F.transform("recommendations", lambda r: F.concat_ws(
        "|", *[F.coalesce(r[f], F.lit("-")) for f in fields])), " & ")


def q_advisory_record(spark, sf_dir):
    tw, dest = F.col("time_window"), F.col("destination_context")
    return advisory_records(spark, sf_dir).select(
        "pass_id", tw["start"].alias("window_start"), tw["end"].alias("window_end"), tw["overnight"].alias("overnight"),
        F.array_join("available_terminals", ",").alias("terminals"), "advisory",
        recommendations_text().alias("recommendations"), F.array_join("assumptions", " | ").alias("assumptions"),
        dest["iata"].alias("dest_iata"), dest["flight_duration_estimate"].alias("duration"),
        dest["arrival_insight"].alias("arrival"), dest["uncertainty"].alias("uncertainty"))


def model_recommendations(spark, sf_dir) -> DataFrame:
    """F10 as rows (pass_id, airport_code, lounge_id): the ranked ids per pass, plus a foreign id
    when pass_id % 17 = 0 and a lounge of another airport when it is 1."""
    ctx, catalog = _ctx(spark, sf_dir, "supplier")
    own = plan.ranked(ctx, catalog, ["airport_code"]).select("pass_id", "airport_code", F.explode("top.id").alias("lounge_id"))
    k, p = F.col("pass_id") % 17, F.col("pass_id")
    foreign = F.when(k == 0, F.concat(F.lit("S9"), F.lpad(p.cast("string"), 8, "0"))).when(k == 1, F.lit("S000000000"))
    return own.union(ctx.select("pass_id", "airport_code", foreign.alias("lounge_id")).filter(F.col("lounge_id").isNotNull()))


def q_recommendation_integrity(spark, sf_dir):
    return adv.integrity_violations(model_recommendations(spark, sf_dir), fx.lounges(spark, sf_dir, "supplier"))


def q_report_view(spark, sf_dir):
    keep = ("airport_code", "dest_iata", "pass_terminal", "gate", "flight_number", "departure", "boarding",
            "terminal_confidence")
    return adv.report_view(advisory_records(spark, sf_dir, keep=keep))


def q_recommend_batch(spark, sf_dir):
    return plan.recommend_batch(fx.passes(spark, sf_dir), fx.lounges(spark, sf_dir))


QUERIES = {
    "unnest_lounges": q_unnest_lounges,
    "lounges_for_airport": q_lounges_for_airport,
    "catalog_contract": q_catalog_contract,
    "require_airport": q_require_airport,
    "cap_per_airport": q_cap_per_airport,
    "available_terminals": q_available_terminals,
    "pass_lounge_join": q_pass_lounge_join,
    "stay_window": q_stay_window,
    "hours_to_intervals": q_hours_to_intervals,
    "merge_intervals": q_merge_intervals,
    "hours_cover_window": q_hours_cover_window,
    "covering_groups": q_covering_groups,
    "group_members": q_group_members,
    "exclusion_summary": q_exclusion_summary,
    "terminal_match": q_terminal_match,
    "terminal_spread": q_terminal_spread,
    "top_lounges": q_top_lounges,
    "recommendation_rows": q_recommendation_rows,
    "destination_context": q_destination_context,
    "assumptions_rollup": q_assumptions_rollup,
    "advisory_text": q_advisory_text,
    "advisory_record": q_advisory_record,
    "recommendation_integrity": q_recommendation_integrity,
    "report_view": q_report_view,
    "recommend_batch": q_recommend_batch,
}
