"""The two whole flows: crawled pages to catalog records, and pass text to advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concourse.operators import advisory as adv
from concourse.operators import pages as pg
from concourse.operators import passes as pt
from concourse.operators.nesting import nest_by_page
from concourse.plans import recommend as plan

MARKED = {c: pg.marked(c.replace("_", "-")) for c in ("airport_name", "airport_code", "airport_location")}
LOUNGE_FIELDS = ["lounge_id", "name", "terminal", "opening_hours", "image_url", "detail_url", "amenities",
                 "access_notes", "conditions"]


def catalog_from_pages(pages: DataFrame, details: DataFrame, needle: str = "/lounges/") -> DataFrame:
    """Airport pages (page_id, url, html) and lounge pages (url, html) -> one nested record per
    airport page. Cards without a heading are left out; a page without cards keeps ``[]``."""
    header = pg.page_header_fields(pages, fields=MARKED).drop("total_experiences")
    cards = pg.parse_cards(pg.card_explode(pages, needle).filter(F.col("card").isNotNull()).drop("name", "href"))
    good, _bad = pg.quarantine(cards)
    lounges = pg.detail_join(good, pg.parse_details(details))
    on_page = lounges.join(pages.select("page_id", "url"), "page_id")
    return nest_by_page(on_page, pages.select("page_id", "url").join(header, "page_id").drop("page_id"), LOUNGE_FIELDS)


def recommend_input(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """Parsed pass texts and their requests (pass_id, now_ts, and airport_code where the traveller
    gave it) as passes to recommend for. Only a printed terminal counts as the pass's; an
    inferred one is left to the gate rule, which states it as an assumption."""
    asked = requests.withColumn("_asked", F.col("airport_code") if "airport_code" in requests.columns
                                else F.lit(None).cast("string")).select("pass_id", "now_ts", "_asked")
    return parsed.join(asked, "pass_id").select(
        "pass_id", "now_ts", F.coalesce("_asked", "dep_iata").alias("airport_code"),
        F.col("dep_city").alias("airport_city"), F.col("boarding_time").alias("boarding"),
        F.col("departure_time").alias("departure"),
        F.when(F.col("terminal_source") == "printed", F.col("terminal_value")).alias("terminal"),
        "terminal_source", "terminal_confidence", "gate", "flight_number", "dest_iata", "dest_city",
        F.when(F.coalesce("dest_iata", "dest_city").isNotNull(), F.col("route_confidence")).otherwise(0.0)
        .alias("dest_confidence"),
        # the gate rule states an inferred terminal itself
        F.filter("assumptions", lambda a: ~a.eqNullSafe(F.col("terminal_assumption"))).alias("assumptions"))


def advise_from_text(texts: DataFrame, requests: DataFrame, cities: DataFrame, lounges: DataFrame,
                     routes: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Pass text -> parsed record -> manual edits -> nested advisory per pass, with the pass's own
    assumptions first."""
    passes = recommend_input(pt.parse_pass_text(texts, cities), requests)
    if edits is not None:
        e = pt.apply_manual_edits(passes, edits).drop("edited")
        e = e.withColumnsRenamed({"airport_iata": "airport_code", "terminal_value": "terminal"})
        passes = e.join(passes.select("pass_id", "now_ts"), "pass_id")
    catalog = plan.Catalog(lounges)
    return adv.advisory_record(adv.pass_summary(plan.with_top(plan.pass_context(passes, catalog), catalog), routes))
