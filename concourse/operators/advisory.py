"""Advisory assembly: exclusions, destination context, assumptions,
advisory text, the nested per-pass record, integrity check and display strings.

Everything here is an expression on the pass row, which already carries its counts and
its ranked lounges (``concourse.plans.recommend``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.operators.recommend import A_NO_DESTINATION, ALTERNATIVES, why_recommended
from concourse.plans.joins import sized_broadcast


def with_exclusions(ctx: DataFrame) -> DataFrame:
    """Adds candidates, excluded for time / unknown hours and ``none_cover`` to passes that
    carry ``kept``, ``n_lounges`` and ``n_unknown_hours``."""
    unknown = F.when(F.col("window_status").isin("open", "expired"), F.col("n_unknown_hours")).otherwise(F.lit(0))
    s = ctx.withColumns({"candidates": F.col("n_lounges").cast("long"), "excluded_unknown": unknown.cast("long")})
    return s.withColumns({
        "excluded_time": F.col("candidates") - F.col("kept") - F.col("excluded_unknown"),
        "none_cover": (F.col("candidates") > 0) & (F.col("kept") == 0)})


EXCLUSION_COLS = ["pass_id", "candidates", "kept", "excluded_time", "excluded_unknown", "none_cover"]


def exclusion_summary(ctx: DataFrame) -> DataFrame:
    """Per pass: candidates, kept, excluded for time, excluded for unknown hours."""
    return with_exclusions(ctx).select(*EXCLUSION_COLS)


def routes_from_orders(orders: DataFrame) -> DataFrame:
    """F8 route table (origin, dest, minutes) derived from the orders' customer routes;
    pairs with ``(i + j) % 4 = 0`` are left out on purpose (no route knowledge)."""
    i, j = F.col("o_custkey") % 25, (F.col("o_custkey") + 7) % 25
    pairs = orders.select(i.alias("i"), j.alias("j")).distinct().filter((F.col("i") + F.col("j")) % 4 != 0)
    code = lambda c: F.concat(F.lit("A"), F.lpad(c.cast("string"), 2, "0"))
    return pairs.select(code(F.col("i")).alias("origin"), code(F.col("j")).alias("dest"),
                        (30 + 17 * F.abs(F.col("i") - F.col("j"))).cast("int").alias("minutes"))


def with_destination(ctx: DataFrame, routes: DataFrame, dest_iata: str = "dest_iata",
                     dest_city: str = "dest_city") -> DataFrame:
    """Per pass: destination struct fields, null when the destination is missing.

    Duration and arrival come only from the optional ``routes`` table (left join);
    without a route they stay null and ``uncertainty`` says so."""
    if dest_city not in ctx.columns:
        ctx = ctx.withColumn(dest_city, F.lit(None).cast("string"))
    r = sized_broadcast(routes).select(F.col("origin").alias("airport_code"),
                                       F.col("dest").alias(dest_iata), "minutes")
    j = ctx.join(r, ["airport_code", dest_iata], "left")
    has = F.col(dest_iata).isNotNull() | F.col(dest_city).isNotNull()
    mins = F.col("minutes")
    band = (F.when(mins < 180, "short-haul").when(mins < 360, "medium-haul").otherwise("long-haul"))
    duration = F.when(mins.isNotNull(), F.concat(band, F.lit(" (~"), mins.cast("string"), F.lit(" min)")))
    dep = F.regexp_extract(F.col("departure"), r"^(\d{2}):(\d{2})$", 0)
    dep_min = (F.substring(dep, 1, 2).try_cast("int") * 60 + F.substring(dep, 4, 2).try_cast("int"))
    arr = dep_min + mins
    arrival = F.when((dep != "") & mins.isNotNull(), F.concat(
        F.lit("Arrives around "),
        F.format_string("%02d:%02d", F.floor(F.pmod(arr, F.lit(1440)) / 60).cast("int"), (F.pmod(arr, F.lit(1440)) % 60).cast("int")),
        F.lit(" departure-airport time"),
        F.when(arr >= 1440, F.lit(" (next day)")).otherwise(F.lit("")), F.lit(".")))
    uncertainty = (F.when(mins.isNull(), F.lit("No route data; flight duration and arrival not estimated."))
                   .otherwise(F.lit("Duration from the route table; time zones unknown.")))
    j = j.withColumn("has_destination", has)
    has = F.col("has_destination")
    return j.withColumns({
        dest_iata: F.when(has, F.col(dest_iata)),
        dest_city: F.when(has, F.col(dest_city)),
        "flight_duration_estimate": F.when(has, duration),
        "arrival_insight": F.when(has, arrival),
        "uncertainty": F.when(has, uncertainty)}).drop("minutes")


DESTINATION_COLS = ["pass_id", "has_destination", "dest_iata", "dest_city", "flight_duration_estimate",
                    "arrival_insight", "uncertainty"]


def destination_context(ctx: DataFrame, routes: DataFrame, dest_iata: str = "dest_iata",
                        dest_city: str = "dest_city") -> DataFrame:
    return with_destination(ctx, routes, dest_iata, dest_city).select(*DESTINATION_COLS)


def assumptions_col(own: str = "assumptions") -> Column:
    """Ordered assumptions: the pass's own, terminal, stay window, destination
    (over a frame with the context, destination and exclusion columns)."""
    dest_note = F.when(F.col("has_destination"), F.col("uncertainty")).otherwise(F.lit(A_NO_DESTINATION))
    return F.concat(F.coalesce(F.col(own), F.array().cast("array<string>")),
                    F.filter(F.array(F.col("terminal_assumption")), lambda x: x.isNotNull()),
                    F.col("window_assumptions"),
                    F.filter(F.array(dest_note), lambda x: x.isNotNull()))


def advisory_col() -> Column:
    """One paragraph: window, terminals, exclusions, destination."""
    st = F.col("window_status")
    window = (F.when(st == "open", F.concat(F.lit("Your stay runs from "), F.col("start_hhmm"), F.lit(" to "),
                                            F.col("end_hhmm"),
                                            F.when(F.col("overnight"), F.lit(" (overnight)")).otherwise(F.lit("")),
                                            F.lit(".")))
              .when(st == "expired", F.lit("The end of your stay is already past."))
              .otherwise(F.lit("No boarding or departure time is known, so every lounge is considered.")))
    terms = F.when(F.size("available_terminals") > 0,
                   F.concat(F.lit(" Lounges are available in terminals "),
                            F.array_join("available_terminals", ", "), F.lit(".")))
    counts = F.when(F.col("candidates") > 0, F.concat(
        F.lit(" "), F.col("kept").cast("string"), F.lit(" of "), F.col("candidates").cast("string"),
        F.lit(" lounges cover your whole stay; "), F.col("excluded_time").cast("string"),
        F.lit(" excluded due to opening hours, "), F.col("excluded_unknown").cast("string"),
        F.lit(" with unknown hours.")))
    none = (F.when(F.col("candidates") == 0,
                   F.concat(F.lit(" No lounges are listed at this airport. "), F.lit(ALTERNATIVES)))
            .when(F.col("none_cover"), F.concat(F.lit(" No lounge is open for your whole stay. "),
                                                F.lit(ALTERNATIVES))))
    destination = F.when(F.col("has_destination"), F.concat(
        F.lit(" Destination: "), F.coalesce(F.col("dest_iata"), F.col("dest_city")),
        F.when(F.col("flight_duration_estimate").isNotNull(),
               F.concat(F.lit(", "), F.col("flight_duration_estimate"))).otherwise(F.lit("")),
        F.lit(".")))
    return F.concat(window, F.coalesce(terms, F.lit("")), F.coalesce(counts, F.lit("")),
                    F.coalesce(none, F.lit("")), F.coalesce(destination, F.lit("")))


def pass_summary(ctx: DataFrame, routes: DataFrame) -> DataFrame:
    """One wide row per pass: context + destination (routes by size) + exclusions + the advisory
    text and assumption list, the pass's own assumptions first."""
    wide = with_exclusions(with_destination(ctx, routes))
    if "assumptions" not in wide.columns:
        wide = wide.withColumn("assumptions", F.array().cast("array<string>"))
    return wide.withColumns({"all_assumptions": assumptions_col(), "advisory": advisory_col()})


REC_FIELDS = ["lounge_id", "name", "terminal", "opening_hours", "amenities", "access_notes"]


def advisory_record(summary: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One nested row per pass of a summary with ``top``, with the pass columns ``keep``;
    ``recommendations`` is ``[]`` when
    there are none, ``time_window`` null without a window, ``destination_context`` null
    when the destination is missing."""
    time_window = F.when(F.col("window_status").isin("open", "expired"), F.struct(
        F.col("start_hhmm").alias("start"), F.col("end_hhmm").alias("end"), F.col("overnight")))

    def one(t: Column) -> Column:
        lounge = t["lounge"]
        why = why_recommended(F.col("terminal_tier"), t["other"] == 0, lounge["terminal"], F.col("window_status"),
                              F.col("start_hhmm"), F.col("end_hhmm"))
        return F.struct(*[lounge[f].alias(f) for f in REC_FIELDS], lounge["detail_url"].alias("source_url"),
                        why.alias("why_recommended"))

    dest_ctx = F.when(F.col("has_destination"), F.struct(
        F.col("dest_iata").alias("iata"), F.col("dest_city").alias("city"),
        "flight_duration_estimate", "arrival_insight", "uncertainty"))
    return summary.select(
        "pass_id", *keep,
        time_window.alias("time_window"),
        "available_terminals",
        "advisory",
        F.transform("top", one).alias("recommendations"),
        F.col("all_assumptions").alias("assumptions"),
        dest_ctx.alias("destination_context"))


def integrity_violations(model_recs: DataFrame, lounges: DataFrame) -> DataFrame:
    """(pass_id, lounge_id) of the recommendations (pass_id, airport_code, lounge_id) whose
    lounge is no candidate of that airport: ``left_anti`` against the whole catalog, whose
    keys are broadcast once measured."""
    valid = lounges.select("airport_code", "lounge_id")
    return model_recs.join(sized_broadcast(valid), ["airport_code", "lounge_id"], "left_anti").select("pass_id", "lounge_id")


def assert_integrity(violations: DataFrame) -> None:
    """Job-wrapper check: an invented lounge id is an error (mirrors the reference)."""
    bad = violations.limit(1).collect()
    if bad:
        raise ValueError(f"model invented lounge_id {bad[0]['lounge_id']!r} for pass {bad[0]['pass_id']}")


def _pct(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))


SHOWN = {"airport_text": "airport_code", "airport_city_text": "airport_city", "destination_text": "dest_iata",
         "destination_city_text": "dest_city", "terminal_text": "pass_terminal", "gate_text": "gate",
         "flight_text": "flight_number", "departure_text": "departure", "boarding_text": "boarding"}
SHOWN_PERCENT = {"terminal_confidence_text": "terminal_confidence", "destination_confidence_text": "dest_confidence"}


def report_view(records: DataFrame) -> DataFrame:
    """Display strings of advisory records that kept their pass columns. A field that the pass
    does not have at all is ``N/A``; one that is there and null stays null. Times read ``start
    to end`` (+ `` (overnight)``), terminals are joined by ``, ``, confidences are whole percents."""
    tw = F.col("time_window")
    time_text = F.when(tw.isNotNull() & tw["start"].isNotNull(), F.concat(
        tw["start"], F.lit(" to "), tw["end"], F.when(tw["overnight"], F.lit(" (overnight)")).otherwise(F.lit(""))))
    terminals = F.when(F.size("available_terminals") > 0, F.array_join("available_terminals", ", "))
    return records.select(
        "pass_id", *[(F.col(c) if c in records.columns else F.lit("N/A")).alias(n) for n, c in SHOWN.items()],
        *[_pct(F.col(c)).alias(n) for n, c in SHOWN_PERCENT.items() if c in records.columns],
        time_text.alias("time_text"), terminals.alias("terminals_text"),
        F.size("recommendations").alias("n_recommendations"))
