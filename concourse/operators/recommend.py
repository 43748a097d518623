"""Recommendation rules: passes x catalog -> ranked lounges.

Row-local rules; the plan that composes them is ``concourse.plans.recommend``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.hours import (
    always_open_expr, merge_intervals_expr, parse_schedules, replicate_weeks)

HHMM_RE = r"^\s*(\d{1,2}):(\d{2})\s*$"

# Fixed wording of the generated assumptions and advisory sentences.
A_NO_TIMES = "Boarding and departure times are missing; no time filtering was applied."
A_UNREADABLE = "Boarding/departure time could not be read; no time filtering was applied."
A_DEPARTURE_USED = "Boarding time not provided; departure time used as the end of the stay."
A_OVERNIGHT = "End time is earlier than the current time; assumed to be on the next day (overnight)."
A_EXPIRED = "End time is already past; no lounge can cover the stay."
A_NO_DESTINATION = "Destination is missing; no destination context."
ALTERNATIVES = "Consider rest areas, cafes or quiet seating near your gate."


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


# ---------------------------------------------------------------- stay window
def _clock(hour: Column, minute: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))


def _hour_and_minute(raw: Column) -> tuple[Column, Column]:
    """Of a printed ``HH:MM``, null for anything else."""
    return tuple(F.regexp_extract(raw, HHMM_RE, i).try_cast("int") for i in (1, 2))


def _end_minute(hh: Column, mm: Column, iso: Column, start_day: Column, start_mod: Column) -> Column:
    """Absolute minute (days since epoch x 1440 + minute) of a printed end time, given as its ``_hour_and_minute`` and, where it
    has none, as a timestamp.

    ``HH:MM`` -> today, or tomorrow when strictly earlier than now; an ISO datetime
    is used as is; anything else -> null. ``try_cast`` is not used for ``HH:MM``:
    it would silently fill in the real current date."""
    mod = hh * 60 + mm
    rolled = start_day.cast("long") * 1440 + mod + F.when(mod < start_mod, F.lit(1440)).otherwise(F.lit(0))
    iso_abs = F.unix_date(F.to_date(iso)).cast("long") * 1440 + F.hour(iso) * 60 + F.minute(iso)
    return F.when((hh <= 23) & (mm <= 59), rolled).otherwise(iso_abs)


def stay_window(passes: DataFrame, now: str = "now_ts", boarding: str = "boarding",
                departure: str = "departure") -> DataFrame:
    """Adds the stay window: start = now (minute precision), end = boarding else departure.

    Columns: ``window_status`` (open / none / unreadable / expired), ``start_hhmm``,
    ``end_hhmm``, ``overnight``, ``duration_min``, ``start_mow`` and ``end_mow``
    (minutes of the week, Monday 00:00 = 0) and ``window_assumptions``."""
    now_c = F.col(now)
    start_day = F.unix_date(F.to_date(now_c))
    start_mod = F.hour(now_c) * 60 + F.minute(now_c)
    # Each step is a column, read once: an expression used in several places is evaluated in each, and the code
    # that Spark makes of a long chain of them is too long to be compiled.
    out = passes.withColumns({"_b": _blank_to_null(F.col(boarding)), "_d": _blank_to_null(F.col(departure))})
    b, d = F.col("_b"), F.col("_d")
    (hb, mb), (hd, md) = _hour_and_minute(b), _hour_and_minute(d)
    out = out.withColumns({"_start_day": start_day, "_start_mod": start_mod, "_hb": hb, "_mb": mb, "_hd": hd, "_md": md})
    sd, sm, hb, hd = F.col("_start_day"), F.col("_start_mod"), F.col("_hb"), F.col("_hd")
    out = out.withColumns({"_iso_b": F.when(hb.isNull(), b.try_cast("timestamp_ntz")), "_iso_d": F.when(hd.isNull(), d.try_cast("timestamp_ntz"))})
    out = out.withColumns({"_end_b": _end_minute(hb, F.col("_mb"), F.col("_iso_b"), sd, sm),
                           "_end_d": _end_minute(hd, F.col("_md"), F.col("_iso_d"), sd, sm),
                           "_any_raw": b.isNotNull() | d.isNotNull()})
    end_b, end_d = F.col("_end_b"), F.col("_end_d")
    out = out.withColumns({
        "_start_abs": sd.cast("long") * 1440 + sm,
        "start_mow": (F.weekday(now_c) * 1440 + sm).cast("long"),
        "_end_abs": F.coalesce(end_b, end_d),
        "_end_from": F.when(end_b.isNotNull(), "boarding").when(end_d.isNotNull(), "departure")})
    end_abs, start_abs = F.col("_end_abs"), F.col("_start_abs")
    status = (F.when(end_abs.isNull() & F.col("_any_raw"), "unreadable")
              .when(end_abs.isNull(), "none")
              .when(end_abs < start_abs, "expired")
              .otherwise("open"))
    has_end = end_abs.isNotNull()
    end_mod = F.pmod(end_abs, F.lit(1440))
    duration = end_abs - start_abs
    out = out.withColumns({
        "window_status": status,
        "start_hhmm": F.coalesce(_clock(F.hour(now_c), F.minute(now_c)), F.lit("null:null")),
        "end_hhmm": F.when(has_end, _clock(F.floor(end_mod / 60).cast("int"), (end_mod % 60).cast("int"))),
        "overnight": F.when(has_end, F.floor(end_abs / 1440) > sd),
        "duration_min": duration,
        "end_mow": F.col("start_mow") + duration})
    assumptions = F.filter(F.array(
        F.when(F.col("window_status") == "none", F.lit(A_NO_TIMES)),
        F.when(F.col("window_status") == "unreadable", F.lit(A_UNREADABLE)),
        F.when(F.col("_end_from") == "departure", F.lit(A_DEPARTURE_USED)),
        F.when((F.col("window_status") == "open") & F.col("overnight"), F.lit(A_OVERNIGHT)),
        F.when(F.col("window_status") == "expired", F.lit(A_EXPIRED)),
    ), lambda x: x.isNotNull())
    return (out.withColumn("window_assumptions", assumptions)
            .drop("_start_day", "_start_mod", "_b", "_d", "_hb", "_mb", "_hd", "_md", "_iso_b", "_iso_d", "_end_b", "_end_d", "_start_abs", "_end_abs",
                  "_end_from", "_any_raw"))


# --------------------------------------------------------------------- hours
def hours_dimension(lounges: DataFrame, hours: str = "opening_hours") -> DataFrame:
    """One row per distinct schedule string: raw weekly intervals, merged intervals
    (replicated one week either side) and the always-open flag."""
    d = parse_schedules(lounges, hours).withColumn("_rep", replicate_weeks("raw_intervals"))
    d = d.withColumn("intervals", F.when(F.col("raw_intervals").isNotNull(), merge_intervals_expr("_rep")))
    return d.withColumn("always_open", F.coalesce(always_open_expr("intervals"), F.lit(False))).drop("_rep")


# ------------------------------------------------------------ terminal rules
def gate_core(gate: Column) -> Column:
    """``Gate B12``/``GATE B12`` -> ``B12``; ``G12`` -> ``12``; ``B2`` stays ``B2``."""
    return _without_g(_without_gate(gate))


def _without_gate(gate: Column) -> Column:
    return F.regexp_replace(F.trim(gate), r"(?i)^gate\s*", "")


def _without_g(g: Column) -> Column:
    g = F.when(g.rlike(r"^[Gg]\d"), F.substring(g, 2, 1 << 20)).otherwise(g)
    return F.when(F.trim(g) != "", F.trim(g))


def terminal_match(passes: DataFrame, terminal: str = "terminal", gate: str = "gate",
                   available: str = "available_terminals") -> DataFrame:
    """Effective terminal and tier for each pass.

    1 exact: the pass terminal is one of the airport's terminals;
    2 mapped: otherwise its leading digits (``2C`` -> ``2``) are one, with an assumption;
    3 inferred: no pass terminal, the gate's leading letters (``B12`` -> ``B``) are one;
    4 none: recommendations are spread across terminals.
    A pass terminal ``N/A`` counts as missing."""
    avail = F.coalesce(F.col(available), F.array().cast("array<string>"))
    passes = passes.withColumns({"_t0": F.trim(F.col(terminal)), "_named": _without_gate(F.col(gate))})
    t0, named = F.col("_t0"), F.col("_named")
    passes = passes.withColumns({"_t": F.when((t0 != "") & (F.upper(t0) != "N/A"), t0), "_gate": _without_g(named)})
    t = F.col("_t")
    passes = passes.withColumns({
        "_mapped": F.nullif(F.regexp_extract(t, r"^(\d+)", 1), F.lit("")),
        "_letters": F.nullif(F.regexp_extract(F.upper(F.col("_gate")), r"^([A-Z]+)", 1), F.lit(""))})
    mapped, letters = F.col("_mapped"), F.col("_letters")
    def listed(own: Column) -> Column:     # a lambda ends what Spark compiles into one method
        return F.exists(avail, lambda x: x == own)

    tier = (F.when(t.isNotNull() & listed(t), 1)
            .when(t.isNotNull() & mapped.isNotNull() & listed(mapped), 2)
            .when(t.isNull() & letters.isNotNull() & listed(letters), 3)
            .otherwise(4))
    passes = passes.withColumn("terminal_tier", tier)
    tier = F.col("terminal_tier")
    eff = F.when(tier == 1, t).when(tier == 2, mapped).when(tier == 3, letters)
    assumption = (F.when(tier == 2, F.concat(F.lit("Terminal "), t, F.lit(" mapped to terminal "), mapped, F.lit(".")))
                  .when(tier == 3, F.concat(F.lit("Terminal inferred as "), letters, F.lit(" from gate "),
                                            F.col("_gate"), F.lit(".")))
                  .when((tier == 4) & t.isNotNull(), F.concat(F.lit("Terminal "), t,
                                                F.lit(" matches no lounge terminal; recommendations spread across terminals.")))
                  .when(tier == 4, F.lit("Terminal unknown; recommendations spread across terminals.")))
    return (passes.withColumns({"effective_terminal": eff, "terminal_assumption": assumption})
            .drop("_t0", "_t", "_named", "_gate", "_mapped", "_letters"))


def why_recommended(tier: Column, matched: Column, terminal: Column, status: Column,
                    start: Column, end: Column) -> Column:
    where = (F.when(matched & (tier == 1), F.concat(F.lit("Same terminal as your flight ("), terminal, F.lit(").")))
             .when(matched & (tier == 2), F.concat(F.lit("In terminal "), terminal, F.lit(", mapped from your terminal.")))
             .when(matched & (tier == 3), F.concat(F.lit("In terminal "), terminal, F.lit(", inferred from your gate.")))
             .when(terminal.isNotNull(), F.concat(F.lit("In terminal "), terminal, F.lit(".")))
             .otherwise(F.lit("Terminal not listed.")))
    when_ = (F.when(status == "open", F.concat(F.lit(" Open for your whole stay ("), start, F.lit(" to "), end, F.lit(")."))))
    return F.concat(where, F.coalesce(when_, F.lit("")))
