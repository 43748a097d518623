"""Opening-hours grammar as staged Catalyst expressions (no UDF).

A schedule string becomes ``array<struct<o:int, c:int>>`` of open intervals in
minutes of the week (Monday 00:00 = 0). Accepted shapes:

* ``24 hours`` / ``Open 24 hours`` / ``24/7`` / ``24 hours daily``
* ``HH:MM - HH:MM`` with ``-``, en/em dash, ``to`` or ``until``; 12-hour times
  with ``am``/``pm``; ``.`` or nothing between hour and minute (``0500``); ``noon``, ``midnight``
* several ranges separated by ``,``, ``;`` or ``and``
* days before a range (``Mon 06:00-20:00``, ``Mon-Fri ...``, ``Fri-Mon ...`` which wraps,
  ``Mon, Wed, Fri ...``, ``daily``, ``weekdays``): they hold for the ranges after it, up to the next days
* days behind a range (``06:00-20:00 (Mon-Fri)``, ``06:00-20:00 daily``): they hold for it and
  for the ranges before it that have no days. Ranges without any days hold every day
* ``Sat closed``, ``closed on Sat`` and ``... except Sat``: what opens on those days is taken away
* a JSON object ``{"Mon": "06:00-20:00", ...}``

A close time at or before the open time ends on the next day. Anything else,
including ``closed`` without a day, one unreadable range inside an otherwise valid string, days without a range, or ranges
with days behind them next to ranges without, makes the whole schedule unknown (null) — unknown hours
are never guessed.

``parse_schedules`` runs on the *distinct* schedule strings (a small dimension),
row by row: the segments of a string are parsed with ``transform`` and then folded
(``aggregate``) with the days that are in force, so there is no explode and no regroup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MINUTES = 1440
WEEK_MINUTES = 7 * DAY_MINUTES

_DAY = r"(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?"
_SEP = r"\s*(?:-|–|—|to|until|till|through)\s*"
_TIME = r"(\d{1,2})(?:[:.]?(\d{2}))?(?:\s*([ap])\.?m?\.?)?(?:\s*(?:hrs?|h))?"
_DAYS = rf"{_DAY}(?:{_SEP}{_DAY})?"
#: What a segment may be. Groups: 1 except; 2, 3 days before; 4 closed; 5 all day; 6-8 opens; 9-11 closes; 12, 13 days behind.
SEGMENT_RE = (rf"^\s*(except\s+)?(?:{_DAYS}\s*:?\s*)?(?:(closed)|(24\s*(?:hours|hrs|h)|24\s*/\s*7)|{_TIME}{_SEP}{_TIME})?"
              rf"(?:\s*:?\s*(?:on\s+)?{_DAYS})?\s*$")
#: Other ways to say the same, in lower case.
SAME = [
    (r"[()\[\]]", " "),
    (r"^\s*(?:opening\s+)?(?:hours|times)\s*:", " "),
    (r"\b(?:open|opens|opening|from)\b", " "),
    (r"\b(?:daily|every\s*day|all\s+days|(?:7|seven)\s+days(?:\s+a\s+week)?)\b", " mon-sun "),
    (r"\bweekdays?\b", " mon-fri "), (r"\bweekends?\b", " sat-sun "),
    (r"\s+a\s+day\b", " mon-sun "),
    (r"\bmidnight\b", "00:00"), (r"\b(?:noon|midday)\b", "12:00"),
    (r"[,;]?\s*\b(?:except|excluding|apart\s+from|but\s+not)(?:\s+(?:on|for))?\b", "; except "),
    (rf"(?<=[a-z.])\s*(?:&|\+|/|\band\b)\s*(?={_DAY}\b)", ", "),
    (r"(?<=[\dm.h])\s*(?:&|\+|\band\b)\s*(?=\d)", ", "),
]

INTERVALS_TYPE = "array<struct<o:int,c:int>>"
STATE_TYPE = ("struct<ok:boolean,days:array<int>,pending:boolean,excepting:boolean,suffixed:boolean,"
              "undated:array<struct<o:int,c:int>>,last:array<struct<o:int,c:int>>,minus:array<int>,"
              "out:array<struct<o:int,c:int>>>")


def _day_list(first: Column, last: Column) -> Column:
    """Day numbers from ``first`` to ``last``, round the week's end if need be; none for ''."""
    def number(name: Column) -> Column:
        at = F.call_function("instr", F.lit("montuewedthufrisatsun"), F.substring(name, 1, 3))
        return F.floor((at - 1) / 3).cast("int")

    return _let(F.struct(first.alias("first"), number(first).alias("a"), F.when(last == "", number(first)).otherwise(number(last)).alias("b")),
                lambda d: F.when(d["first"] == "", F.array().cast("array<int>")).otherwise(F.transform(
                    F.sequence(d["a"], F.when(d["b"] >= d["a"], d["b"]).otherwise(d["b"] + 7)), lambda q: q % 7)))


def _minute(h: Column, m: Column, ap: Column) -> Column:
    """Minute of day of one printed time, or null when out of range."""
    hh = h.try_cast("int")
    mm = F.coalesce(F.nullif(m, F.lit("")).try_cast("int"), F.lit(0))
    apl = F.lower(ap)
    hour24 = F.when((apl == "p") & (hh < 12), hh + 12).when((apl == "a") & (hh == 12), F.lit(0)).otherwise(hh)
    valid = (hh.between(0, 24) & mm.between(0, 59) & ~((hh == 24) & (mm > 0))
             & ((ap == "") | hh.between(1, 12)))
    return F.when(valid, hour24 * 60 + mm)


def _plain(s: Column) -> Column:
    s = F.lower(s)
    for pattern, same in SAME:
        s = F.regexp_replace(s, pattern, same)
    return s


def _segments(s: Column) -> Column:
    def cut(v: Column) -> Column:
        return F.filter(F.split(_plain(v), "[,;\n]"), lambda x: F.trim(x) != "")

    entries = F.map_entries(F.from_json(s, "map<string,string>"))
    json_segs = F.flatten(F.transform(entries, lambda e: F.transform(
        cut(e["value"]), lambda v: F.concat(F.lower(e["key"]), F.lit(" "), F.trim(v)))))
    return F.when(F.ltrim(s).startswith("{"), json_segs).otherwise(cut(s))


def _let(value: Column, body) -> Column:
    # evaluate ``value`` once and use it several times in ``body``
    return F.get(F.transform(F.array(value), body), 0)


def _segment(seg: Column) -> Column:
    """struct<kind, before, behind, own>; a null kind is unreadable, ``own`` the range of a day."""
    def groups(x: Column) -> Column:
        return F.struct(x.rlike(SEGMENT_RE).alias("fits"), *[F.regexp_extract(x, SEGMENT_RE, i).alias(f"g{i}") for i in range(1, 14)])

    def parts(g: Column) -> Column:
        o = F.when(g["g5"] != "", F.lit(0)).otherwise(_minute(g["g6"], g["g7"], g["g8"]))
        c = F.when(g["g5"] != "", F.lit(DAY_MINUTES)).otherwise(_minute(g["g9"], g["g10"], g["g11"]))
        return F.struct(g.alias("g"), o.alias("o"), F.when(c <= o, c + DAY_MINUTES).otherwise(c).alias("c"),
                        _day_list(g["g2"], g["g3"]).alias("before"), _day_list(g["g12"], g["g13"]).alias("behind"))

    def kind(x: Column) -> Column:
        g, days = x["g"], (F.size(x["before"]) > 0) & (F.size(x["behind"]) == 0)
        timed = (g["g5"] != "") | (g["g6"] != "")
        return F.struct(
            F.when(~g["fits"], F.lit(None))
            .when(g["g1"] != "", F.when(days & ~timed & (g["g4"] == ""), F.lit("except")))
            .when(g["g4"] != "", F.lit("closed"))
            .when(timed, F.when(x["o"].isNotNull() & x["c"].isNotNull(), F.lit("range")))
            .when(days, F.lit("days")).alias("kind"),
            x["before"].alias("before"), x["behind"].alias("behind"),
            F.array(F.struct(x["o"].cast("int").alias("o"), x["c"].cast("int").alias("c"))).alias("own"))

    return _let(_let(_let(seg, groups), parts), kind)


def _on(days: Column, ranges: Column) -> Column:
    return F.flatten(F.transform(days, lambda d: F.transform(ranges, lambda r: F.struct(
        (d * DAY_MINUTES + r["o"]).alias("o"), (d * DAY_MINUTES + r["c"]).alias("c")))))


def _step(st: Column, g: Column) -> Column:
    """The state after one more segment. ``days`` are in force for ranges without days of their own, ``pending`` if
    no range followed them yet; ``undated`` ranges had no days so far; ``last`` ranges had days behind them."""
    week, nothing = F.sequence(F.lit(0), F.lit(6)), F.array().cast(INTERVALS_TYPE)
    no_days = F.array().cast("array<int>")

    def facts() -> Column:
        before = F.size(g["before"]) > 0
        listed = F.when(st["pending"], F.array_union(st["days"], g["before"])).otherwise(g["before"])
        days = F.when(before, listed).otherwise(st["days"])
        range_ = F.coalesce(g["kind"] == "range", F.lit(False))
        return F.struct(
            days.alias("days"), listed.alias("listed"), before.alias("before"),
            F.array_union(F.when(st["pending"], listed).otherwise(g["before"]), g["behind"]).alias("shut"),
            F.concat(st["undated"], g["own"]).alias("ranges"),
            (range_ & (F.size(g["behind"]) > 0)).alias("behind"),                             # 06:00-20:00 Mon
            (range_ & (F.size(g["behind"]) == 0) & (F.size(days) > 0)).alias("dated"),        # Mon 06:00-20:00, or days in force
            (range_ & (F.size(g["behind"]) == 0) & (F.size(days) == 0)).alias("bare"))        # 06:00-20:00

    def new(f: Column) -> Column:
        kind = F.coalesce(g["kind"], F.lit(""))
        starts = f["dated"] & (f["before"] | st["pending"])   # new days: undated ranges before them hold every day
        return F.struct(
            F.when(f["behind"], st["ok"] & ~f["before"] & ~st["pending"]).when(kind == "closed", st["ok"] & (F.size(f["shut"]) > 0))
            .when(kind == "except", st["ok"] & ~st["pending"]).when(kind == "", F.lit(False)).otherwise(st["ok"]).alias("ok"),
            F.when(f["behind"] | (kind == "closed"), no_days).when(f["dated"], f["days"])
            .when((kind == "days") & ~st["excepting"], f["listed"]).otherwise(st["days"]).alias("days"),
            F.when(f["dated"] | (kind == "closed"), F.lit(False)).when((kind == "days") & ~st["excepting"], F.lit(True))
            .otherwise(st["pending"]).alias("pending"),
            F.when(kind == "range", F.lit(False)).when(kind == "except", F.lit(True)).otherwise(st["excepting"]).alias("excepting"),
            (st["suffixed"] | f["behind"]).alias("suffixed"),
            F.when(f["behind"] | starts, nothing).when(f["bare"], f["ranges"]).otherwise(st["undated"]).alias("undated"),
            F.when(f["behind"], f["ranges"]).when(f["dated"], nothing).otherwise(st["last"]).alias("last"),
            F.when(kind == "closed", F.array_union(st["minus"], f["shut"]))
            .when((kind == "except") | ((kind == "days") & st["excepting"]), F.array_union(st["minus"], g["before"]))
            .otherwise(st["minus"]).alias("minus"),
            F.concat(st["out"], F.when(starts, _on(week, st["undated"])).otherwise(nothing),
                     F.when(f["behind"], _on(g["behind"], f["ranges"])).when(f["dated"], _on(f["days"], g["own"])).otherwise(nothing))
            .alias("out")).cast(STATE_TYPE)

    return _let(facts(), new)


def _finish(st: Column) -> Column:
    """Raw intervals of the week, or null. Days left over behind a range with days belong to it (``06:00-20:00 Mon, Wed``)."""
    nothing = F.array().cast(INTERVALS_TYPE)
    left = F.size(st["undated"]) > 0
    ok = st["ok"] & ~(left & st["suffixed"]) & ~(st["pending"] & (F.size(st["last"]) == 0))
    all_ = F.concat(st["out"], F.when(st["pending"], _on(st["days"], st["last"])).otherwise(nothing),
                    F.when(left, _on(F.sequence(F.lit(0), F.lit(6)), st["undated"])).otherwise(nothing))
    return _let(F.when(ok, all_), lambda x: F.when(F.size(x) > 0, F.filter(
        x, lambda iv: ~F.array_contains(st["minus"], F.floor(iv["o"] / DAY_MINUTES).cast("int")))))


def weekly_intervals(s: Column) -> Column:
    """Schedule string -> raw weekly intervals, or null when unknown."""
    none, no = F.array(), F.lit(False)
    start = F.struct(F.lit(True).alias("ok"), none.alias("days"), no.alias("pending"), no.alias("excepting"), no.alias("suffixed"),
                     none.alias("undated"), none.alias("last"), none.alias("minus"), none.alias("out")).cast(STATE_TYPE)
    parsed = F.transform(_segments(s), _segment)
    return _let(F.aggregate(parsed, start, _step), lambda st: _finish(st)).cast(INTERVALS_TYPE)


def parse_schedules(df: DataFrame, col: str = "opening_hours") -> DataFrame:
    """Distinct ``col`` values -> (``col``, ``raw_intervals``) with null = unknown."""
    return df.select(col).distinct().select(col, weekly_intervals(F.col(col)).alias("raw_intervals"))


def replicate_weeks(col: str) -> Column:
    """Copy intervals one week before and after, so a stay that wraps Sunday->Monday
    or starts inside an interval opened the previous week can be tested directly."""
    return F.flatten(F.transform(
        F.array(F.lit(-WEEK_MINUTES), F.lit(0), F.lit(WEEK_MINUTES)),
        lambda k: F.transform(F.col(col), lambda iv: F.struct(
            (iv["o"] + k).alias("o"), (iv["c"] + k).alias("c")))))


def merge_intervals_expr(col: str) -> Column:
    """Touching or overlapping intervals become one (sorted fold over the array)."""
    return F.expr(
        f"aggregate(array_sort(`{col}`), CAST(array() AS {INTERVALS_TYPE}), "
        f"(acc, iv) -> CASE WHEN size(acc) > 0 AND iv.o <= element_at(acc, -1).c "
        f"THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('o', element_at(acc, -1).o, "
        f"'c', greatest(element_at(acc, -1).c, iv.c)))) ELSE concat(acc, array(iv)) END)")


def always_open_expr(col: str) -> Column:
    """A merged interval longer than two weeks: a weekly schedule with any closed
    minute merges into runs shorter than that, so this means open at every minute."""
    return F.exists(F.col(col), lambda iv: iv["c"] - iv["o"] >= 2 * WEEK_MINUTES)
