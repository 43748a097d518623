"""The flagship plan: passes + catalog -> ranked lounge recommendations.

    lounges -> contract -> hours per distinct string
            -> groups (airport, terminal, merged hours): count, ids of the first 5 lounges
            -> slots (airport, hour of the week, terminal, open, close): count, first 5 ids
            -> timetable (airport, hour of the week): array of its slots
            -> grid (airport, hour of the week): its opening and closing minutes, and of each cell between them the answer
            -> answers: per terminal sum of counts and first 5 ids of the slots with open <= start, end <= close; the first 5
    passes  -> airport check -> stay window, terminal tier -> dealt by pass, ids and times only
            -> equi-join with the grid on (airport, hour in which the stay begins) -> equi-join with the answer
            -> join with the lounges' details

Groups stay rows and carry ids only: a catalog lounge is read once for the groups and once more for
the at most 5 rows of a pass that show it. A stay meets only hours that are open when it
begins, and a hot airport is dealt out over the 168 hours of the week; where the timetable is too large to
broadcast, AQE splits what is still hot. Stays of one airport and hour that begin and end between the same minutes at which
lounges open or close are covered by the same lounges: each such cell is ranked once. A pass stays one row until it is
ranked: no row per pass and slot is made. With more than ``MAX_CELLS`` cells each stay is ranked on its own row instead. Passes without a window meet one row per terminal of their
airport instead (slot ``ANY``).

The cut to 5 is exact. Ranking orders by (matched, spread, id), where spread is the position among the
covered lounges of one terminal; a lounge behind 5 others of its own terminal that are open
whenever it is has a spread beyond 5, and 5 lounges rank before it. Counts are sums of all
lounges. ``pass_id`` is the key of a pass: rows that repeat one are counted together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concourse.functions.hours import WEEK_MINUTES
from concourse.operators import catalog as cat
from concourse.operators import recommend as rec
from concourse.plans.joins import fits_broadcast, sized_broadcast
from concourse.session import materialize, spread

TOP = 5
SLOT_MINUTES = 60
ANY, NONE = -1, -2                       # slots of stays without a window, and of stays that nothing covers
MAX_CELLS = 1_000_000                    # of the grid, which has a row per airport and hour; else each stay is ranked by itself
ALWAYS = 1 << 60                         # open and close of what never closes
DETAILS = ["lounge_id", "name", "terminal", "opening_hours", "amenities", "access_notes", "detail_url"]


# ------------------------------------------------------------------ catalog
class Catalog:
    """The served lounges as the plan needs them. Each table is written to the shared folder when it is first
    used, so the hours grammar runs once and a lost executor repeats nothing. ``picks`` are the first ``top``
    lounges by id, with the key (``lid``) of their details."""

    def __init__(self, lounges: DataFrame, top: int = TOP, cap: int | None = None):
        served, _rejected = cat.catalog_contract(spread(lounges))
        if cap is not None:
            served = cat.cap_per_airport(served, cap)
        hours = rec.hours_dimension(served).select("opening_hours", "intervals", "always_open")
        self.top = top
        self._served = served.select("airport_code", *DETAILS).withColumn("lid", F.xxhash64(*DETAILS))
        self._rows = self._served.join(hours, "opening_hours", "left") \
            .withColumn("gid", F.xxhash64("airport_code", "terminal", "intervals"))
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make(), name)
        return self._made[name]

    @property
    def groups(self) -> DataFrame:
        """(gid, airport_code, terminal, intervals, always_open, n, picks): the lounges of one terminal and schedule,
        however it is spelled."""
        def make() -> DataFrame:
            count = self._rows.groupBy("gid").agg(
                *[F.first(c).alias(c) for c in ("airport_code", "terminal", "intervals", "always_open")], F.count(F.lit(1)).alias("n"))
            ids = first_rows(self._rows.select("gid", "lounge_id", "lid"), ["gid"], self.top)
            return count.join(ids.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("lounge_id", "lid"))).alias("picks")), "gid")
        return self._once("groups", make)

    @property
    def shown(self) -> DataFrame:
        """(lid, lounge): a row per different lounge that can be shown, with its details."""
        def make() -> DataFrame:
            picked = self.groups.select(F.explode("picks.lid").alias("lid")).distinct()
            return self._served.join(picked, "lid").groupBy("lid").agg(F.first(F.struct(*DETAILS)).alias("lounge"))
        return self._once("shown", make)

    @property
    def slots(self) -> DataFrame:
        """(airport_code, slot, terminal, o, c, n, picks): what is open from ``o`` to ``c`` minutes of the week, at
        each hour in which a stay inside may begin; and as slot ``ANY`` each terminal, whatever the hours."""
        def make() -> DataFrame:
            key = ["airport_code", "terminal", "any", "o", "c"]
            parts = intervals_of(self.groups)
            sums = parts.groupBy(*key).agg(F.sum("n").alias("n"))
            ids = first_rows(parts.select(*key, F.explode("picks").alias("p")).select(*key, "p.*"), key, self.top)
            picks = ids.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lounge_id", "lid"))).alias("picks"))
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
            return in_slots(sums.alias("a").join(picks.alias("b"), same).select("a.*", "b.picks"))
        return self._once("slots", make)

    @property
    def timetable(self) -> DataFrame:
        """(airport_code, slot, terminals): the slots of one hour as an array of (terminal, times), times of (o, c, n, picks)."""
        def make() -> DataFrame:
            times = self.slots.groupBy("airport_code", "slot", "terminal").agg(F.collect_list(F.struct("o", "c", "n", "picks")).alias("times"))
            return times.groupBy("airport_code", "slot").agg(F.collect_list(F.struct("terminal", "times")).alias("terminals"))
        return self._once("timetable", make)

    @property
    def bounds(self) -> DataFrame:
        """(airport_code, slot, opens, closes): the minutes inside the hour at which something opens, and those at which it closes."""
        inside = F.when(F.col("o") > F.col("slot") * SLOT_MINUTES, F.col("o"))
        return self._once("bounds", lambda: self.slots.groupBy("airport_code", "slot").agg(
            F.sort_array(F.collect_set(inside)).alias("opens"), F.sort_array(F.collect_set("c")).alias("closes")))

    @property
    def cells(self) -> DataFrame | None:
        """(airport_code, slot, cell, found): of each cell of the hour, opens before closes, what covers its stays (``with_found``, in
        order); None where there are more than ``MAX_CELLS``. Stays that end behind the last close have no cell."""
        n = self.bounds.agg(F.sum((F.size("opens") + 1) * F.size("closes"))).first()[0] or 0
        if n > MAX_CELLS:
            return None

        def make() -> DataFrame:
            rows = self.bounds.repartition(self.bounds.sparkSession.sparkContext.defaultParallelism, "airport_code", "slot")
            rows = rows.select("airport_code", "slot", F.size("closes").alias("_m"), "closes",
                               F.posexplode(F.concat(F.array(F.greatest(F.col("slot"), F.lit(0)) * SLOT_MINUTES), "opens")).alias("_a", "_s"))
            rows = rows.select("airport_code", "slot", "_m", "_a", "_s", F.posexplode("closes").alias("_b", "_e"))
            rows = rows.select("airport_code", "slot", (F.col("_a") * F.col("_m") + F.col("_b")).alias("cell"),
                               F.col("airport_code").alias("_airport"), F.col("slot").alias("_slot"), "_s", "_e")
            found = with_found(rows, self.timetable, ["airport_code", "slot", "cell"], _picked(self.top))
            return found.withColumn("found", F.sort_array("found"))
        return self._once("cells", make)

    @property
    def answers(self) -> DataFrame:
        """(answer, found, kept, top, tops): a row for each different ``found``; ``top`` are its best without a matching terminal,
        ``tops`` those for each terminal that matches."""
        def make() -> DataFrame:
            rows = self.cells.filter(F.size("found") > 0).select("found").distinct().withColumn("answer", F.monotonically_increasing_id())
            tops = F.map_from_entries(F.transform(F.filter("found", lambda f: f["terminal"].isNotNull()), lambda f: F.struct(
                f["terminal"], _best(F.col("found"), self.top, lambda t: t == f["terminal"]))))
            return rows.select("answer", "found", _total(F.col("found")).alias("kept"),
                               _best(F.col("found"), self.top, lambda t: F.lit(False)).alias("top"), tops.alias("tops"))
        return self._once("answers", make)

    @property
    def grid(self) -> DataFrame:
        """(airport_code, slot, opens, closes, answers): the answer of each cell, null where nothing covers."""
        def make() -> DataFrame:
            own = sized_broadcast(self.answers.select(F.col("found").alias("_found"), "answer"))
            cells = self.cells.join(own, F.col("found") == F.col("_found"), "left")
            rows = cells.groupBy("airport_code", "slot").agg(F.sort_array(F.collect_list(F.struct("cell", "answer"))).alias("cells"))
            return self.bounds.join(rows, ["airport_code", "slot"]).select("airport_code", "slot", "opens", "closes", F.col("cells.answer").alias("answers"))
        return self._once("grid", make)

    @property
    def terminals(self) -> DataFrame:
        """(airport_code, terminal, n) of all lounges."""
        return self.groups.groupBy("airport_code", "terminal").agg(F.sum("n").alias("n"))

    @property
    def airports(self) -> DataFrame:
        """(airport_code, available_terminals, n_lounges, n_unknown_hours)."""
        return self._once("airports", lambda: self.groups.groupBy("airport_code").agg(
            F.sort_array(F.collect_set(F.when(F.col("terminal") != "", F.col("terminal")))).alias("available_terminals"),
            F.sum("n").alias("n_lounges"),
            F.sum(F.when(F.col("intervals").isNull(), F.col("n")).otherwise(0)).alias("n_unknown_hours")))

    @property
    def group_slots(self) -> DataFrame:
        """(airport_code, slot, o, c, group_id): the slots of each group."""
        return self._once("group-slots", lambda: in_slots(
            intervals_of(self.groups).select("airport_code", "any", "o", "c", group_id().alias("group_id"))))

    @property
    def members(self) -> DataFrame:
        """(group_id, lounge_id) of every lounge."""
        return self._rows.select("gid", "lounge_id").join(
            self.groups.select("gid", group_id().alias("group_id")), "gid").select("group_id", "lounge_id")


def group_id() -> Column:
    """A group's name: its airport, terminal and first lounge."""
    return F.concat_ws("/", F.col("airport_code"), F.coalesce("terminal", F.lit("-")), F.get("picks", F.lit(0))["lounge_id"])


def first_rows(rows: DataFrame, key: list[str], top: int) -> DataFrame:
    """The ``top`` rows of smallest (lounge_id, lid) of each key. The rank is cut before the shuffle as well, so a hot key
    ships ``top`` rows of each task."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("lounge_id", "lid"))
    return rows.withColumn("pos", rank).filter(F.col("pos") <= top).drop("pos")


def intervals_of(groups: DataFrame) -> DataFrame:
    """A row per group and interval (``o``, ``c``) that a stay of the base week can lie in, and one for stays without a
    window (``any``)."""
    def iv(o: Column, c: Column, any_: bool = False) -> Column:
        return F.struct(o.cast("long").alias("o"), c.cast("long").alias("c"), F.lit(any_).alias("any"))

    near = F.filter("intervals", lambda x: (x["c"] >= 0) & (x["o"] < WEEK_MINUTES))
    open_ = F.when(F.col("always_open"), F.array(iv(F.lit(-ALWAYS), F.lit(ALWAYS)))) \
        .otherwise(F.coalesce(F.transform(near, lambda x: iv(x["o"], x["c"])), F.array()))
    all_ = F.concat(open_, F.array(iv(F.lit(-ALWAYS), F.lit(ALWAYS), True)))
    return groups.withColumn("iv", F.explode(all_)).select("*", "iv.*").drop("iv", "intervals", "always_open")


def in_slots(times: DataFrame) -> DataFrame:
    first = F.floor(F.greatest(F.col("o"), F.lit(0)) / SLOT_MINUTES)
    last = F.floor(F.least(F.col("c"), F.lit(WEEK_MINUTES - 1)) / SLOT_MINUTES)
    slots = F.when(F.col("any"), F.array(F.lit(ANY).cast("long"))).otherwise(F.sequence(first, last))
    return times.withColumn("slot", F.explode(slots)).drop("any")


# ------------------------------------------------------------------- passes
def pass_context(passes: DataFrame, catalog: Catalog) -> DataFrame:
    """Every accepted pass with its facts: stay window, airport facts, effective terminal and tier; no lounges."""
    accepted, _rejected = cat.require_airport(passes)
    accepted = rec.stay_window(accepted.withColumnRenamed("terminal", "pass_terminal"))
    ctx = accepted.join(sized_broadcast(catalog.airports), "airport_code", "left")
    ctx = ctx.withColumns({
        "available_terminals": F.coalesce("available_terminals", F.array().cast("array<string>")),
        "n_lounges": F.coalesce("n_lounges", F.lit(0)),
        "n_unknown_hours": F.coalesce("n_unknown_hours", F.lit(0))})
    return rec.terminal_match(ctx, terminal="pass_terminal")


def stays_of(ctx: DataFrame, carry: list[str]) -> DataFrame:
    """The pass columns ``carry`` with airport, slot, start and end of the stay. Unknown hours hold only a stay without a window."""
    timed = F.col("window_status") == "open"
    untimed = F.col("window_status").isin("none", "unreadable")
    slot = F.when(timed, F.floor(F.col("start_mow") / SLOT_MINUTES)).when(untimed, F.lit(ANY)).otherwise(F.lit(NONE))
    return ctx.select(*carry, F.col("airport_code").alias("_airport"), slot.cast("long").alias("_slot"),
                      F.when(timed, F.col("start_mow")).otherwise(F.lit(0)).alias("_s"),
                      F.when(timed, F.col("end_mow")).otherwise(F.lit(0)).alias("_e"))


def covering(ctx: DataFrame, index: DataFrame, carry: list[str], how: str = "inner") -> DataFrame:
    """A row per pass and row of the index (``Catalog.slots``, ``Catalog.group_slots``) that holds its stay, with the pass
    columns ``carry``; with ``how="left"`` a pass without any keeps one row."""
    stays = stays_of(ctx, carry)
    t = sized_broadcast(index).withColumnsRenamed({"airport_code": "_a", "slot": "_t"})
    holds = ((F.col("_airport") == F.col("_a")) & (F.col("_slot") == F.col("_t"))
             & (F.col("o") <= F.col("_s")) & (F.col("c") >= F.col("_e")))
    return stays.join(t, holds, how).drop("_airport", "_slot", "_s", "_e", "_a", "_t", "o", "c")


def candidate_counts(ctx: DataFrame, catalog: Catalog) -> DataFrame:
    """(pass_id, airport_code, terminal, n_lounges) of the lounges of a pass's airport."""
    own = catalog.terminals.select("airport_code", "terminal", F.col("n").alias("n_lounges"))
    return ctx.select("pass_id", "airport_code").join(sized_broadcast(own), "airport_code") \
        .select("pass_id", "airport_code", "terminal", "n_lounges")


def with_found(stays: DataFrame, timetable: DataFrame, carry: list[str], value: Callable[[Column], list[Column]]) -> DataFrame:
    """``carry`` and ``found`` of each stay (``stays_of``): an array of (terminal, and what ``value`` makes of its covering
    times). It is worked out on the stay's own row, so nothing is multiplied and the stays keep their partitions."""
    t = sized_broadcast(timetable).withColumnsRenamed({"airport_code": "_a", "slot": "_t"})
    rows = stays.join(t, (F.col("_airport") == F.col("_a")) & (F.col("_slot") == F.col("_t")), "left")
    holding = F.transform("terminals", lambda t: F.struct(t["terminal"].alias("terminal"), F.filter(
        t["times"], lambda x: (x["o"] <= F.col("_s")) & (x["c"] >= F.col("_e"))).alias("times")))
    found = F.transform(F.filter(holding, lambda t: F.size(t["times"]) > 0),
                        lambda t: F.struct(t["terminal"].alias("terminal"), *value(t["times"])))
    return rows.select(*carry, F.coalesce(found, F.array()).alias("found"))


def with_answer(stays: DataFrame, catalog: Catalog, carry: list[str], names: list[str], how: str = "inner") -> DataFrame:
    """``carry`` of each stay (``stays_of``) and the columns ``names`` of its answer: two look-ups."""
    g = sized_broadcast(catalog.grid).withColumnsRenamed({"airport_code": "_a", "slot": "_t"})
    opened = F.size(F.filter("opens", lambda o: o <= F.col("_s")))
    closed = F.size(F.filter("closes", lambda c: c < F.col("_e")))
    cell = F.when(closed < F.size("closes"), F.get("answers", opened * F.size("closes") + closed))
    rows = stays.join(g, (F.col("_airport") == F.col("_a")) & (F.col("_slot") == F.col("_t")), how).select(*carry, cell.alias("_answer"))
    return rows.join(sized_broadcast(catalog.answers.select("answer", *names)), F.col("_answer") == F.col("answer"), how).select(*carry, *names)


def split_repeated(ctx: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The passes that come once, and the rows of those that come more often (or have no id), if there are any. Only ids
    are read and shuffled."""
    ids = materialize(ctx.groupBy("pass_id").count().filter("count > 1 OR pass_id IS NULL").select(F.col("pass_id").alias("_again")), "repeated")
    if ids.isEmpty():
        return ctx, None
    ids = sized_broadcast(ids)
    same = F.col("pass_id").eqNullSafe(F.col("_again"))
    return ctx.join(ids, same, "left_anti"), ctx.join(ids, same, "left_semi")


def _total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda total, x: total + x["n"])


def _counted(rows: Column) -> list[Column]:
    return [_total(rows).alias("n")]


def _picked(top: int) -> Callable[[Column], list[Column]]:
    return lambda rows: [_total(rows).alias("n"), F.slice(F.sort_array(F.flatten(rows["picks"])), 1, top).alias("picks")]


def _by_terminal(found: Column, value: Callable[[Column], list[Column]]) -> Column:
    """Entries of several rows of one pass as one entry per terminal."""
    return F.transform(F.array_distinct(found["terminal"]), lambda t: F.struct(
        t.alias("terminal"), *value(F.filter(found, lambda x: x["terminal"].eqNullSafe(t)))))


def covered_counts(ctx: DataFrame, catalog: Catalog) -> DataFrame:
    """The same of those that cover its stay."""
    key = ["pass_id", "airport_code"]
    once, again = (None, ctx) if catalog.cells is None else split_repeated(ctx)
    rows = None
    if once is not None:
        rows = with_answer(dealt(stays_of(once, key), again), catalog, key, ["found"])
        rows = rows.select(*key, F.transform("found", lambda f: F.struct(f["terminal"].alias("terminal"), f["n"].alias("n"))).alias("found"))
    if again is not None:
        timetable = catalog.timetable.select("airport_code", "slot", F.transform("terminals", lambda t: F.struct(
            t["terminal"].alias("terminal"), F.transform(t["times"], lambda x: F.struct(x["o"], x["c"], x["n"])).alias("times"))).alias("terminals"))
        per_pass = with_found(stays_of(again, key).repartition("pass_id"), timetable, key, _counted).groupBy(*key).agg(F.collect_list("found").alias("rows"))
        found = F.when(F.size("rows") == 1, F.get("rows", F.lit(0))).otherwise(_by_terminal(F.flatten("rows"), _counted))
        more = per_pass.select(*key, found.alias("found"))
        rows = more if rows is None else rows.union(more)
    return rows.select(*key, F.explode("found").alias("f")) \
        .select(*key, F.col("f.terminal").alias("terminal"), F.col("f.n").alias("n_lounges"))


def covering_groups(ctx: DataFrame, catalog: Catalog) -> DataFrame:
    """(pass_id, group_id) of the groups whose hours hold the stay. With ``Catalog.members`` it names every covering
    lounge without a row per pair of pass and lounge."""
    return covering(ctx, catalog.group_slots, ["pass_id"])


def with_kept(ctx: DataFrame, catalog: Catalog, carry: list[str]) -> DataFrame:
    """(pass_id, carry, kept): number of covering lounges of every pass."""
    cols = ["pass_id", *carry]
    return covering(ctx, catalog.slots.select("airport_code", "slot", "o", "c", "n"), cols, "left") \
        .groupBy(*cols).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))


def spreads(ctx: DataFrame, catalog: Catalog, carry: list[str]) -> DataFrame:
    """(pass_id, terminal, carry, n, picks, matched): the covering lounges of each terminal, their number and the first of
    them. Rows that repeat a pass are dealt by it and put together."""
    cols = ["pass_id", *dict.fromkeys(["terminal_tier", "effective_terminal", *carry])]
    once, again = (None, ctx) if catalog.cells is None else split_repeated(ctx)
    rows = None
    if once is not None:
        rows = with_answer(dealt(stays_of(once, cols), again), catalog, cols, ["found"]).select(*cols, F.explode("found").alias("f"))
        rows = rows.select("pass_id", "f.terminal", *cols[1:], "f.n", "f.picks")
    if again is not None:
        more = with_found(stays_of(again, cols).repartition("pass_id"), catalog.timetable, cols, _picked(catalog.top))
        more = more.select(*cols, F.explode("found").alias("f")).select(*cols, "f.*")
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("picks"))), 1, catalog.top)
        more = more.groupBy("pass_id", "terminal").agg(
            *[F.first(c).alias(c) for c in cols[1:]], F.sum("n").alias("n"), merged.alias("picks"))
        rows = more if rows is None else rows.union(more)
    return rows.withColumn("matched", _matched(F.col("terminal")))


def _matched(terminal: Column) -> Column:
    return F.coalesce((F.col("terminal_tier") < 4) & (terminal == F.col("effective_terminal")), F.lit(False))


def _best(found: Column, top: int, matched: Callable[[Column], Column] = _matched) -> Column:
    """The first ``top`` of (other, spread, id, lid): matched terminal first, then by spread, then by id."""
    def each(f: Column) -> Column:
        other = F.when(matched(f["terminal"]), F.lit(0)).otherwise(F.lit(1))
        return F.transform(f["picks"], lambda x, i: F.struct(other.alias("other"), (i + 1).alias("spread"), x["lounge_id"].alias("id"), x["lid"].alias("lid")))
    return F.slice(F.sort_array(F.flatten(F.transform(found, each))), 1, top)


def dealt(stays: DataFrame, again: DataFrame | None) -> DataFrame:
    """The stays dealt out by pass; where rows that repeat a pass stand beside them, only those are."""
    return stays.repartition("pass_id") if again is None else stays


def ranked(ctx: DataFrame, catalog: Catalog, carry: list[str], how: str = "inner") -> DataFrame:
    """(pass_id, carry, kept, top): ``top`` has (other, spread, id, lid) of the best lounges, matched terminal first, then by
    spread, then by id; ``kept`` is the number of covering ones. The rows of a pass that comes more than once are ranked
    together."""
    cols = list(dict.fromkeys(["terminal_tier", "effective_terminal", *carry]))
    if catalog.cells is None:
        return ranked_by_row(ctx, catalog, cols, carry, how)
    once, again = split_repeated(ctx)
    rows = ranked_once(dealt(stays_of(once, ["pass_id", *cols]), again), catalog, ["pass_id", *carry], how)
    return rows if again is None else rows.union(ranked_by_row(again, catalog, cols, carry, how))


def ranked_once(stays: DataFrame, catalog: Catalog, carry: list[str], how: str = "inner") -> DataFrame:
    """``carry``, ``kept`` and ``top`` of each stay, which has ``terminal_tier`` and ``effective_terminal``."""
    cols = list(dict.fromkeys([*carry, "terminal_tier", "effective_terminal"]))
    rows = with_answer(stays, catalog, cols, ["kept", "top", "tops"], how)
    own = F.when(F.col("terminal_tier") < 4, F.try_element_at("tops", F.col("effective_terminal")))
    none = F.array().cast(rows.schema["top"].dataType)
    return rows.select(*carry, F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce(own, "top", none).alias("top"))


def ranked_by_row(ctx: DataFrame, catalog: Catalog, cols: list[str], carry: list[str], how: str = "inner") -> DataFrame:
    """``ranked``, worked out on each pass's own row. The stays are dealt by pass once. Only the rows of a pass that comes
    more than once hand on what they found, to be ranked together."""
    stay = ["_airport", "_slot", "_s", "_e"]
    dealt = stays_of(ctx, ["pass_id", *cols]).repartition("pass_id").groupBy("pass_id").agg(
        *[F.first(c).alias(c) for c in cols], F.collect_list(F.struct(*stay)).alias("_stays"))
    stays = dealt.select("pass_id", *cols, (F.size("_stays") > 1).alias("_again"), F.explode("_stays").alias("_stay")) \
        .select("pass_id", *cols, "_again", "_stay.*")
    value = _picked(catalog.top)
    rows = with_found(stays, catalog.timetable, ["pass_id", *cols, "_again"], value)
    if how == "inner":
        rows = rows.filter(F.size("found") > 0)
    one = rows.select("pass_id", *cols, _total(F.col("found")).alias("kept"), _best(F.col("found"), catalog.top).alias("top"),
                      F.when(F.col("_again"), F.col("found")).alias("found"))
    per_pass = one.groupBy("pass_id").agg(*[F.first(c).alias(c) for c in [*cols, "kept", "top"]],
                                          F.flatten(F.collect_list("found")).alias("found"))
    again = F.size("found") > 0
    return per_pass.withColumn("found", F.when(again, _by_terminal(F.col("found"), value))).select(
        "pass_id", *carry, F.coalesce(_total(F.col("found")), F.col("kept")).alias("kept"),
        F.coalesce(_best(F.col("found"), catalog.top), F.col("top")).alias("top"))


def ranked_rows(ctx: DataFrame, catalog: Catalog, carry: list[str]) -> DataFrame:
    """(pass_id, carry, rank, matched, lounge): one row per recommended lounge; only here its details are looked up."""
    rows = ranked(ctx, catalog, carry).select("pass_id", *carry, F.posexplode("top").alias("pos", "t"))
    rows = rows.select("pass_id", *carry, (F.col("pos") + 1).alias("rank"), (F.col("t.other") == 0).alias("matched"), "t.lid")
    return rows.join(sized_broadcast(catalog.shown), "lid").drop("lid")


def with_top(ctx: DataFrame, catalog: Catalog) -> DataFrame:
    """Every pass with ``kept`` and ``top``: array of (pos, other, lounge). The passes are written once; each gets its
    answer on its own row, and only those that repeat a pass are joined by it."""
    ctx = materialize(ctx, "passes")
    if catalog.cells is None or not fits_broadcast(catalog.shown):
        return _with_top_joined(ctx, catalog)
    once, again = split_repeated(ctx)
    rows = ranked_once(stays_of(once, ctx.columns), catalog, ctx.columns, "left")
    if again is not None:
        best = ranked_by_row(again, catalog, ["terminal_tier", "effective_terminal"], [], "left")
        rows = rows.union(again.join(best, "pass_id").select(*ctx.columns, "kept", "top"))
    return _with_details(rows, catalog, ctx.columns)


def _with_details(rows: DataFrame, catalog: Catalog, carry: list[str]) -> DataFrame:
    """The details of each place are looked up on the pass's own row."""
    for i in range(catalog.top):
        shown = F.broadcast(catalog.shown).select(F.col("lid").alias(f"_lid{i}"), F.col("lounge").alias(f"_lounge{i}"))
        rows = rows.join(shown, F.get("top", F.lit(i))["lid"] == F.col(f"_lid{i}"), "left")
    lounges = F.array(*[F.col(f"_lounge{i}") for i in range(catalog.top)])
    top = F.transform("top", lambda t, i: F.struct(i.alias("pos"), t["other"].alias("other"), F.get(lounges, i).alias("lounge")))
    return rows.select(*carry, "kept", top.alias("top"))


def _with_top_joined(ctx: DataFrame, catalog: Catalog) -> DataFrame:
    best = ranked(ctx, catalog, [], "left")
    if fits_broadcast(catalog.shown):
        return _with_details(ctx.join(best, "pass_id"), catalog, ctx.columns)
    rows = best.select("pass_id", "kept", F.posexplode_outer("top").alias("pos", "t"))
    rows = rows.join(catalog.shown, F.col("t.lid") == F.col("lid"), "left")
    top = F.when(F.col("pos").isNotNull(), F.struct("pos", F.col("t.other").alias("other"), "lounge"))
    per_pass = rows.groupBy("pass_id").agg(F.first("kept").alias("kept"), F.sort_array(F.collect_list(top)).alias("top"))
    return ctx.join(per_pass, "pass_id")


def recommendations(rows: DataFrame) -> DataFrame:
    """One row per (pass, recommended lounge): the seven copied lounge fields
    (``detail_url`` as ``source_url``) + ``why_recommended``."""
    lounge = F.col("lounge")
    return rows.select(
        "pass_id", "rank", lounge["lounge_id"].alias("lounge_id"), lounge["name"].alias("name"),
        lounge["terminal"].alias("terminal"), lounge["opening_hours"].alias("opening_hours"),
        lounge["amenities"].alias("amenities"), lounge["access_notes"].alias("access_notes"),
        lounge["detail_url"].alias("source_url"), "terminal_tier", "matched",
        rec.why_recommended(F.col("terminal_tier"), F.col("matched"), lounge["terminal"],
                            F.col("window_status"), F.col("start_hhmm"), F.col("end_hhmm")).alias("why_recommended"))


def recommend_batch(passes: DataFrame, lounges: DataFrame, top: int = TOP, cap: int | None = None) -> DataFrame:
    """Flat recommendation rows: one per (pass, recommended lounge)."""
    catalog = Catalog(lounges, top, cap)
    carry = ["terminal_tier", "window_status", "start_hhmm", "end_hhmm"]
    return recommendations(ranked_rows(pass_context(passes, catalog), catalog, carry))
