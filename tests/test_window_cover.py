"""Stay window, coverage and terminal goldens (FIXTURES part C)."""

import datetime as dt

from helpers import MONDAY, lounge_row, pass_row, passes, lounges

from concourse.operators.recommend import stay_window
from concourse.plans import recommend as plan


def window(spark, rows):
    return {r.pass_id: r for r in stay_window(passes(spark, rows)).collect()}


def test_stay_window_goldens(spark):
    now = MONDAY.replace(hour=10, minute=30, second=20)
    w = window(spark, [
        pass_row(1, now, boarding="10:30"),                      # equal -> zero length today
        pass_row(2, now, boarding="10:29"),                      # one minute earlier -> tomorrow
        pass_row(3, now, boarding="11:00", departure="10:45"),  # boarding wins
        pass_row(4, now, departure="2024-01-01T12:15:00"),       # ISO datetime as is
        pass_row(5, now, departure="2023-12-31 09:00"),          # ISO in the past
        pass_row(6, now, boarding="25:99"),                      # unreadable
        pass_row(7, now),                                        # both missing
    ])
    assert (w[1].window_status, w[1].duration_min, w[1].overnight) == ("open", 0, False)
    assert (w[2].duration_min, w[2].overnight, w[2].end_hhmm) == (1439, True, "10:29")
    assert w[3].end_hhmm == "11:00"
    assert (w[4].end_hhmm, w[4].duration_min) == ("12:15", 105)
    assert w[5].window_status == "expired"
    assert w[6].window_status == "unreadable" and w[6].window_assumptions
    assert w[7].window_status == "none" and w[7].end_hhmm is None


def covered(spark, prows, lrows):
    """(pass, lounge) of all covering lounges, named by the covering groups and their members."""
    catalog = plan.Catalog(lounges(spark, lrows))
    groups = plan.covering_groups(plan.pass_context(passes(spark, prows), catalog), catalog)
    return {(r.pass_id, r.lounge_id) for r in groups.join(catalog.members, "group_id").collect()}


def test_cover_edges(spark):
    now = MONDAY.replace(hour=9)
    sunday_late = dt.datetime(2024, 1, 7, 23, 0)  # Sunday 23:00
    got = covered(spark, [
        pass_row(1, now, boarding="17:00"),
        pass_row(2, now, boarding="17:01"),
        pass_row(3, sunday_late, boarding="01:00"),
        pass_row(4, now, departure="2024-01-03T09:00:00"),
        pass_row(5, now),
    ], [
        lounge_row("L1", "09:00 - 17:00"),     # opens exactly at start, closes exactly at end
        lounge_row("L2", "Sun 22:00 - 23:59, Mon 00:00 - 02:00"),
        lounge_row("L3", "Open 24 hours"),
        lounge_row("L4", "N/A"),
    ])
    assert (1, "L1") in got and (2, "L1") not in got         # one minute short is excluded
    assert (3, "L2") not in got                               # 23:59 -> 00:00 leaves a gap
    assert (3, "L3") in got and (4, "L3") in got              # > 1 day in a 24-hour lounge
    assert (4, "L1") not in got
    assert (1, "L4") not in got and (5, "L4") in got          # unknown hours: only without window


def test_sunday_monday_wrap(spark):
    sunday_late = dt.datetime(2024, 1, 7, 23, 0)
    got = covered(spark, [pass_row(1, sunday_late, boarding="01:00")],
                  [lounge_row("L1", "Sun 22:00 - 00:00, Mon 00:00 - 02:00")])
    assert got == {(1, "L1")}


def tiers(spark, prows, lrows):
    ctx = plan.pass_context(passes(spark, prows), plan.Catalog(lounges(spark, lrows)))
    return {r.pass_id: (r.terminal_tier, r.effective_terminal) for r in ctx.collect()}


def test_terminal_tiers(spark):
    now = MONDAY.replace(hour=9)
    t = tiers(spark, [
        pass_row(1, now, terminal="2"), pass_row(2, now, terminal="2C"), pass_row(3, now, gate="B12"),
        pass_row(4, now), pass_row(5, now, terminal="N/A"), pass_row(6, now, terminal="1", airport="A02"),
    ], [lounge_row("L1", "24/7", "2"), lounge_row("L2", "24/7", "B"), lounge_row("L3", "24/7", None, "A02")])
    assert t[1] == (1, "2") and t[2] == (2, "2") and t[3] == (3, "B")
    assert t[4] == (4, None) and t[5] == (4, None) and t[6] == (4, None)


def test_available_terminals_order(spark):
    from concourse.operators.catalog import available_terminals
    lo = lounges(spark, [lounge_row("L1", "24/7", "T2"), lounge_row("L2", "24/7", "T10"),
                         lounge_row("L3", "24/7", "N/A"), lounge_row("L4", "24/7", ""),
                         lounge_row("L5", "24/7", None)])
    r = available_terminals(lo).collect()[0]
    assert r.available_terminals == ["N/A", "T10", "T2"]


def test_top5_subset_and_permutation(spark):
    now = MONDAY.replace(hour=9)
    prows = [pass_row(i, now, boarding="10:00", terminal=["1", "2", None][i % 3]) for i in range(1, 7)]
    lrows = [lounge_row(f"L{i}", "05:00 - 22:00", ["1", "2", "3"][i % 3]) for i in range(12)]
    a = {(r.pass_id, r.lounge_id, r.rank) for r in plan.recommend_batch(passes(spark, prows), lounges(spark, lrows)).collect()}
    b = {(r.pass_id, r.lounge_id, r.rank) for r in plan.recommend_batch(
        passes(spark, prows[::-1]), lounges(spark, lrows[::-1])).collect()}
    assert a == b and len(a) == 30
    cands = covered(spark, prows, lrows)
    assert {(p, lo) for p, lo, _ in a} <= cands


def unpruned(spark, prows, lrows, top=5):
    """Ranking over all covered pairs, in plain Python."""
    tier = tiers(spark, prows, lrows)
    terminal = {r[0]: r[3] for r in lrows}
    own = {}
    for p, lo in covered(spark, prows, lrows):
        own.setdefault(p, []).append(lo)
    out = set()
    for p, ids in own.items():
        seen, rows = {}, []
        for lo in sorted(ids):
            t = terminal[lo]
            seen[t] = seen.get(t, 0) + 1
            rows.append((not (tier[p][0] < 4 and t == tier[p][1]), seen[t], lo))
        out |= {(p, lo, i + 1) for i, (_, _, lo) in enumerate(sorted(rows)[:top])}
    return out


def test_group_prune_equals_unpruned_ranking(spark):
    now = MONDAY.replace(hour=9)
    hours = ["05:00 - 22:00", "5:00 to 22:00", "09:00 - 17:00", "Open 24 hours", "N/A", "08:00 - 09:30, 10:00 - 12:00, 13:00 - 23:00"]
    lrows = [lounge_row(f"L{i:03}", hours[i * 7 % 6], ["1", "2", "B", None, "N/A"][i * 3 % 5]) for i in range(160)]
    prows = [pass_row(i, now, boarding=[None, "09:20", "16:30", "21:00", "23:30", "08:00"][i % 6],
                      terminal=["1", "2C", None, "N/A"][i % 4], gate="B2" if i % 3 else None) for i in range(48)]
    got = {(r.pass_id, r.lounge_id, r.rank) for r in plan.recommend_batch(passes(spark, prows), lounges(spark, lrows)).collect()}
    assert got == unpruned(spark, prows, lrows)
    catalog = plan.Catalog(lounges(spark, lrows))
    ctx = plan.pass_context(passes(spark, prows), catalog)
    kept = {r.pass_id: r.kept for r in plan.with_kept(ctx, catalog, []).collect()}
    pairs = covered(spark, prows, lrows)
    assert kept == {p[0]: sum(x == p[0] for x, _ in pairs) for p in prows}


def test_every_lounge_of_a_large_airport_counts(spark):
    now = MONDAY.replace(hour=9)
    lrows = [lounge_row(f"L{i:04}", "09:00 - 17:00" if i % 2 else "N/A", "1") for i in range(300)]
    lrows.append(lounge_row("Z", "Open 24 hours", "9"))
    catalog = plan.Catalog(lounges(spark, lrows))
    r = plan.with_top(plan.pass_context(passes(spark, [pass_row(1, now, boarding="10:00", terminal="9")]), catalog), catalog).collect()[0]
    assert (r.n_lounges, r.n_unknown_hours, r.kept) == (301, 150, 151)
    assert r.top[0].lounge.lounge_id == "Z" and r.available_terminals == ["1", "9"]


def test_broadcast_is_measured(spark):
    from concourse.plans.joins import fits_broadcast, measured
    slots = plan.Catalog(lounges(spark, [
        lounge_row(f"L{i}", "00:00 - 05:00, 08:00 - 12:00, 13:00 - 23:00", str(i)) for i in range(40)])).slots
    n, size = measured(slots)
    assert n > 40 * 7 * 18 and size > n * 30   # 40 terminals, each open in 18 hours of a day
    assert fits_broadcast(slots) and not fits_broadcast(slots, max_bytes=size - 1) and not fits_broadcast(slots, max_rows=0)


def test_repeated_and_missing_values(spark):
    """Lounges that repeat an id or a whole row, null terminals, stays over a week, unreadable times."""
    now = MONDAY.replace(hour=9)
    lrows = [lounge_row("L1", "Open 24 hours", "1"), lounge_row("L1", "Open 24 hours", "1"), lounge_row("L1", "09:00 - 17:00", None),
             lounge_row("L2", "09:00 - 17:00", None), lounge_row("L3", "N/A", "")]
    prows = [pass_row(1, now, boarding="10:00", terminal="1"), pass_row(2, now, departure="2024-01-20T09:00:00"),
             pass_row(3, now, boarding="25:99"), pass_row(4, now, departure="2023-01-01T00:00:00"), pass_row(5, now, airport="A99")]
    catalog = plan.Catalog(lounges(spark, lrows))
    ctx = plan.pass_context(passes(spark, prows), catalog)
    top = {r.pass_id: r for r in plan.with_top(ctx, catalog).collect()}
    assert {i: r.kept for i, r in top.items()} == {1: 4, 2: 2, 3: 5, 4: 0, 5: 0}
    assert [x.lounge.lounge_id for x in top[1].top] == ["L1", "L1", "L1", "L2"] and top[4].top == [] == top[5].top
    assert [x.lounge.terminal for x in top[1].top] == ["1", "1", None, None]
    counts = {(r.pass_id, r.terminal): r.n_lounges for r in plan.covered_counts(ctx, catalog).collect()}
    assert counts == {(1, "1"): 2, (1, None): 2, (2, "1"): 2, (3, "1"): 2, (3, None): 2, (3, ""): 1}
    assert plan.recommend_batch(passes(spark, []), lounges(spark, lrows)).count() == 0
    assert plan.recommend_batch(passes(spark, prows), lounges(spark, [])).count() == 0
