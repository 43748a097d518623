"""Each cell of the grid is ranked once; the rows are those of ranking every stay on its own row."""

import datetime as dt

from helpers import MONDAY, lounge_row, lounges, pass_row, passes

from concourse.operators import recommend as rec
from concourse.plans import recommend as plan


def small(spark):
    hours = ["05:00 - 22:00", "Open 24 hours", "08:15 - 12:00", "18:00 - 02:00", "N/A", "08:30 - 11:45"]
    lrows = [lounge_row(f"L{i:02}", hours[i % 6], ["1", "2", None, "B"][i % 4]) for i in range(24)]
    prows = []
    for i, (minute, end) in enumerate([(485, "11:00"), (495, "12:00"), (510, "11:46"), (505, "08:40"), (1300, "01:59"), (1300, "02:01"), (60, None), (60, "junk")]):
        for j, (terminal, gate) in enumerate([("1", None), ("2C", None), (None, "B12"), ("9", None)]):
            prows.append(pass_row(10 * i + j, MONDAY + dt.timedelta(minutes=minute), boarding=end, terminal=terminal, gate=gate))
    prows += [prows[0], pass_row(999, MONDAY, airport="A99")]
    return passes(spark, prows), lounges(spark, lrows)


def rows(df):
    return sorted(map(str, df.collect()))


def test_cells_give_the_rows_of_single_stays(spark, monkeypatch):
    p, lo = small(spark)
    by_cell = plan.Catalog(lo)
    ctx = plan.pass_context(p, by_cell).localCheckpoint()
    assert 0 < by_cell.answers.count() < by_cell.cells.count()
    monkeypatch.setattr(plan, "MAX_CELLS", 0)
    by_row = plan.Catalog(lo)
    assert by_row.cells is None
    for make in (lambda c: plan.ranked(ctx, c, []), lambda c: plan.ranked(ctx, c, [], "left"), lambda c: plan.covered_counts(ctx, c)):
        monkeypatch.setattr(plan, "MAX_CELLS", 1_000_000)
        found = rows(make(by_cell))
        monkeypatch.setattr(plan, "MAX_CELLS", 0)
        assert found == rows(make(by_row)) and found


def test_stays_are_not_sorted_or_folded_one_by_one(spark):
    p, lo = small(spark)
    catalog = plan.Catalog(lo)
    df = plan.ranked(plan.pass_context(p.dropDuplicates(["pass_id"]), catalog), catalog, [])
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in text and "flatten" not in text


def test_printed_times(spark):
    p = passes(spark, [pass_row(i, MONDAY.replace(hour=9), boarding=b) for i, b in enumerate(
        ["9:30", "25:00", "08:59", "2024-01-01T10:05:00", "x", " ", "2023-12-31 10:00"])])
    got = {r.pass_id: (r.window_status, r.end_hhmm, r.duration_min, r.start_mow) for r in rec.stay_window(p).collect()}
    assert got == {0: ("open", "09:30", 30, 540), 1: ("unreadable", None, None, 540), 2: ("open", "08:59", 1439, 540),
                   3: ("open", "10:05", 65, 540), 4: ("unreadable", None, None, 540), 5: ("none", None, None, 540),
                   6: ("expired", "10:00", -1380, 540)}
