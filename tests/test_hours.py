"""Opening-hours grammar, merging and always-open goldens (FIXTURES part C)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from concourse.functions.hours import parse_schedules
from concourse.operators.recommend import hours_dimension

DAY, WEEK = 1440, 10080


def parse(spark, strings):
    df = spark.createDataFrame([(s,) for s in strings], "opening_hours string")
    return {r.opening_hours: r for r in hours_dimension(df).collect()}


def raw(r):
    return None if r.raw_intervals is None else sorted((x.o, x.c) for x in r.raw_intervals)


def test_grammar_goldens(spark):
    rows = parse(spark, ["24/7", "5:00 AM - 10:00 PM", "06:00 – 12:00", "Mon-Fri 06:00-20:00, Sat 08:00-12:00",
                         '{"Mon": "06:00-10:00", "Sun": "09:00 to 17:00"}', "N/A", "", "09:00 - 09:00",
                         "18:00 - 02:00", "closed", "09:00-17:00, closed", "12:00 AM - 12:00 PM"])
    assert rows["24/7"].always_open
    assert raw(rows["5:00 AM - 10:00 PM"])[0] == (300, 1320)
    assert raw(rows["06:00 – 12:00"])[0] == (360, 720)
    mf = raw(rows["Mon-Fri 06:00-20:00, Sat 08:00-12:00"])
    assert len(mf) == 6 and (5 * DAY + 480, 5 * DAY + 720) in mf and all(o < 6 * DAY for o, _ in mf)
    assert raw(rows['{"Mon": "06:00-10:00", "Sun": "09:00 to 17:00"}']) == [(360, 600), (6 * DAY + 540, 6 * DAY + 1020)]
    for unknown in ["N/A", "", "closed", "09:00-17:00, closed"]:
        assert rows[unknown].raw_intervals is None and rows[unknown].intervals is None
    assert rows["09:00 - 09:00"].always_open          # close = open -> next day, every day
    assert raw(rows["18:00 - 02:00"])[0] == (1080, 1560)  # closes after midnight
    assert raw(rows["12:00 AM - 12:00 PM"])[0] == (0, 720)


def test_merge_touching_and_midnight(spark):
    rows = parse(spark, ["06:00 - 12:00, 12:00 - 23:30", "00:00 - 11:00, 13:00 - 00:00"])
    a = sorted((x.o, x.c) for x in rows["06:00 - 12:00, 12:00 - 23:30"].intervals)
    assert (360, 1410) in a and len(a) == 21
    b = sorted((x.o, x.c) for x in rows["00:00 - 11:00, 13:00 - 00:00"].intervals)
    assert (780, DAY + 660) in b  # 13:00 today to 11:00 tomorrow is one run


def _minutes(ivs):
    s = set()
    for o, c in ivs:
        s.update(range(o, c))
    return s


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 23), st.integers(0, 23)), min_size=1, max_size=4))
def test_merged_disjoint_same_minutes(spark, ranges):
    text = ", ".join(f"{a:02d}:00 - {b:02d}:00" for a, b in ranges)
    r = parse(spark, [text])[text]
    merged = sorted((x.o, x.c) for x in r.intervals)
    for (o1, c1), (o2, c2) in zip(merged, merged[1:]):
        assert c1 < o2  # disjoint and not touching
    rep = [(o + k, c + k) for o, c in raw(r) for k in (-WEEK, 0, WEEK)]
    assert _minutes(merged) == _minutes(rep)


MON, TUE, WED, THU, FRI, SAT, SUN = range(7)


def on(days, *ranges):
    return sorted((d * 1440 + a * 60, d * 1440 + b * 60) for d in days for a, b in ranges)


def test_days_in_force(spark):
    week, work = range(7), range(5)
    want = {
        "Mon-Fri 06:00-12:00, 13:00-20:00": on(work, (6, 12), (13, 20)),
        "Mon-Fri 06:00-12:00, 13:00-20:00; Sat 08:00-10:00, 11:00-12:00": on(work, (6, 12), (13, 20)) + on([SAT], (8, 10), (11, 12)),
        "05:00 - 22:00 daily": on(week, (5, 22)), "Daily 05:00 - 22:00": on(week, (5, 22)), "24 hours daily": on(week, (0, 24)),
        "0500 - 2200": on(week, (5, 22)), "0500hrs to 2200 hrs": on(week, (5, 22)), "5am - 10pm every day": on(week, (5, 22)),
        "Mon, Wed, Fri 06:00-20:00": on([MON, WED, FRI], (6, 20)), "Mon, Wed and Fri: 06:00-20:00": on([MON, WED, FRI], (6, 20)),
        "06:00-20:00 (Mon-Fri)": on(work, (6, 20)), "06:00-20:00 (Mon, Wed, Fri)": on([MON, WED, FRI], (6, 20)),
        "06:00-12:00, 13:00-20:00 (Mon-Fri), 08:00-10:00 (Sat)": on(work, (6, 12), (13, 20)) + on([SAT], (8, 10)),
        "06:00-20:00 daily except Sat": on([MON, TUE, WED, THU, FRI, SUN], (6, 20)),
        "24 hours (except Sat and Sun)": on(work, (0, 24)), "Daily 06:00-20:00, except Sat, Sun": on(work, (6, 20)),
        "18:00 - 02:00 except Sat": on([MON, TUE, WED, THU, FRI, SUN], (18, 26)),
        "Mon-Fri 06:00-20:00, Sat closed": on(work, (6, 20)), "Daily 06:00-20:00; Sat, Sun closed": on(work, (6, 20)),
        "06:00-20:00, closed on Sun": on(range(6), (6, 20)),
        "Weekdays 06:00-20:00, weekends 08:00 - noon": on(work, (6, 20)) + on([SAT, SUN], (8, 12)),
        "06:00 - midnight": on(week, (6, 24)), "Open daily from 06:00 to 22:00": on(week, (6, 22)),
        "06:00-10:00 and 12:00-14:00": on(week, (6, 10), (12, 14)), "Fri-Mon 06:00-20:00": on([FRI, SAT, SUN, MON], (6, 20)),
        '{"Mon": "06:00-12:00, 13:00-20:00", "Sat": "closed"}': on([MON], (6, 12), (13, 20)),
    }
    unknown = ["Mon-Fri", "except Sat", "06:00-20:00 (Mon-Fri), 08:00-10:00", "Mon 06:00-20:00 Fri", "06:00-20:00, closed", "Closed", "Sat closed", "whenever",
               "Mon-Fri 06:00-20:00, Sat by request", "06:00-20:00 except Sat 10:00-12:00", "", "N/A", "2500 - 2700"]
    df = spark.createDataFrame([(x,) for x in [*want, *unknown]], "opening_hours string")
    got = {r.opening_hours: r.raw_intervals for r in parse_schedules(df).collect()}
    for text, intervals in want.items():
        assert got[text] is not None and sorted((x.o, x.c) for x in got[text]) == sorted(intervals), text
    assert [x for x in unknown if got[x] is not None] == []
