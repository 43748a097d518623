"""Property tests: widening a window never adds lounges; a stream
publishes what the batch computes."""

import datetime as dt

from helpers import MONDAY, lounge_row, pass_row, passes, lounges
from hypothesis import given, settings
from hypothesis import strategies as st

from concourse.plans import recommend as plan

HOURS = ["09:00 - 17:00", "05:00 - 22:00", "18:00 - 02:00", "06:00 - 12:00, 12:00 - 23:30",
         "00:00 - 11:00, 13:00 - 00:00", "Open 24 hours", "N/A", "Mon-Fri 06:00-20:00"]


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 7 * 24 - 1), st.integers(0, 600), st.integers(1, 600))
def test_widening_never_adds(spark, start_hour, length, extra):
    now = MONDAY + dt.timedelta(hours=start_hour)
    short = (now + dt.timedelta(minutes=length)).isoformat()
    long_ = (now + dt.timedelta(minutes=length + extra)).isoformat()
    lrows = [lounge_row(f"L{i}", h, str(i % 3)) for i, h in enumerate(HOURS)]
    catalog = plan.Catalog(lounges(spark, lrows))
    ctx = plan.pass_context(passes(spark, [pass_row(1, now, departure=short), pass_row(2, now, departure=long_)]), catalog)
    got = {}
    for r in plan.covering_groups(ctx, catalog).join(catalog.members, "group_id").collect():
        got.setdefault(r.pass_id, set()).add(r.lounge_id)
    assert got.get(2, set()) <= got.get(1, set())


def test_stream_equals_batch(spark):
    from concourse.plans import fixtures as fx
    from concourse.session import scratch_path
    from concourse.streaming.micro_batch import recommend_stream
    d = "/root/testdata/sf0.001"
    base = scratch_path(spark, "test-stream")
    s = recommend_stream(spark, fx.passes(spark, d), lambda: fx.lounges(spark, d), f"{base}/src", f"{base}/out",
                         f"{base}/ckpt")
    b = plan.recommend_batch(fx.passes(spark, d), fx.lounges(spark, d))
    cols = ["pass_id", "lounge_id", "rank"]
    assert sorted(map(tuple, s.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
