"""Plan-shape guards for the flagship: passes are read once and dealt out once, and no lounge text goes with them.

These read the executed (AQE final) plan after a ``noop`` write, the same way the
README's shuffle inventory was measured.
"""

import re

from helpers import SF_SMALL

from concourse.plans import fixtures as fx
from concourse.plans import recommend as plan


def executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_deals_passes_once(spark):
    df = plan.recommend_batch(fx.passes(spark, SF_SMALL), fx.lounges(spark, SF_SMALL))
    p = executed_plan(df).split("== Initial Plan ==")[0]
    assert p.count("FileScan parquet [event_id") == 1
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", p)
    assert len(dealt) == 1 and dealt[0].startswith("pass_id"), dealt
    # no pass-keyed (bigint) hashed relation is broadcast: pass rows grow with the data
    assert "SortMergeJoin" not in p and "Window" not in p
    # catalog rows that passes meet carry ids; details come after the cut to the first 5
    before = p[p.index("Exchange hashpartitioning(pass_id"):]
    assert "amenities" not in before and "access_notes" not in before


def test_a_stay_meets_what_is_open_when_it_begins(spark):
    """Rows per pass follow the groups open in one hour, not all groups of the airport."""
    catalog = plan.Catalog(fx.lounges(spark, SF_SMALL))
    ctx = plan.pass_context(fx.passes(spark, SF_SMALL), catalog)
    slots = catalog.slots.filter(f"slot <> {plan.ANY}")
    assert slots.groupBy("airport_code", "slot").count().count() > 100
    assert plan.covering(ctx, catalog.slots, ["pass_id"]).count() >= plan.covered_counts(ctx, catalog).count()


def test_advisory_and_report_read_passes_once(spark):
    from concourse.plans import registry_serving as reg
    for q in (reg.q_advisory_record, reg.q_report_view, reg.q_exclusion_summary):
        p = executed_plan(q(spark, SF_SMALL))
        assert p.count("FileScan parquet [event_id") <= 1, q.__name__
