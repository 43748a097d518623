"""What must not grow with the input: rows per task, and what a pass carries through the exchange."""

from helpers import MONDAY, lounge_row, lounges, pass_row, passes

from concourse import session
from concourse.operators import advisory as adv
from concourse.plans import recommend as plan
from concourse.sources import catalog_io as io
from concourse.streaming import micro_batch as mb


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def small(spark):
    now = MONDAY.replace(hour=9)
    lrows = [lounge_row(f"L{i}", ["05:00 - 22:00", "Open 24 hours", "08:00 - 12:00"][i % 3], ["1", "2", None][i % 2]) for i in range(9)]
    prows = [pass_row(1, now, boarding="10:00", terminal="1"), pass_row(1, now, boarding="10:00", terminal="1"), pass_row(2, now, boarding="11:00")]
    catalog = plan.Catalog(lounges(spark, lrows))
    return plan.pass_context(passes(spark, prows), catalog), catalog


def test_slots_are_not_shuffled_by_pass(spark):
    for make in (lambda c, k: plan.ranked(c, k, []), plan.covered_counts):
        p = executed(make(*small(spark)))
        assert p.count("Exchange hashpartitioning(pass_id") == 1
        assert "picks" not in p[p.index("Exchange hashpartitioning(pass_id"):] and "_e" in p


def test_rows_that_repeat_a_pass_are_ranked_together(spark):
    ctx, catalog = small(spark)
    rows = {(r.pass_id, len(r.top), r.kept, tuple(x.lounge.lounge_id for x in r.top)) for r in plan.with_top(ctx, catalog).collect()}
    assert rows == {(1, 5, 18, ("L0", "L0", "L2", "L2", "L4")), (2, 5, 9, ("L0", "L1", "L2", "L3", "L4"))}
    assert {(r.pass_id, r.terminal): r.n_lounges for r in plan.covered_counts(ctx, catalog).collect()} == {
        (1, "1"): 10, (1, "2"): 8, (2, "1"): 5, (2, "2"): 4}


def test_tasks_grow_with_rows(spark):
    one = spark.range(10).coalesce(1)
    assert session.spread(one, 450_000).rdd.getNumPartitions() == 5
    assert mb._dealt(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_integrity_and_sink(spark):
    recs = spark.createDataFrame([(1, "A01", "L1"), (2, "A01", "X")], "pass_id long, airport_code string, lounge_id string")
    bad = adv.integrity_violations(recs, lounges(spark, [lounge_row("L1", "24/7")]))
    assert "BroadcastHashJoin" in executed(bad) and [r.pass_id for r in bad.collect()] == [2]
    path = session.scratch_path(spark, "sink-test")
    rows = spark.range(3).selectExpr("id AS pass_id", *[f"'x' AS {c}" for c in (
        "time_window", "available_terminals", "advisory", "recommendations", "assumptions", "destination_context")])
    io.sink_advisory_json(rows, path)
    assert spark.read.text(path).count() == 3
    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("path").collect()
    assert files and all(r.path.endswith(".gz") for r in files)
