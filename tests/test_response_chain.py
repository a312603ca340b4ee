"""The response chain over large tables: rows are exchanged once per order, and no side of as many rows is sent to the driver."""

import pytest

from aerovigil import session
from aerovigil.operators import coordination as C
from aerovigil.operators import ledger as L
from aerovigil.operators import management as M
from aerovigil.operators import response as R
from aerovigil.plans import swarm_queries as Q
from aerovigil.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf):
    d = session.durable(Q.detection(session.tune(spark), sf).select(*Q._DETECTED))
    return d, session.durable(R.respond(d))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_side_of_as_many_rows_is_never_broadcast(spark, tables):
    d, r = tables
    narrow = C.combine(d, r).select("source_row_id", "notify_gcc")
    assert "BroadcastHashJoin" not in plan(narrow) and "SortMergeJoin" in plan(narrow)


def test_decisions_need_neither_trust_nor_join(tables):
    d, r = tables
    policy = R.greedy_policy(R.action_values(R.prepare(d)))
    decided = R.decide(R.prepare(d), policy)
    names = ["source_row_id", "safety_constraint", "rf_action_taken", "rf_channel_mode", "net_action_taken", "net_selected_action",
             "lte_fallback_active", "notify_neighbors", "notify_edge", "notify_gcc", "safety_override", "reactive_triggered"]
    assert rows(decided, *names) == rows(r, *names)
    assert "Exchange" not in plan(R.decide(R.prepare(d)))


def test_trust_adds_no_exchange_to_the_detection(spark, sf):
    df = C.node_trust(Q._decided(session.tune(spark), sf)).select("source_row_id", "trust_after", "coordination_status")
    assert plan(df).count("Exchange hashpartitioning") == 1 and "Join" not in plan(df)


def test_coordination_of_one_table_and_of_two(tables):
    d, r = tables
    one, two = C.coordinate(session.durable(C.combine(d, r)), None), C.coordinate(d, r)
    names = [c for c in two.columns if c not in ("detection_reason_codes", "coordinated_nodes")]
    assert one.columns == two.columns and rows(one, *names) == rows(two, *names)


def test_batches_whatever_the_ranges_and_the_number_of_tables(tables):
    d, r = tables
    c = session.durable(C.coordinate(d, r))
    whole = C.node_trust(C.combine(d, r))
    names = ["batch", "batch_start_row", "batch_end_row", *M.KPIS, *M.FRACTIONS]
    want = rows(M.kpi_batches(d, r, c), *names)
    assert want == rows(M.kpi_batches(whole, rows_per_partition=250), *names) and len(want) == -(-d.count() // 30)


def test_a_log_sealed_for_the_report_carries_only_what_it_reads(tables):
    d, r = tables
    events = L.node_events(C.combine(d, r))
    whole, short = L.seal(events), L.seal(events, rows_per_partition=300, keep=L.REPORTED)
    assert {"sensor_summary", "trust_score_after"} <= set(whole.columns) and not {"sensor_summary", "trust_score_after"} & set(short.columns)
    names = ["event_id", "log_hash", "batch_id"]
    assert rows(whole, *names) == rows(short, *names)
    reports = [rows(L.log_report(x, L.merkle_batches(x)), "dimension", "item", "n", "share") for x in (whole, short)]
    assert reports[0] == reports[1]


def test_clamped_trust_runs_in_the_exchange_of_the_detection(spark, sf):
    for name in ("d12_clamped_trust", "b29_state_vector"):
        found = plan(QUERIES[name](session.tune(spark), sf))
        assert found.count("Exchange hashpartitioning") == 1 and "Join" not in found and "/stage-" not in found, name


def test_reasons_travel_as_bits(spark, sf):
    from aerovigil.operators import fusion as FU
    df = Q.telemetry(session.tune(spark), sf, scores=True)
    base = FU.attach_scores(df, None, None)
    limits = FU.fusion_limits(base)
    assert [n for n, _ in FU._reasons(limits)] == FU.REASONS
    want = {r[0]: r[1] for r in base.select("source_row_id", FU.reason_codes(limits)).collect()}
    assert want == {r[0]: r[1] for r in FU.fuse(df, limits=limits).select("source_row_id", "detection_reason_codes").collect()}


def test_recent_nodes_across_short_ranges(spark):
    """Ranges shorter than the frame, null nodes and labels: as a scan over the sorted rows finds it."""
    import random
    chance = random.Random(3)
    data = [(chance.randrange(15), chance.choice(["b", "a", "c", "é", None]), i, chance.choice(["JAMMING", "DOS", "NORMAL", "SUSPICIOUS", None]),
             chance.choice([0.2, 0.5, 0.9, None])) for i in range(120)]
    df = spark.createDataFrame(data, "t int, node_id string, source_row_id int, final_label string, fusion_confidence double").selectExpr(
        "timestamp_seconds(t) as ts", "node_id", "source_row_id", "final_label", "fusion_confidence")
    order = sorted(data, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode(), r[2]))
    want = {}
    for i, r in enumerate(order):
        last = order[max(0, i - 9):i + 1]
        sure = {x[1] for x in last if x[1] is not None and x[3] in ("JAMMING", "DOS") and (x[4] or 0) >= 0.5}
        odd = {x[1] for x in last if x[1] is not None and x[3] not in ("NORMAL", None)}
        want[r[2]] = (sorted(sure, key=str.encode), min(len(odd) / 5, 1.0), i + 1)
    for size in (4, 7, 50, 1000):
        out = C.in_global_order(df, rows_per_task=size).collect()
        assert {r["source_row_id"]: (r["coordinated_nodes"], r["multi_node_factor"], r["_pos"]) for r in out} == want, size


def test_the_log_needs_no_join_by_row_id(spark, sf):
    """Counts carry no trust through the exchanges; the whole log has it, and both count the same events."""
    few, whole = (Q._events(session.tune(spark), sf, whole=w) for w in (False, True))
    for events in (few, whole):
        assert "SortMergeJoin" not in plan(events)
    assert rows(L.log_analytics(few), "dimension", "item", "n") == rows(L.log_analytics(whole), "dimension", "item", "n")
    assert whole.where("source_type = 'uav_ugv'").agg({"sensor_summary.signal_trust_after": "min"}).first()[0] < 1.0


def test_rows_without_time_are_logged(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("* except (l_shipdate)", "if(l_orderkey % 50 = 0, null, l_shipdate) as l_shipdate").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    t = Q.telemetry(spark, str(tmp_path), "ts")
    there = t.where("ts is not null").count()
    counts = dict(Q._events(session.tune(spark), str(tmp_path), whole=False).groupBy("source_type").count().collect())
    assert there < t.count() and counts == {"uav_ugv": t.count(), "edge": there, "gcc": -(-there // 30)}
