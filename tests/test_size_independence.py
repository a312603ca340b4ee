"""Results must not depend on how large a key, group or table is, nor on null keys and missing values."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerovigil import session
from aerovigil.operators import response, sampling, series
from aerovigil.operators.ledger import failed_batches, merkle_batches, seal, verify
from aerovigil.operators.ordered import add_positions, order_rows
from aerovigil.operators.peers import peer_deviations
from aerovigil.operators.quality import imputation_medians
from aerovigil.operators.quantiles import exact_quantiles, grouped_quantiles
from aerovigil.operators.trust import clamped_trust


def nodes(spark, nulls, hot):
    """Rows of a null node, a hot node and a small one."""
    rng = np.random.default_rng(3)
    names = [None] * nulls + ["hot"] * hot + ["small"] * 12
    rows = [(n, int(i), float(rng.normal()), datetime(2024, 1, 1) + timedelta(seconds=int(rng.integers(0, 90))))
            for i, n in zip(rng.permutation(len(names)), names)]
    return spark.createDataFrame(rows, "node_id string, source_row_id long, x double, ts timestamp").repartition(4)


@pytest.mark.parametrize(("nulls", "hot"), [(30, 258), (200, 40), (150, 150)])
def test_null_and_hot_nodes_keep_every_row(spark, nulls, hot):
    df = nodes(spark, nulls, hot)
    out = []
    for size in (1_000_000, 60):
        s = order_rows(df, ["ts", "source_row_id"], ["node_id"], halo=3, rows_per_task=size)
        warm = s.finish(series.warmup_statistics(s, s.rows, ["x"]))
        run = s.finish(s.running(s.rows, {"total": ("sum", F.col("x")), "top": ("max", F.col("x"))}))
        trust = clamped_trust(df, {"t": (F.col("x") / 10, F.lit(0.01))}, rows_per_task=size)
        both = warm.select("source_row_id", "_mu_x", "_sd_x").join(run.select("source_row_id", "total", "top", "_pos"), "source_row_id")
        out.append(both.join(trust, "source_row_id").toPandas().sort_values("source_row_id").reset_index(drop=True))
    assert len(out[0]) == len(out[1]) == nulls + hot + 12
    for c in out[0].columns:
        assert np.allclose(out[0][c], out[1][c]), c


def test_positions_of_null_keys(spark):
    got = add_positions(nodes(spark, 100, 150), ["ts", "source_row_id"], ["node_id"], rows_per_partition=40).toPandas()
    for _, g in got.groupby("node_id", dropna=False):
        assert g.sort_values(["ts", "source_row_id"])["_pos"].tolist() == list(range(1, len(g) + 1))


def test_positions_need_one_exchange_of_the_rows(spark):
    placed = add_positions(nodes(spark, 10, 50), ["ts", "source_row_id"], rows_per_partition=20)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # the written rows are not exchanged again


def test_group_quantiles_do_not_depend_on_size(spark):
    rng = np.random.default_rng(5)
    rows = [(k, None if k == "empty" else float("nan") if rng.random() < 0.2 else float(rng.integers(0, 50))) for k in ["empty", "big", None] for _ in range(300)]
    rows += [(f"k{i}", float(i)) for i in range(20)] + [("void", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = [grouped_quantiles(df, ["k"], {"q": ("v", 0.3)}, rows_per_task=n, inside=20).toPandas().sort_values("k").reset_index(drop=True)
           for n in (10_000, 100)]
    pd.testing.assert_frame_equal(*got)
    assert len(got[0]) == 24 and got[0].loc[got[0]["k"] == "empty", "q"].isna().all()
    want = np.quantile([v for k, v in rows if k == "big" and v == v], 0.3)
    assert got[0].loc[got[0]["k"] == "big", "q"].iloc[0] == pytest.approx(want)


def test_missing_values_count_alike_at_any_size(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1000, 500).astype(float)
    values[rng.random(500) < 0.3] = np.nan
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    small = exact_quantiles(df, {"m": (F.col("v"), 0.5)})["m"]
    large = exact_quantiles(df, {"m": (F.col("v"), 0.5)}, direct_cells=10, inside=20)["m"]
    assert small == large == np.nanmedian(values)
    assert imputation_medians(df, ["v"])["v"] == np.nanmedian(values)


def test_bucket_without_values_keeps_its_rows(spark):
    rows = [(i, datetime(2024, 1, 1), None) for i in range(60)] + [(100 + i, datetime(2024, 1, 2), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "source_row_id long, ts timestamp, snr_db double")
    for n in (1_000_000, 20):
        assert peer_deviations(df, 1.0, ["snr_db"], rows_per_task=n).count() == 65


def test_all_failing_batches_are_named(spark):
    events = spark.createDataFrame([(f"e{i}", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "edge") for i in range(300)], "event_id string, log_timestamp string, source_type string")
    log = seal(events, rows=10)
    broken = merkle_batches(log, 10).withColumn("merkle_root", F.lit("x"))
    assert len(verify(log, broken, 10).first()["failed_batch_ids"]) == 30
    assert failed_batches(broken, 10).count() == 30


def test_last_safe_state_per_label(spark):
    labels = ["JAMMING", "DOS", "SUSPICIOUS", "DDOS", "HYBRID_ATTACK", "NORMAL", "JAMMING"]
    rows = [("n", i, datetime(2024, 1, 1) + timedelta(seconds=i), lab, float(i)) for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, "node_id string, source_row_id long, ts timestamp, final_label string, snr_db double")
    got = {r.source_row_id: r.safe for r in response.last_safe_state(df).collect()}
    assert got[0] is None and [got[i]["snr_db"] for i in range(1, 7)] == [1.0, 1.0, 3.0, 3.0, 5.0, 5.0]
    assert got[1]["channel"] == "PRIMARY" and got[1]["rssi_dbm"] == -70.0


def test_stage_tables_need_a_shared_folder_off_local(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(Session(), "stage")


def test_discard_removes_a_stage_table(spark):
    kept = session.durable(spark.range(5))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    session.discard(kept)
    import os
    assert not os.path.exists(folder)


def test_rank_selection_computes_its_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return float(x)

    df = spark.range(5_000).select(F.udf(counted, "double")("id").alias("v"))
    assert exact_quantiles(df, {"q": (F.col("v"), 0.99)}, direct_cells=0, inside=100, rows=5_000)["q"] == pytest.approx(4949.01)
    assert seen.value == 5_000


def test_partners_need_no_sequences(spark):
    rows = spark.range(500).selectExpr("id as source_row_id", "if(id % 3 = 0, 'normal', 'dos') as label", "array(array(cast(id as double))) as sequence")
    pairs = {tuple(r) for r in sampling.partners(rows.drop("sequence"), rows_per_partition=50).collect()}
    assert len(pairs) == 500 and len({p for *_, p in pairs}) == 500
    blended = sampling.interpolate(rows, rows_per_partition=50)
    assert {tuple(r) for r in blended.select("source_row_id", "label", "partner_id").collect()} == pairs
    wrong = F.abs(F.col("sequence")[0][0] - F.col("alpha") * F.col("source_row_id") - (1 - F.col("alpha")) * F.col("partner_id")) > 1e-9
    assert blended.where(wrong).count() == 0


def test_response_rows_get_their_trust_without_a_join(spark):
    labels = ["NORMAL", "DOS", "JAMMING", "SUSPICIOUS"]
    rows = [(i, f"n{i % 3}", i, labels[i % 4], "HIGH" if i % 5 else "LOW") for i in range(200)]
    df = spark.createDataFrame(rows, "source_row_id long, node_id string, ts long, final_label string, severity string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = response.respond(df)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    small = response.respond(df, rows_per_task=10)   # nodes in chunks
    columns = ["source_row_id", "signal_trust_before", "signal_trust_after", "network_trust_after", "rf_action_taken", "node_type"]
    rounded = [F.round(c, 9).alias(c) if "trust" in c else F.col(c) for c in columns]
    assert sorted(out.select(*rounded).collect()) == sorted(small.select(*rounded).collect())
