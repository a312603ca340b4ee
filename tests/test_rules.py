import itertools
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerovigil import constants as K
from aerovigil.functions import scalars as S
from aerovigil.operators import coordination as C
from aerovigil.operators import crosslayer as X
from aerovigil.operators import fusion as FU
from aerovigil.operators import ledger as L
from aerovigil.operators import management as M
from aerovigil.operators import membership as B
from aerovigil.operators import quality as Q
from aerovigil.operators import response as R


@pytest.mark.parametrize("raw, want", [
    (" Normal ", "normal"), ("", "normal"), ("GPS Jamming", "jamming"), ("UDP-Flood", "dos"), ("ddos flooding", "ddos"),
    ("Evil Twin", "suspicious"), ("never seen", "suspicious"), ("GPS-Spoofing", "jamming")])
def test_labels(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(S.normalise_label(F.col("x"))).first()[0] == want


def test_numbers_and_ratios(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("-Infinity",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(S.to_number(F.col("x"))).collect()] == [1.5, 0, 0, 0, 0, 0]
    assert [r[0] for r in df.select(S.to_number(F.col("x"), None)).collect()] == [1.5] + [None] * 5
    one = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert one.select(S.guarded_ratio(F.col("a"), F.col("b"), 0.0, 100.0)).first()[0] == 100.0


@pytest.mark.parametrize("value", [0.0, 1.0, 12.5, -150.25, 1.5, 0.00012345, 0.000012345, 9999.6, 12345.0, 104900000.0, 2500.0])
def test_four_digits_is_the_g_format(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(Q.four_digits(F.col("v"))).first()[0]
    assert got == f"{value:.4g}"


def test_scenario_tags(spark):
    rows = [(1, 0.5, 0, 0, 1.0, "HYBRID_ATTACK"), (1, 0.2, 3, 0, 1.0, "JAMMING"), (0, 0.0, 3, 1, 1.0, "SUSPICIOUS"),
            (0, 0.0, 0, 3, 50.0, "DDOS"), (0, 0.0, 0, 3, 49.0, "DOS"), (0, 0.0, 1, 0, 1.0, "SUSPICIOUS"), (0, 0.9, 0, 0, 1.0, "NORMAL")]
    df = spark.createDataFrame(rows, "cross_layer_attack_flag int, cross_layer_anomaly_score double, jam_threshold_score int, "
                                     "dos_threshold_score int, unique_source_count double, want string")
    assert all(r["scenario_tag"] == r["want"] for r in X.scenario_tags(df, {"high": 1.0, "medium": 0.5}).collect())


def test_final_label_with_and_without_hybrid_truth(spark):
    base = {"cross": 0.5, "swarm": 0, "jam": 0, "dos": 0, "sources": 10, "entropy": 3, "sources_vary": True, "entropy_varies": True}
    rows = [(0.7, 0.4, 0.9, 0.9, 1.0, "HYBRID_ATTACK", "JAMMING"), (0.4, 0.7, 0.9, 0.9, 20.0, "HYBRID_ATTACK", "DDOS"),
            (0.4, 0.7, 0.9, 0.9, 1.0, "HYBRID_ATTACK", "DOS"), (0.6, 0.0, 0.0, 0.6, 1.0, "JAMMING", "JAMMING"),
            (0.3, 0.3, 0.0, 0.3, 20.0, "DDOS", "DDOS"), (0.39, 0.0, 0.0, 0.39, 1.0, "SUSPICIOUS", "SUSPICIOUS"),
            (0.0, 0.0, 0.0, 0.09, 1.0, "NORMAL", "NORMAL")]
    df = spark.createDataFrame([(*r, 0.9, 0.0, 0.0, 0.0) for r in rows],
                               "_jam double, _dos double, _hybrid double, _fusion double, unique_source_count double, w1 string, w2 string, "
                               "cross_layer_anomaly_score double, cross_layer_attack_flag double, src_ip_entropy double, traffic_outlier double")
    for truth, want in ((True, "w1"), (False, "w2")):
        got = df.withColumn("got", FU.final_label({**base, "truth_has_hybrid": truth})).collect()
        assert [r["got"] for r in got] == [r[want] for r in got]


def _detection(spark, rows):
    pdf = pd.DataFrame(rows)
    for i, c in enumerate(pdf.columns):
        assert c
    pdf["source_row_id"] = range(len(pdf))
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(pdf)), unit="s")
    return spark.createDataFrame(pdf)


def test_response_to_the_jamming_fixture(spark):
    """One strong jamming window: radio below noise, busy channel."""
    row = {"node_id": "uav_1", "final_label": "JAMMING", "severity": "MEDIUM", "rssi_dbm": -108.0, "snr_db": -5.0,
           "channel_occupancy_pct": 88.0, "packets_per_second": 45.0, "fusion_confidence": 0.7, "edge_alarm": 1}
    r = R.respond(_detection(spark, [row])).first()
    assert r["reactive_actions"] == ["EMERGENCY_CHANNEL_SWITCH", "TRIGGER_FREQUENCY_HOP"]
    assert (r["rf_action_taken"], r["rf_channel_mode"]) == ("SWITCH_TO_BACKUP_CHANNEL", "CHANNEL_SWITCH_MONITOR")
    assert r["signal_trust_after"] == pytest.approx(1 - 0.30 - 0.25) and not r["safety_override"] and not r["notify_gcc"]
    assert r["network_trust_after"] == 1.0 and r["net_action_taken"] == "NO_NETWORK_CHANGE"


@pytest.mark.parametrize("label, severity, run, constraint, forced", [
    ("DOS", "HIGH", 0, "CRITICAL_TRAFFIC_PROTECTION", "SHED_NON_CRITICAL_LOAD"), ("HYBRID_ATTACK", "HIGH", 0, "CRITICAL_TRAFFIC_PROTECTION", "SHED_NON_CRITICAL_LOAD"),
    ("JAMMING", "HIGH", 10, "ANTI_FRAGMENTATION", "SWITCH_TO_LTE_FALLBACK"), ("JAMMING", "HIGH", 9, "NONE", "NONE"),
    ("DDOS", "MEDIUM", 0, "RATE_LIMIT_ENFORCEMENT", "FLAG_AND_RATE_LIMIT"), ("HYBRID_ATTACK", "MEDIUM", 0, "NONE", "NONE"), ("NORMAL", "LOW", 0, "NONE", "NONE")])
def test_safety_rules(spark, label, severity, run, constraint, forced):
    df = spark.createDataFrame([(label, severity, run)], "final_label string, severity string, consecutive_attack_count int")
    c, f = R.safety_rules()
    assert tuple(df.select(c, f).first()) == (constraint, forced)


def test_coordination_actions(spark):
    rows = [("DDOS", 0.9, True, 0.1, "GLOBAL_CONTAINMENT_AND_REROUTE"), ("JAMMING", 0.9, False, 0.65, "ACTIVATE_SWARM_WIDE_CHANNEL_HOP"),
            ("DDOS", 0.9, False, 0.7, "SWARM_WIDE_RATE_LIMIT_AND_ISOLATE"), ("DOS", 0.9, False, 0.7, "GLOBAL_CONTAINMENT_AND_REROUTE"),
            ("NORMAL", 0.34, True, 0.1, "ISOLATE_NODE_AND_BROADCAST"), ("DOS", 0.9, True, 0.1, "RESTRICT_SWARM_AND_NOTIFY_GCC"),
            ("DOS", 0.9, False, 0.1, "RESTRICT_ROLE_AND_NOTIFY_NEIGHBORS"), ("NORMAL", 0.5, True, 0.9, "MONITOR_AND_LIMIT_ROUTING"),
            ("SUSPICIOUS", 0.7, True, 0.9, "NO_GLOBAL_CHANGE")]
    df = spark.createDataFrame(rows, "final_label string, trust_after double, coordinated_attack_detected boolean, bayes_p_coordinated double, want string")
    got = df.withColumn("got", C.swarm_action()).withColumn("status", C.node_status()).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert [r["status"] for r in got] == ["RESTRICTED"] * 4 + ["ISOLATED"] + ["RESTRICTED"] * 3 + ["MONITORED"]


def test_games_are_solved_to_equilibrium(spark):
    """At the solution no pure strategy of either side does better than the value."""
    rng = np.random.default_rng(8)
    games = np.concatenate([rng.uniform(-2, 2, (200, 3, 4)), np.round(rng.uniform(-2, 2, (100, 3, 4))), np.zeros((1, 3, 4))])
    names = [f"u_{i}_{j}" for i, j in itertools.product(range(3), range(4))]
    pdf = pd.DataFrame(games.reshape(-1, 12), columns=names)
    pdf["batch"] = range(len(pdf))
    got = M.solve_games(spark.createDataFrame(pdf)).toPandas().sort_values("batch")
    q, p, v = got[M.DEFENDERS].to_numpy(), got[M.ATTACKERS].to_numpy(), got["game_value"].to_numpy()
    np.testing.assert_allclose(q.sum(1), 1, atol=1e-9)
    np.testing.assert_allclose(p.sum(1), 1, atol=1e-9)
    assert (np.einsum("nrc,nc->nr", games, q).min(1) >= v - 1e-8).all()
    assert (np.einsum("nrc,nr->nc", games, p).max(1) <= v + 1e-8).all()


@pytest.mark.parametrize("leaves", [1, 2, 3, 7, 10])
def test_merkle_root(spark, leaves):
    import hashlib
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(leaves)]
    df = spark.createDataFrame([(level,)], "h array<string>")
    got = df.select(L.merkle_root(F.col("h"), 10)).first()[0]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    assert got == level[0]


def test_one_changed_field_is_found(spark):
    log = spark.createDataFrame([(f"e{i}", i, float(i), "uav_ugv", 1, datetime(2024, 1, 1)) for i in range(25)],
                                "event_id string, n int, x double, source_type string, _rank int, log_timestamp timestamp")
    sealed = L.seal(log, rows_per_partition=10)
    batches = L.merkle_batches(sealed)
    assert batches.count() == 3
    assert L.verify(sealed, batches).first()["status"] == "INTEGRITY_VERIFIED"
    bad = L.verify(sealed.withColumn("n", F.when(F.col("event_id") == "e7", 99).otherwise(F.col("n"))), batches).first()
    assert (bad["log_records_failed"], bad["failed_event_ids"]) == (1, ["e7"])
    forged = L.verify(sealed, batches.withColumn("merkle_root", F.when(F.col("batch_id") == 2, "0").otherwise(F.col("merkle_root")))).first()
    assert (forged["merkle_batches_failed"], forged["failed_batch_ids"]) == (1, [2])


def test_bloom_filter_has_no_false_negatives(spark):
    import hashlib
    shape = B.BloomShape.for_capacity(1000, 0.01)
    assert (shape.bits, shape.hashes) == (9585, 7)
    df = spark.range(300).select(F.concat(F.lit("ip"), "id").alias("ip"))
    blocks = B.build(df, "ip", shape)
    assert B.probe(df, "ip", blocks, shape).where(~F.col("maybe_present")).count() == 0
    others = spark.range(1000, 4000).select(F.concat(F.lit("ip"), "id").alias("ip"))
    assert B.probe(others, "ip", blocks, shape).where("maybe_present").count() < 60
    h1, h2 = int(hashlib.md5(b"ip7").hexdigest(), 16), int(hashlib.sha1(b"ip7").hexdigest(), 16)
    got = spark.createDataFrame([("ip7",)], "x string").select(B.bit_positions(F.col("x"), shape)).first()[0]
    assert got == [(h1 % shape.bits + i * (h2 % shape.bits)) % shape.bits for i in range(shape.hashes)]


def test_bloom_queries_grow_with_their_items(spark, monkeypatch):
    from aerovigil.plans import swarm_queries
    from aerovigil.plans.registry import QUERIES
    dos = F.col("id") < 6000
    t = spark.range(9000).select(F.concat(F.lit("uav_"), "id").alias("node_id"), F.when(dos, "dos").otherwise("normal").alias("label"),
                                 F.when(dos, 70).otherwise(1).alias("unique_source_count"))
    monkeypatch.setattr(swarm_queries, "telemetry", lambda spark, sf, *columns: t.select(*columns))
    got = {r["item"]: r["maybe_present"] for r in QUERIES["e8_bloom_probe"](spark, "").collect()}
    assert all(got[f"uav_{i}"] for i in range(6000)) and sum(got[f"uav_{i}"] for i in range(6000, 9000)) < 90
    assert QUERIES["c27_bloom_summary"](spark, "").first()["estimated_fpr"] < 0.011


def test_desired_actions_are_known():
    assert all(set(a) <= set(K.ACTIONS) for a in K.DESIRED_ACTIONS.values())


def test_management_dashboard_counts_every_batch_once_per_dimension(spark):
    from aerovigil.operators import management as M
    rng = np.random.default_rng(2)
    names = ("dominant_strategy", "channel_directive", "network_directive", "energy_directive")
    pdf = pd.DataFrame({n: rng.choice(["x", "y", "z"], 200, p=[0.8, 0.15, 0.05]) for n in names} | {"game_value": rng.normal(0, 1, 200)})
    pdf.loc[7, "energy_directive"] = None
    got = M.management_dashboard(spark.createDataFrame(pdf)).toPandas()
    for n in names:
        part = got[got.dimension == n]
        assert part.batches.sum() == 200 and part.share.sum() == pytest.approx(1)
        for _, row in part.iterrows():
            mine = pdf[pdf[n].isna()] if row["item"] is None else pdf[pdf[n] == row["item"]]
            assert (row["batches"], row["least_value"], row["largest_value"]) == (len(mine), mine.game_value.min(), mine.game_value.max())
    assert M.management_dashboard(spark.createDataFrame(pdf).limit(0)).isEmpty()


def test_check_and_clean_in_one_exchange(spark, sf, tmp_path):
    """The same rows and values as check and clean one after the other, with copies that are first, poor, or both."""
    from aerovigil.sources.fixtures import telemetry
    t = telemetry(spark, sf, raw=True).selectExpr("* except (ts, node_id)", "date_trunc('quarter', ts) as ts",
                                                  "if(source_row_id % 31 = 0, null, concat('n', source_row_id % 20)) as node_id")
    t = t.withColumn("rssi_dbm", F.when(F.col("source_row_id") % 3 == 0, None).otherwise(F.col("rssi_dbm"))).withColumn(
        "snr_db", F.when(F.col("source_row_id") % 4 == 0, 500.0).otherwise(F.col("snr_db")))
    t.write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    two, one = Q.clean(Q.check_quality(t)), Q.check_and_clean(t)
    assert set(one.columns) == set(two.columns)
    names = ["source_row_id", "quality_issue_score", "spike_fields", "out_of_range_fields", *K.ALL_METRICS]
    want = sorted(map(str, two.select(*names).collect()))
    assert sorted(map(str, one.select(*names).collect())) == want
    first = {r[0] for r in Q.first_rows(t).collect()}
    assert {r["source_row_id"] for r in two.select("source_row_id").collect()} - first  # a later copy stays where the first is poor
