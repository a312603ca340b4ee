"""The chunked path for oversized keys must agree with the plain path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerovigil.operators import series as R
from aerovigil.operators.coordination import recent_nodes
from aerovigil.operators.ordered import add_positions, order_rows
from aerovigil.operators.temporal import radio_features
from aerovigil.operators.trust import clamped_trust
from aerovigil.constants import JAM_METRICS


@pytest.fixture(scope="module")
def rows(spark):
    """One node with 600 of 700 rows, one with 97, three tiny ones; many equal timestamps."""
    rng = np.random.default_rng(7)
    nodes = ["hot"] * 600 + ["warm"] * 97 + ["a", "b", "c"]
    pdf = pd.DataFrame({"node_id": nodes, "source_row_id": rng.permutation(len(nodes)).astype("int64")})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200, len(pdf)), unit="s")
    for m in JAM_METRICS:
        pdf[m] = rng.normal(50, 20, len(pdf)).round(2)
    pdf["label"] = rng.choice(["normal", "jamming"], len(pdf))
    return spark.createDataFrame(pdf).repartition(4)


def collect(df, *names):
    return df.orderBy("source_row_id").select("source_row_id", *names).toPandas()


def test_positions_match_a_global_sort(rows):
    got = add_positions(rows, ["ts", "node_id", "source_row_id"], rows_per_partition=60).toPandas()
    want = got.sort_values(["ts", "node_id", "source_row_id"])["_pos"].tolist()
    assert want == list(range(1, len(got) + 1))


def test_radio_features_do_not_depend_on_chunking(rows):
    limits = {m: 40.0 for m in JAM_METRICS}
    plain, chunked = radio_features(rows, limits), radio_features(rows, limits, rows_per_task=150)
    names = [c for c in plain.columns if c not in ("ts", "node_id", "label", "source_row_id")]
    a, b = collect(plain, *names), collect(chunked, *names)
    assert len(a) == len(b) == 700
    for c in names:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-8, atol=1e-6, err_msg=c)


@pytest.mark.parametrize("limit", [1_000_000, 140])
def test_ewma_and_cusum_against_a_loop(rows, limit):
    s = order_rows(rows, ["ts", "source_row_id"], ["node_id"], halo=R.HALO_ROWS, rows_per_task=limit)
    out = R.ewma(s, s.rows, ["snr_db"])
    out = s.finish(R.cusum(s, R.warmup_statistics(s, out, ["snr_db", "mac_retry_count"]), {"snr_db": "down", "mac_retry_count": "up"}))
    got = out.toPandas().sort_values(["node_id", "ts", "source_row_id"])
    for _, g in got.groupby("node_id"):
        x, y = g["snr_db"].to_numpy(), g["mac_retry_count"].to_numpy()
        np.testing.assert_allclose(g["snr_db_ewma"], pd.Series(x).ewm(alpha=0.3, adjust=False).mean(), rtol=1e-9)
        calm = min(10, max(3, len(g) // 5))
        down = up = 0.0
        mx, sx, my, sy = x[:calm].mean(), x[:calm].std() + 1e-6, y[:calm].mean(), y[:calm].std() + 1e-6
        for i in range(len(g)):
            down, up = min(0.0, down + x[i] - mx + 0.5 * sx), max(0.0, up + y[i] - my - 0.5 * sy)
            assert g["snr_db_cusum"].iloc[i] == pytest.approx(-down, abs=1e-6)
            assert g["mac_retry_count_cusum"].iloc[i] == pytest.approx(up, abs=1e-6)
            assert g["mac_retry_count_cusum_flag"].iloc[i] == int(up > 5 * sy)


@pytest.mark.parametrize("limit", [1_000_000, 130])
def test_clamped_trust_against_a_loop(rows, limit):
    first = F.when(F.col("rssi_dbm") > 60, -0.3).otherwise(0.0)
    second = F.when(F.col("snr_db") > 50, 0.2).otherwise(-0.15)
    got = clamped_trust(rows, {"t": (first, second)}, rows_per_task=limit).toPandas().set_index("source_row_id")
    for _, g in rows.toPandas().sort_values(["ts", "source_row_id"]).groupby("node_id"):
        x = 1.0
        for r in g.itertuples():
            assert got.at[r.source_row_id, "t_before"] == pytest.approx(x, abs=1e-9)
            x = min(1.0, max(0.0, x + (-0.3 if r.rssi_dbm > 60 else 0.0)))
            x = min(1.0, max(0.0, x + (0.2 if r.snr_db > 50 else -0.15)))
            assert got.at[r.source_row_id, "t_after"] == pytest.approx(x, abs=1e-9)


def test_recent_nodes_across_chunks(rows):
    df = rows.withColumn("final_label", F.when(F.col("snr_db") > 50, "JAMMING").otherwise("NORMAL")).withColumn("fusion_confidence", F.lit(0.7))
    one, many = recent_nodes(df), recent_nodes(df, rows_per_task=40)
    names = ["coordinated_node_count", "multi_node_factor"]
    pd.testing.assert_frame_equal(collect(one, *names), collect(many, *names))


def test_run_length_and_last_state_with_chunks(rows):
    out = []
    for limit in (1_000_000, 45):
        s = order_rows(rows, ["ts", "source_row_id"], ["node_id"], rows_per_task=limit)
        d = R.run_length(s, s.rows, F.col("label") == "jamming", "run")
        d = s.finish(R.last_where(s, d, F.col("label") == "normal", ["snr_db"], "safe"))
        out.append(collect(d.withColumn("safe", F.col("safe.snr_db")), "run", "safe"))
    pd.testing.assert_frame_equal(*out)


def test_a_rise_equal_to_its_limit_is_no_drift(spark):
    # 4.9 - 1.9 is 3.0000000000000004 in doubles; the limit of a calm node is 3.
    values = [1.9] * 50 + [4.9] * 10
    df = spark.createDataFrame([(i, "a", i, v) for i, v in enumerate(values)], "source_row_id long, node_id string, ts long, noise_floor_dbm double")
    s = order_rows(df, ["ts", "source_row_id"], ["node_id"], halo=31)
    out = R.noise_drift(s, R.warmup_statistics(s, s.rows, ["noise_floor_dbm"]))
    assert out.where("noise_floor_drift_flag = 1").count() == 0
