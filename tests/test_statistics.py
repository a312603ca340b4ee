import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerovigil.operators.density import density_outliers
from aerovigil.operators.quantiles import exact_cuts, exact_quantiles, grouped_quantiles, normal_quantiles
from aerovigil.operators.selection import mutual_information, select_features


@pytest.mark.parametrize("values", ["continuous", "ties", "heavy"])
def test_rank_selection_is_exact(spark, values):
    rng = np.random.default_rng(3)
    v = {"continuous": rng.lognormal(0, 3, 20_000), "ties": rng.integers(0, 50, 20_000).astype(float),
         "heavy": np.where(rng.random(20_000) < 0.95, 7.0, rng.normal(7, 1, 20_000))}[values]
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    qs = {f"q{i}": (F.col("v"), q) for i, q in enumerate((0.0, 0.05, 0.5, 0.951, 0.99, 1.0))}
    got = exact_quantiles(df, qs, direct_cells=0, inside=200)
    for name, (_, q) in qs.items():
        assert got[name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12)


def test_grouped_quantiles_with_one_huge_group(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": ["big"] * 5000 + ["s1"] * 7 + ["s2"] * 4, "v": rng.normal(size=5011)})
    df = spark.createDataFrame(pdf)
    got = grouped_quantiles(df, ["g"], {"m": ("v", 0.5), "u": ("v", 0.95)}, rows_per_task=100, inside=50).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.at[g, "m"] == pytest.approx(part["v"].quantile(0.5), abs=1e-12)
        assert got.at[g, "u"] == pytest.approx(part["v"].quantile(0.95), abs=1e-12)


def test_normal_quantiles_fall_back_to_all_rows(spark):
    pdf = pd.DataFrame({"x": range(30), "label": ["normal"] * 10 + ["dos"] * 20})
    df = spark.createDataFrame(pdf)
    assert normal_quantiles(df, {"x": ("x", 0.5), "gone": ("nope", 0.5)}) == {"x": 14.5, "gone": 0.0}
    eleven = spark.createDataFrame(pd.DataFrame({"x": range(30), "label": ["normal"] * 11 + ["dos"] * 19}))
    assert normal_quantiles(eleven, {"x": ("x", 0.5)})["x"] == 5.0


@pytest.mark.parametrize("small_bucket", [1_000, 0])
@pytest.mark.parametrize("scale", [0.15, 1.0, 5.0])
def test_density_noise_against_brute_force(spark, scale, small_bucket):
    """From one crowded blob to scattered points, with many exact copies."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, scale, (180, 3)), np.zeros((60, 3)), rng.uniform(-3, 3, (40, 3))])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["source_row_id"], pdf["node_id"] = np.arange(len(pdf)), [f"n{i % 5}" for i in range(len(pdf))]
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(pdf)) % 3, unit="s")
    got = density_outliers(spark.createDataFrame(pdf), metrics=["a", "b", "c"], small_bucket=small_bucket).toPandas().set_index("source_row_id")
    for _, g in pdf.groupby("ts"):
        p = g[["a", "b", "c"]].to_numpy()
        near = ((p[:, None] - p[None]) ** 2).sum(-1) <= 0.04
        core = near.sum(1) >= 3
        noise = ~core & ~(near & core[None]).any(1)
        assert got.loc[g["source_row_id"], "traffic_outlier"].tolist() == noise.astype(int).tolist()


def test_dense_cell_beside_sparse_points_writes_no_pairs_with_it(spark, monkeypatch):
    """A crowded cell is seen through boxes: what is written stays in proportion to the points."""
    from aerovigil.operators import density
    written = []
    keep = density.durable
    monkeypatch.setattr(density, "durable", lambda df: written.append(keep(df)) or written[-1])
    rng = np.random.default_rng(8)
    crowd = rng.uniform(0.0, 0.1, (20_000, 2))
    lone = np.array([[0.25, 0.05], [0.29, 0.05], [0.05, 0.29], [5.0, 5.0]])
    pdf = pd.DataFrame(np.concatenate([crowd, lone]), columns=["a", "b"])
    pdf["source_row_id"], pdf["node_id"], pdf["ts"] = np.arange(len(pdf)), [f"n{i % 9}" for i in range(len(pdf))], pd.Timestamp("2024-01-01")
    got = density_outliers(spark.createDataFrame(pdf), metrics=["a", "b"], small_bucket=0).toPandas().set_index("source_row_id")["dbscan_label"]
    assert got.loc[20_000:].tolist() == [0, 0, 0, -1] and (got.loc[:19_999] == 0).all()
    assert max(w.count() for w in written) <= len(pdf)


def test_density_leaves_small_buckets_alone(spark):
    pdf = pd.DataFrame({"source_row_id": [1, 2], "node_id": ["a", "b"], "a": [0.0, 9.0],
                        "ts": [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-01 00:00:09")]})
    more = pd.concat([pdf, pd.DataFrame({"source_row_id": range(10, 14), "node_id": list("cdef"), "a": [0.0] * 4,
                                         "ts": [pd.Timestamp("2024-01-01 00:00:20")] * 4})])
    got = density_outliers(spark.createDataFrame(more), metrics=["a"]).toPandas().set_index("source_row_id")["dbscan_label"]
    assert got[1] == got[2] == -2 and got[10] == 0


def test_information_ranks_an_informative_feature_first(spark):
    rng = np.random.default_rng(6)
    label = rng.choice(["normal", "jamming"], 4000)
    pdf = pd.DataFrame({"label": label, "good": (label == "jamming") * 2.0 + rng.normal(0, 0.1, 4000),
                        "noise": rng.normal(size=4000), "flat": 1.0})
    df = spark.createDataFrame(pdf)
    mi = {r["feature"]: r["mi"] for r in mutual_information(df, ["good", "noise"]).collect()}
    assert mi["good"] == pytest.approx(np.log(2), abs=0.05) and mi["noise"] < 0.02
    assert select_features(df, ["flat", "noise", "good"], min_mi=0.1) == ["good"]


def test_distinct_sketches_merge_like_one_sketch(spark):
    """Merged windows know the distinct items of their union, also where windows share items."""
    from pyspark.sql import functions as F

    from aerovigil.operators import sketches as SK
    df = spark.range(20_000).select(F.timestamp_seconds(F.col("id") % 600).alias("ts"), F.concat(F.lit("n"), F.col("id") % 7_000).alias("node_id"))
    windows = SK.distinct_sketches(df, "node_id", 60.0)
    assert windows.count() == 10
    for merged, n in ((SK.roll_up(windows), 1), (SK.roll_up(windows, 300.0), 2)):
        rows = merged.select(F.hll_sketch_estimate("sketch").alias("n"), "rows").collect()
        assert len(rows) == n and sum(r.rows for r in rows) == 20_000
    assert abs(SK.roll_up(windows).select(F.hll_sketch_estimate("sketch")).first()[0] - 7_000) <= SK.distinct_bound() * 7_000


def test_window_filters_merge_to_the_whole(spark):
    from pyspark.sql import functions as F

    from aerovigil.operators import membership as B
    from aerovigil.operators import sketches as SK
    df = spark.range(500).select(F.timestamp_seconds(F.col("id") % 90).alias("ts"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("n"), F.col("id"))).alias("node_id"))
    told, blocks = SK.source_filters(df, 30.0)
    assert sorted(tuple(r) for r in told.select("window_start", "items_added").collect()) == [(0, 180), (30_000_000, 170), (60_000_000, 150)]
    whole = B.build(df.fillna("", ["node_id"]), "node_id", SK.SOURCE_FILTER)
    assert sorted(map(tuple, B.merge(blocks).collect())) == sorted(map(tuple, whole.collect()))
    present = B.probe(df, "node_id", B.merge(blocks), SK.SOURCE_FILTER)
    assert present.count() == 490 and present.where("not maybe_present").isEmpty()


def test_rank_states_merge_and_are_proven_by_counts(spark):
    """Parts of very different size merge to limits within the bound; missing values and empty metrics count for nothing."""
    from aerovigil.operators import thresholds as TH
    rng = np.random.default_rng(9)
    v = rng.lognormal(0, 2, 60_000)
    pdf = pd.DataFrame({"day": np.where(np.arange(60_000) < 40_000, 1, np.where(np.arange(60_000) < 59_990, 2, 3)), "v": v, "none": np.nan})
    pdf.loc[::100, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    days = TH.rank_states(df, ["v", "none"], ["day"])
    assert {(r.day, r.metric): r.rows for r in days.collect()} == {
        (d, m): int(pdf.loc[pdf.day == d, m].notna().sum()) for d in (1, 2, 3) for m in ("v", "none")}
    one, two = TH.merge_states([days.where("day = 1")]), TH.merge_states([days.where("day > 1")])
    for states in (TH.merge_states([days]), TH.merge_states([one, two]), TH.rank_states(df, ["v", "none"])):
        for q in (0.01, 0.5, 0.99):
            got = {r["metric"]: r for r in TH.proven(df, TH.limits(states, q), ["v", "none"], q).collect()}
            assert got["none"]["limit"] is None and got["none"]["rows"] == 0 and got["none"]["rank_error"] is None
            assert got["v"]["rows"] == pdf["v"].notna().sum() and 0 <= got["v"]["rank_error"] <= TH.rank_bound()
            assert got["v"]["below"] == (pdf["v"] < got["v"]["limit"]).sum() and got["v"]["up_to"] == (pdf["v"] <= got["v"]["limit"]).sum()
    by_day = {r["day"]: r["limit"] for r in TH.limits(days, 0.5).where("metric = 'v'").collect()}
    assert by_day[3] in set(pdf.loc[pdf.day == 3, "v"])
    row = TH.merge_states([days]).where("metric = 'v'").first()
    assert (row["low"], row["high"]) == (pdf["v"].min(), pdf["v"].max())
    assert TH.rank_states(df.limit(0), ["v"]).first()["rows"] == 0 and TH.limits(TH.rank_states(df.limit(0), ["v"]), 0.5).first()["limit"] is None


def test_a_wrong_limit_is_not_proven(spark):
    from aerovigil.operators import thresholds as TH
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    wrong = TH.limits(TH.rank_states(df, ["v"]), 0.5).withColumn("limit", F.lit(700.0))
    assert TH.proven(df, wrong, ["v"], 0.5).first()["rank_error"] == pytest.approx(0.2)


@pytest.mark.parametrize("inside", [5, 400])
def test_cuts_are_the_values_at_their_ranks_at_any_size(spark, inside):
    """Direct and searched cuts agree with sorting: ties, one hot value, missing values, few values, none."""
    rng = np.random.default_rng(12)
    n = 20_000
    pdf = pd.DataFrame({"smooth": rng.lognormal(0, 3, n), "ties": rng.integers(0, 40, n).astype(float), "flat": 2.0,
                        "hot": np.where(rng.random(n) < 0.9, 7.0, rng.normal(7, 1, n)), "none": np.nan,
                        "some": np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n))})
    df = spark.createDataFrame(pdf)
    expected = {}
    for c in pdf:
        v = np.sort(pdf[c].dropna().to_numpy())
        expected[c] = sorted({float(v[-(-i * len(v) // 32) - 1]) for i in range(1, 32)}) if len(v) else []
    assert exact_cuts(df, list(pdf), 32) == expected
    assert exact_cuts(df, list(pdf), 32, direct_rows=0, inside=inside) == expected


def test_information_does_not_change_with_the_way_edges_are_found(spark):
    rng = np.random.default_rng(13)
    label = rng.choice(["normal", "dos"], 3000)
    df = spark.createDataFrame(pd.DataFrame({"label": label, "a": (label == "dos") + rng.normal(0, 1, 3000), "b": rng.normal(size=3000)}))
    one = {r["feature"]: r["mi"] for r in mutual_information(df, ["a", "b"]).collect()}
    two = {r["feature"]: r["mi"] for r in mutual_information(df, ["a", "b"], direct_rows=10, inside=20).collect()}
    assert one == pytest.approx(two, abs=1e-12)


def test_cells_of_information_are_counted_in_one_pass(spark):
    # Before, each of four joined counts read all rows again, and every value was compared with every edge.
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 3000).round(2), "b": rng.integers(0, 6, 3000).astype(float), "label": rng.choice(["normal", "dos", "odd"], 3000)})
    pdf.loc[::50, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    mi = mutual_information(df, ["a", "b"], direct_rows=10, inside=20)
    assert mi._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["feature"]: r["mi"] for r in mi.collect()}
    code = pdf["label"].map({"normal": 0, "dos": 2}).fillna(0)
    for c, cuts in exact_cuts(df, ["a", "b"], 32).items():
        place = np.where(pdf[c].isna(), 0, np.searchsorted(cuts, pdf[c].fillna(0)))
        joint = pd.crosstab(place, code).to_numpy() / len(pdf)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.nansum(joint * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0))))
        assert abs(got[c] - want) < 1e-9
