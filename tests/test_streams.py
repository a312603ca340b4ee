import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from aerovigil.functions.hashing import record_hash
from aerovigil.operators import ledger, series
from aerovigil.operators.ordered import add_positions
from aerovigil.plans import load_all
from aerovigil.plans.registry import ORACLES, QUERIES
from aerovigil.streaming import detectors as D
from aerovigil.streaming import trust as T
from aerovigil.streaming.eventtime import CLOSING, PROVIDER, ROCKSDB, OrderedFold, run_to_end
from aerovigil.streaming.runs import merkle_log_writer, run_available, run_counted
from aerovigil.streaming.windows import first_per_key, with_event_time


def test_detector_state_follows_the_definition():
    """EWMA and CUSUM of one metric written out again; the CUSUM restarts after an alarm."""
    rng = np.random.default_rng(9)
    xs = np.concatenate([rng.normal(30, 1, 40), rng.normal(10, 1, 20)])
    state, e, e2, s = D.fresh(), None, None, 0.0
    calm = xs[:10]
    mu, width = calm.mean(), calm.std() + 1e-6
    for i, x in enumerate(xs):
        got = D.advance(state, {"snr_db": float(x), "rssi_dbm": float(x) - 70})
        e, e2 = (x, x * x) if e is None else (0.3 * x + 0.7 * e, 0.3 * x * x + 0.7 * e2)
        alarm = i >= 9 and abs(x - e) / (math.sqrt(max(0.0, e2 - e * e)) + 1e-9) > 3
        s = min(0.0, s + x - mu + 0.5 * width) if i >= 10 else 0.0
        fired = -s > 5 * width
        s = 0.0 if fired else s
        assert got["cusum_alarm"] == int(fired)
        assert (got["ewma_alarms"] > 0) == alarm or got["ewma_alarms"] == 1


def _rows(n=120):
    rng = np.random.default_rng(10)
    return pd.DataFrame({"node_id": rng.choice(["a", "b"], n), "source_row_id": np.arange(n), "snr_db": rng.normal(20, 5, n),
                         "mac_retry_count": rng.normal(5, 2, n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, unit="s"),
                         "reset": np.arange(n) % 41 == 40})


def _stream(spark, folder, pdf, parts):
    """One file, and so one micro-batch, per part."""
    for i, part in enumerate(np.array_split(pdf, parts)):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{folder}/p{i}")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/p0").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")


def _by_loop(pdf):
    out = {}
    for _, g in pdf.sort_values(["ts", "source_row_id"]).groupby("node_id"):
        state = D.fresh()
        for r in g.itertuples():
            out[r.source_row_id] = D.advance(state, {"snr_db": r.snr_db, "mac_retry_count": r.mac_retry_count, "reset": r.reset})
    return out


@pytest.mark.parametrize("shuffled, bucket_ms", [(False, 7_000), (True, 7_000), (True, 60_000)])
def test_stream_equals_fold_whatever_the_order_of_arrival(spark, tmp_path, shuffled, bucket_ms):
    pdf = _rows()
    stream = _stream(spark, tmp_path, pdf.sample(frac=1, random_state=3) if shuffled else pdf, 4)
    got = run_to_end(stream, lambda s: D.detect_stream(s, "2 minutes", bucket_ms), "t").toPandas().set_index("source_row_id")
    want = _by_loop(pdf)
    assert sorted(got.index) == sorted(want)
    for i, w in want.items():
        for c in ("window_id", "jam_alarm", "severity", "cusum_alarms", "ewma_alarms"):
            assert got.at[i, c] == w[c]
        assert [dict(d.asDict() if hasattr(d, "asDict") else d) for d in got.at[i, "ewma_details"]] == w["ewma_details"]
        assert len(got.at[i, "cusum_details"]) == 2


def test_many_rows_at_once_fold_like_one_by_one():
    """Columns and carried state of ``advance_rows`` are those of ``advance``, over missing values, resets and cuts anywhere."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({m: rng.normal(20, 5, 150) for m in dict.fromkeys([*D.EWMA_METRICS, *D.CUSUM_DIRECTIONS])})
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1).assign(reset=np.arange(150) % 47 == 46)
    pdf.loc[60:70, "snr_db"] += 60
    one, many, at = D.fresh(), D.fresh(), 0
    for size in (1, 4, 0, 55, 90):
        part = pdf.iloc[at:at + size]
        got, at = pd.DataFrame(D.advance_rows(many, part)), at + size
        for i, values in enumerate(part.to_dict("records")):
            want = D.advance(one, values)
            details = {f"{kind}_{d['metric']}_{f}": v for kind in ("ewma", "cusum") for d in want.pop(f"{kind}_details") for f, v in d.items() if f not in ("metric", "phase")}
            flat = {**want, **{k: v for k, v in details.items() if v is not None}}
            shown = {k: v for k, v in got.iloc[i].to_dict().items() if not (isinstance(v, float) and math.isnan(v))}
            assert shown == flat
        assert many == one


def test_small_buckets_that_are_due_are_folded_together():
    """Six buckets of a key that the watermark has passed: one fold in order of time, and no state call for the timers that follow."""
    class Held(dict):
        calls = 0

        def keys(self):
            self.calls += 1
            return iter(list(super().keys()))

        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    class Value:
        held = None

        def get(self):
            return self.held

        def exists(self):
            return self.held is not None

        def update(self, value):
            self.held = value

    class Handle:
        waiting, timers = Held(), []

        def getMapState(self, *_):
            return self.waiting

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 10 ** 15

    folds = []

    def fold(state, rows):
        folds.append(rows["source_row_id"].tolist())
        return state, rows[["source_row_id"]].copy()

    handle, rng = Handle(), np.random.default_rng(1)
    ids = rng.permutation(60)
    pdf = pd.DataFrame({"source_row_id": ids, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(ids, unit="s"), CLOSING: False})
    p = OrderedFold(fold, lambda: (0,), "n long", "node_id", 10_000)
    p.init(handle)
    list(p.handleInputRows(("a",), iter([pdf.iloc[:25], pdf.iloc[25:]]), None))
    out = [f for _ in range(6) for f in p.handleExpiredTimer(("a",), Watermark(), None)]
    assert folds == [list(range(60))] and len(out) == 1 and handle.waiting == {} and handle.waiting.calls == 1 and len(set(handle.timers)) == 6


def test_rows_come_out_as_the_watermark_passes_and_later_ones_are_dropped(spark, tmp_path):
    """Without a closing row only passed buckets come out; a row behind the watermark of the batch before is dropped."""
    pdf = _rows(80)
    late = pdf.iloc[[0]].assign(source_row_id=999)
    stream = _stream(spark, tmp_path, pd.concat([pdf.iloc[:40], pdf.iloc[40:], late]), 3)
    spark.conf.set(PROVIDER, ROCKSDB)
    got = run_available(D.detect_stream(stream, "5 seconds", 10_000), "t").toPandas()
    spark.conf.unset(PROVIDER)
    seconds = (got["ts"] - pd.Timestamp("2024-01-01")).dt.total_seconds()
    assert 0 < len(got) < 80 and seconds.max() < 30 and set(got["source_row_id"]) == set(pdf["source_row_id"][pdf.index // 2 < 30])


def test_trust_stream_equals_loop_on_shuffled_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    pdf = _rows().assign(positive_evidence=rng.integers(0, 5, 120).astype(float), negative_evidence=rng.integers(0, 5, 120).astype(float),
                         trust_step=rng.choice([0.01, -0.05, -0.4], 120))
    got = run_to_end(_stream(spark, tmp_path, pdf.sample(frac=1, random_state=1), 3), lambda s: T.trust_stream(s, "2 minutes", 9_000), "t")
    got = got.toPandas().set_index("source_row_id")
    for _, g in pdf.groupby("node_id"):
        a, b, c = 5.0, 1.0, 1.0
        for r in g.sort_values(["ts", "source_row_id"]).itertuples():
            a, b, c = a + r.positive_evidence, b + r.negative_evidence, min(1.0, max(0.0, c + r.trust_step))
            assert got.at[r.source_row_id, "beta_trust"] == pytest.approx(a / (a + b))
            assert got.at[r.source_row_id, "clamped_trust"] == pytest.approx(c)


def test_merkle_batches_carry_over_and_replay(spark, tmp_path):
    """Micro-batches of 13, 4 and 30 events: batches of ten span them, equal those of one sealing, and a replayed one changes nothing."""
    pdf = pd.DataFrame({"event_id": np.arange(47), "node_id": "a", "source_type": "uav_ugv", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(47), unit="s")})
    path, events = str(tmp_path / "m"), spark.createDataFrame(pdf)
    write = merkle_log_writer(spark, path)
    parts = [events.where(f"event_id >= {a} and event_id < {b}") for a, b in ((0, 13), (13, 17), (17, 47))]

    def state():
        rows = spark.read.parquet(f"{path}/roots").select("batch_id", "batch_size", "merkle_root").orderBy("batch_id").collect()
        return rows, [spark.read.parquet(f"{path}/carry/{i}").count() for i in range(3)]

    for i, part in enumerate(parts):
        write(part, i)
    first = state()
    for i in (2, 1, 2):  # repeated after a failure
        write(parts[i], i)
    assert state() == first and first[1] == [3, 7, 7]
    sealed = add_positions(events.withColumn("log_hash", record_hash(events)).withColumn("log_timestamp", F.col("ts").cast("string")), ["ts"])
    whole = ledger.merkle_batches(sealed.withColumn("batch_id", F.expr("(_pos - 1) div 10 + 1"))).orderBy("batch_id").collect()
    assert [(r.batch_id, r.batch_size, r.merkle_root) for r in whole[:4]] == [tuple(r) for r in first[0]]


def test_registry_is_complete_and_oracles_have_queries():
    load_all()
    assert len(QUERIES) > 100 and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["c1_packet_windows", "c3_window_label", "b23_b24_label_and_severity", "c28_merkle_batches", "g7_oversampling"])
def test_headline_queries_have_rows(spark, sf, name):
    load_all()
    assert QUERIES[name](spark, sf).count() > 0


def test_dedup_evicts_and_counts_late_rows(spark, tmp_path):
    """Repeats within the delay are dropped as such, later ones as late rows; state holds only what the watermark has not passed."""
    def rows(*seconds):
        return [("a", datetime(2024, 1, 1) + timedelta(seconds=x)) for x in seconds]

    parts = [rows(0, 0, 5), rows(5, 8, 100), rows(101, 101), rows(0, 5, 101, 90, 95), rows(300), rows(101, 400), rows(101, 401)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "node_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    stream = spark.readStream.schema("node_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    kept, counted = run_counted(first_per_key(stream, "10 seconds"), "late-rows")
    second = [int((r.ts - datetime(2024, 1, 1)).total_seconds()) for r in kept.orderBy("ts").collect()]
    assert second == [0, 5, 8, 95, 100, 101, 300, 400, 401]      # 101 comes again three times: twice held in state, then late (behind 290)
    total = counted.groupBy("batch").agg(F.max("read").alias("read"), F.max("late").alias("late"), F.max("state_rows").alias("n")).orderBy("batch").toPandas()
    assert total["read"].sum() == sum(map(len, parts)) and total["late"].sum() == 4
    assert total["n"].iloc[-1] <= 2 < total["n"].max()


def test_alarm_sessions(spark, tmp_path):
    """The gap is inclusive; null keys, null times and calm rows take no part; a stream gives the sessions that are closed."""
    day = datetime(2024, 1, 1)
    rows = [("a", 0, True), ("a", 10, True), ("a", 10, True), ("a", 21, True), ("a", 15, False), ("b", 3, True), (None, 4, True), ("b", None, True), ("b", 90, None)]
    rows = [(n, None if t is None else day + timedelta(seconds=t), alarm) for n, t, alarm in rows]
    df = spark.createDataFrame(rows, "node_id string, ts timestamp, alarm boolean")

    def found(sessions):
        return sorted((r.node_id, (r.session_start - day).total_seconds(), (r.session_end - day).total_seconds(), r.rows) for r in sessions.collect())

    wanted = [("a", 0, 10, 3), ("a", 21, 21, 1), ("b", 3, 3, 1)]
    assert found(series.alarm_sessions(df, F.col("alarm"), "10 seconds")) == wanted
    assert found(series.alarm_sessions(df.limit(0), F.col("alarm"), "10 seconds")) == []
    last = spark.createDataFrame([("c", day + timedelta(seconds=1000), True)], df.schema)
    for i, part in enumerate((df.where("ts <= '2024-01-01 00:00:10'"), df.where("ts > '2024-01-01 00:00:10'"), last)):
        part.coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    closed = run_available(series.alarm_sessions(with_event_time(stream, "100 seconds"), F.col("alarm"), "10 seconds"), "sessions")
    assert found(closed) == wanted


def test_log_report(spark):
    log = spark.createDataFrame(
        [("uav_ugv", "DOS", True, None, None), ("uav_ugv", None, False, None, None), ("uav_ugv", "DOS", None, None, None),
         ("edge", "DOS", True, "ISOLATE", None), ("gcc", None, None, None, "FULL")],
        "source_type string, final_label string, gcc_notified boolean, coordinated_swarm_action string, dominant_strategy string")
    batches = spark.createDataFrame([(1, 3, ["uav_ugv"]), (2, 2, ["edge", "gcc"])], "batch_id long, batch_size long, source_types array<string>")
    got = {(r.dimension, r.item): (r.n, r.share) for r in ledger.log_report(log, batches).collect()}
    assert got == {
        ("source_type", "uav_ugv"): (3, 0.6), ("source_type", "edge"): (1, 0.2), ("source_type", "gcc"): (1, 0.2),
        ("final_label", "DOS"): (2, 2 / 3), ("final_label", None): (1, 1 / 3),
        ("gcc_notified", "true"): (1, 1 / 3), ("gcc_notified", "false"): (1, 1 / 3), ("gcc_notified", None): (1, 1 / 3),
        ("coordinated_swarm_action", "ISOLATE"): (1, 1.0), ("dominant_strategy", "FULL"): (1, 1.0),
        ("total", "events"): (5, 1.0), ("total", "gcc_notified"): (1, 1 / 3), ("total", "merkle_batches"): (2, 1.0),
        ("total", "records_covered"): (5, 1.0),
        ("merkle_source_type", "uav_ugv"): (1, 0.5), ("merkle_source_type", "edge"): (1, 0.5), ("merkle_source_type", "gcc"): (1, 0.5)}
    empty = {(r.dimension, r.item): (r.n, r.share) for r in ledger.log_report(log.limit(0), batches.limit(0)).collect()}
    assert empty == {("total", k): (0, None) for k in ("events", "gcc_notified", "merkle_batches", "records_covered")}
