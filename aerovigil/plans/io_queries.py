"""Round trips through the sources and sinks, on data derived from the tables."""

from pyspark.sql import functions as F

from aerovigil.operators import quality as Q
from aerovigil.operators import series as R
from aerovigil.operators import windows as W
from aerovigil.operators.ordered import order_rows
from aerovigil.operators.quantiles import normal_quantiles
from aerovigil.plans.registry import query
from aerovigil.session import shared_folder
from aerovigil.sources import readers, sinks
from aerovigil.sources.fixtures import packets, packets_sql, telemetry, telemetry_sql

_P = f"with p as materialized ({packets_sql()})"
_T = f"with t as materialized ({telemetry_sql()})"
_NAMES = {v: k for k, v in {**readers.CAPTURE_COLUMNS, **readers.CAPTURE_TEXT}.items()}


def _capture(spark, sf, where="true", drop=(), folder=None):
    """The packets as a capture CSV folder with the original column names, a new one unless given."""
    p = packets(spark, sf).where(where)
    named = p.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("frame.time_epoch"), F.col("label_raw").alias("Label"),
                     *[F.col(c).alias(_NAMES[c]) for c in p.columns if c in _NAMES and c not in drop])
    path = folder or shared_folder(spark, "capture")
    named.write.mode("append").option("header", True).csv(path)
    return path


@query("a1_csv_capture", f"""{_P} select node_id, count(*) as packets, round(sum(frame_len), 4) as bytes, count(signal_dbm) as with_signal, count(distinct ip_src) as sources,
    min(strftime(ts, '%Y-%m-%d %H:%M')) as first_minute from p group by 1""")
def _(spark, sf):
    c = readers.read_capture(spark, _capture(spark, sf))
    return c.groupBy("node_id").agg(F.count("*").alias("packets"), F.round(F.sum("frame_len"), 4).alias("bytes"), F.count("signal_dbm").alias("with_signal"),
                                    F.count_distinct("ip_src").alias("sources"), F.min(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("first_minute"))


@query("a1_row_cap", f"{_P} select least(count(*), 777) as packets from p")
def _(spark, sf):
    return readers.read_capture(spark, _capture(spark, sf), max_rows=777).agg(F.count("*").alias("packets"))


@query("a2_a3_a4_f2_capture_union", f"""{_P} select count(*) as packets, count(case when packet_id % 2 = 0 then ip_ttl end) as with_ttl,
    count(*) filter (where lower(trim(label_raw)) = 'normal') as normal_labels from p""")
def _(spark, sf):
    even, odd = _capture(spark, sf, "packet_id % 2 = 0"), _capture(spark, sf, "packet_id % 2 = 1", drop=("ip_ttl",))
    c = readers.read_capture(spark, even, odd)
    return c.agg(F.count("*").alias("packets"), F.count("ip_ttl").alias("with_ttl"),
                 F.count_if(F.lower(F.trim("label_raw")) == "normal").alias("normal_labels"))


@query("a2_mixed_header_folder", f"""{_P} select count(*) as packets, count(case when packet_id % 2 = 0 then ip_ttl end) as with_ttl, round(sum(frame_len), 4) as bytes from p""")
def _(spark, sf):
    folder = shared_folder(spark, "capture-mixed")
    _capture(spark, sf, "packet_id % 2 = 0", folder=folder)
    _capture(spark, sf, "packet_id % 2 = 1", drop=("ip_ttl",), folder=folder)
    c = readers.read_capture(spark, folder)
    return c.agg(F.count("*").alias("packets"), F.count("ip_ttl").alias("with_ttl"), F.round(F.sum("frame_len"), 4).alias("bytes"))


@query("a5_csv_sink", f"{_T} select label, count(*) as n, count(*) filter (where snr_db < 0) as nested_negative from t group by 1")
def _(spark, sf):
    t = telemetry(spark, sf, "label", "snr_db").withColumn("sensor", F.struct("snr_db")).drop("snr_db")
    path = shared_folder(spark, "sink-csv")
    sinks.write_csv(t, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.count_if(
        F.get_json_object("sensor", "$.snr_db").cast("double") < 0).alias("nested_negative"))


@query("a6_json_lines_sink", f"{_T} select label, count(*) as n, count(*) filter (where snr_db < 0) as nested_negative from t group by 1")
def _(spark, sf):
    t = telemetry(spark, sf, "label", "snr_db").withColumn("sensor", F.struct("snr_db")).drop("snr_db")
    path = shared_folder(spark, "sink-json")
    sinks.write_json_lines(t, path)
    back = spark.read.schema("source_row_id bigint, label string, sensor struct<snr_db: double>").json(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("sensor.snr_db") < 0).alias("nested_negative"))


@query("a7_sequence_arrays", f"""{_T}, s as (select *, row_number() over (partition by node_id order by ts, source_row_id) as p from t)
    select count(*) as n_sequences, 10::bigint as steps, sum(mac_retry_count) as last_step_sum from s where p >= 10""")
def _(spark, sf):
    s = order_rows(telemetry(spark, sf, "node_id", "ts", "mac_retry_count"), ["ts", "source_row_id"], ["node_id"], halo=10)
    path = shared_folder(spark, "sink-arrays")
    sinks.write_arrays(s.finish(R.sequences(s, s.rows, ["mac_retry_count"], 10)).select("source_row_id", "sequence"), path)
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("n_sequences"), F.max(F.size("sequence")).cast("bigint").alias("steps"),
                    F.sum(F.element_at("sequence", -1)[0]).alias("last_step_sum"))


@query("a8_fitted_state", f"""{_T} select 'snr_db' as feature, min(snr_db) as lo, max(snr_db) as hi, quantile_cont(snr_db, 0.05) as threshold from t where label = 'normal'
    union all select 'mac_retry_count', min(mac_retry_count), max(mac_retry_count), quantile_cont(mac_retry_count, 0.05) from t where label = 'normal'""")
def _(spark, sf):
    t = telemetry(spark, sf, "label", "snr_db", "mac_retry_count")
    names = ["snr_db", "mac_retry_count"]
    path = shared_folder(spark, "state")
    sinks.save_state(spark, path, Q.fit_ranges(t, names, normal_only=True), normal_quantiles(t, {n: (n, 0.05) for n in names}), {"jam": names})
    state = sinks.load_state(spark, path)
    return spark.createDataFrame([(n, *state["ranges"][n], state["thresholds"][n]) for n in state["features"]["jam"]],
                                 "feature string, lo double, hi double, threshold double")


@query("a9_f1_f4_collected_tiers", f"""{_T}, e as (select 'edge' as tier, node_id from t where collection_point in ('edge', 'edge_gcc') union all
    select 'gateway', 'gcc_001' from t where collection_point in ('gcc', 'edge_gcc')) select tier, node_id, count(*) as n from e group by 1, 2""")
def _(spark, sf):
    edge, gateway = W.split_tiers(telemetry(spark, sf, "node_id", "collection_point"))
    both = edge.withColumn("tier", F.lit("edge")).unionByName(
        gateway.withColumn("tier", F.lit("gateway")).withColumn("node_id", F.lit("gcc_001")))
    return both.groupBy("tier", "node_id").agg(F.count("*").alias("n"))


@query("e4_tier_features", f"""{_T}, e as (select source_row_id, avg(snr_db) over (partition by node_id order by ts, source_row_id rows between 4 preceding and current row) as snr5 from t where collection_point in ('edge', 'edge_gcc')),
    g as (select source_row_id, max(unique_source_count) over (partition by node_id order by ts, source_row_id rows between 9 preceding and current row) as src10 from t where collection_point in ('gcc', 'edge_gcc'))
    select t.source_row_id, round(coalesce(snr5, 0), 6) as snr_db_roll_mean_5s, coalesce(src10, 0) as source_count_roll_max from t left join e on t.source_row_id = e.source_row_id left join g on t.source_row_id = g.source_row_id""")
def _(spark, sf):
    from aerovigil.operators.temporal import tier_features
    return tier_features(telemetry(spark, sf)).select(
        "source_row_id", F.round("snr_db_roll_mean_5s", 6).alias("snr_db_roll_mean_5s"), "source_count_roll_max")


@query("e7_constants_to_rows", f"{_T}, c as (select avg(snr_db) as m, stddev_samp(snr_db) as s from t) select source_row_id, round((snr_db - m) / s, 6) as z from t, c")
def _(spark, sf):
    t = telemetry(spark, sf, "snr_db")
    one = t.agg(F.avg("snr_db").alias("m"), F.stddev_samp("snr_db").alias("s"))
    return t.crossJoin(F.broadcast(one)).select("source_row_id", F.round((F.col("snr_db") - F.col("m")) / F.col("s"), 6).alias("z"))
