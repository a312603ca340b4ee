"""Queries over the raw telemetry view: quality flags, cleaning, ratios, scaling, encodings."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from aerovigil.constants import ALL_METRICS, BOUNDS, JAM_METRICS, RATIO_COLUMNS, ZERO_FILLED_COUNTS
from aerovigil.functions import scalars as S
from aerovigil.operators import quality as Q
from aerovigil.plans.registry import query
from aerovigil.sources.fixtures import packets, packets_sql, telemetry, telemetry_sql

_R = f"with t as materialized ({telemetry_sql(raw=True)})"
_T = f"with t as materialized ({telemetry_sql()})"
_MEDIANS = "snr_db packets_per_second".split()


def raw(spark, sf, *columns):
    return telemetry(spark, sf, *columns, raw=True)


def _joined(c):
    return F.array_join(F.col(c), ",")


def _names_sql(pairs):
    return "concat_ws(',', " + ", ".join(f"case when {cond} then '{name}' end" for name, cond in pairs) + ")"


_MISSING = "case collection_point when 'edge' then {e} when 'gcc' then {g} else {b} end".format(
    e=_names_sql([(m, f"{m} is null") for m in ("rssi_dbm", "snr_db", "packet_delivery_ratio", "mac_retry_count")]),
    g=_names_sql([(m, f"{m} is null") for m in ("packets_per_second", "bytes_per_second", "unique_source_count", "connection_attempts_per_sec")]),
    b=_names_sql([(m, f"{m} is null") for m in ("rssi_dbm", "snr_db", "packet_delivery_ratio", "mac_retry_count",
                                                "packets_per_second", "bytes_per_second", "unique_source_count", "connection_attempts_per_sec")]))
_RANGE_NAMES = _names_sql([(m, f"{m} < {lo} or {m} > {hi}") for m, (lo, hi) in BOUNDS.items()])
_RULES = _names_sql([("RETX_EXCEEDS_RETRIES", "retransmission_count > mac_retry_count * 2.0"),
                     ("HALF_OPEN_EXCEEDS_ATTEMPTS", "half_open_connections > connection_attempts_per_sec * 1.0"),
                     ("SYN_EXCEEDS_CONN_ATTEMPTS", "syn_packet_rate > connection_attempts_per_sec * 1.5")])


@query("b3_numeric_coercion", f"""{_R} select source_row_id, coalesce(snr_db, 0) as snr_db,
    coalesce(packets_per_second, 0) as packets_per_second, coalesce(try_cast(node_id as double), 0) as from_text,
    case when l = 0 then 0 else 1 / l end as inverse from (select *, cast(unique_source_count as double) as l from t)""")
def _(spark, sf):
    t = raw(spark, sf, "snr_db", "packets_per_second", "node_id", "unique_source_count")
    inverse = F.when(F.col("unique_source_count") == 0, F.lit(float("inf"))).otherwise(1 / F.col("unique_source_count"))
    return t.select("source_row_id", S.to_number(F.col("snr_db")).alias("snr_db"),
                    S.to_number(F.col("packets_per_second")).alias("packets_per_second"),
                    S.to_number(F.col("node_id")).alias("from_text"), S.to_number(inverse).alias("inverse"))


@query("b4_guarded_ratio", f"""{_R} select source_row_id,
    round(least(coalesce(packets_per_second / (unique_source_count + 1e-9), 1), 1000), 6) as load from t""")
def _(spark, sf):
    t = raw(spark, sf, "packets_per_second", "unique_source_count")
    load = S.guarded_ratio(F.col("packets_per_second"), F.col("unique_source_count"), 1.0, 1000.0)
    return t.select("source_row_id", F.round(load, 6).alias("load"))


@query("b9_clip_bounds", f"""{_R} select source_row_id, {', '.join(
    f'case when {m} is null then null else round(least(greatest({m}, {BOUNDS[m][0]}), {BOUNDS[m][1]}), 6) end as {m}'
    for m in ("rssi_dbm", "snr_db", "packets_per_second", "bit_error_rate", "cca_failure_count"))} from t""")
def _(spark, sf):
    names = ["rssi_dbm", "snr_db", "packets_per_second", "bit_error_rate", "cca_failure_count"]
    return Q.clip_bounds(raw(spark, sf, *names)).select("source_row_id", *[F.round(m, 6).alias(m) for m in names])


_RATIOS_SQL = """least(greatest(retransmission_count / (mac_retry_count + 1e-9), 0), 1) as retx_per_retry,
    channel_occupancy_pct / 100 as channel_busy_frac,
    least(greatest(syn_packet_rate / (connection_attempts_per_sec + 1e-9), 0), 5) as syn_flood_ratio,
    least(greatest(half_open_connections / (connection_attempts_per_sec + 1e-9), 0), 100) as half_open_ratio,
    least(greatest(1 / (src_ip_entropy + 1e-9), 0), 10) as src_concentration,
    least(greatest(packets_per_second / (unique_source_count + 1e-9), 0), 1000000) as pps_per_source,
    case when sinr_db < 0 then 1.0 else 0.0 end::double as sinr_negative_flag,
    case when bit_error_rate > 0.1 then 1.0 else 0.0 end::double as ber_severe"""


@query("b10_ratio_features", f"""{_T}, r as (select source_row_id, {_RATIOS_SQL} from t)
    select source_row_id, {', '.join(f'round({c}, 6) as {c}' for c in RATIO_COLUMNS)} from r""")
def _(spark, sf):
    return Q.add_ratios(telemetry(spark, sf)).select("source_row_id", *[F.round(c, 6).alias(c) for c in RATIO_COLUMNS])


@query("b13_missing_fields", f"{_R} select source_row_id, {_MISSING} as missing, case when {_MISSING} <> '' then 1 else 0 end as missing_flag from t")
def _(spark, sf):
    t = raw(spark, sf).withColumn("fields", Q.missing_fields(raw(spark, sf)))
    return t.select("source_row_id", _joined("fields").alias("missing"), S.flag(F.size("fields") > 0).alias("missing_flag"))


@query("b14_out_of_range", f"""{_R} select source_row_id, {_RANGE_NAMES} as fields from t""")
def _(spark, sf):
    t = raw(spark, sf)
    listed = F.transform(Q.out_of_range_fields(t), lambda x: F.substring_index(x, "=", 1))
    return t.select("source_row_id", F.array_join(listed, ",").alias("fields"))


@query("b15_consistency_rules", f"{_R} select source_row_id, {_RULES} as violations from t")
def _(spark, sf):
    t = raw(spark, sf)
    return t.select("source_row_id", F.array_join(Q.consistency_violations(t), ",").alias("violations"))


_SPIKE_NAMES = _names_sql([(m, f"abs({m} - m_{m}) / nullif(s_{m}, 0) > 4") for m in ALL_METRICS])
_CHECKED = f"""{_R}, st as (select {', '.join(f'avg({m}) m_{m}, stddev_samp({m}) s_{m}' for m in ALL_METRICS)} from t),
    c as (select t.*, {_MISSING} as missing, {_RANGE_NAMES} as range_fields, {_RULES} as rules, {_SPIKE_NAMES} as spikes,
        case when row_number() over (partition by ts, node_id order by source_row_id) > 1 then 1 else 0 end as dup
        from t, st),
    q as (select *, case when missing <> '' then 0.40::double else 0 end + case when range_fields <> '' then 0.25::double else 0 end
        + case when rules <> '' then 0.15::double else 0 end + case when dup = 1 then 0.10::double else 0 end
        + case when spikes <> '' then 0.10::double else 0 end as score from c)"""


@query("c12_spikes", f"{_CHECKED} select source_row_id, spikes from q")
def _(spark, sf):
    t = raw(spark, sf)
    return t.select("source_row_id", F.array_join(Q.spike_fields(Q.spike_statistics(t, ALL_METRICS)), ",").alias("spikes"))


@query("b16_quality_score", f"{_CHECKED} select source_row_id, dup as duplicate_flag, round(score, 4) as score from q")
def _(spark, sf):
    return Q.check_quality(raw(spark, sf)).select("source_row_id", "duplicate_flag",
                                                  F.round("quality_issue_score", 4).alias("score"))


@query("b17_drop_poor_rows", f"""{_CHECKED}, k as (select *, row_number() over (partition by ts, node_id order by source_row_id) r
    from q where round(score, 9) < 0.5) select source_row_id, round(score, 4) as score from k where r = 1""")
def _(spark, sf):
    kept = Q.drop_poor(Q.check_quality(raw(spark, sf)).withColumn("quality_issue_score", F.round("quality_issue_score", 9)))
    return kept.select("source_row_id", F.round("quality_issue_score", 4).alias("score"))


@query("c10_impute_median", f"""{_R}, md as (select {', '.join(f'median({m}) m_{m}' for m in _MEDIANS)} from t)
    select source_row_id, {', '.join(f'round(coalesce({m}, m_{m}), 6) as {m}' for m in _MEDIANS)},
    coalesce(mac_retry_count, 0) as mac_retry_count from t, md""")
def _(spark, sf):
    t = raw(spark, sf, *_MEDIANS, "mac_retry_count")
    return Q.impute(t).select("source_row_id", *[F.round(m, 6).alias(m) for m in _MEDIANS], "mac_retry_count")


@query("d21_first_per_key", f"""{_T} select source_row_id from (select source_row_id,
    row_number() over (partition by ts, node_id order by source_row_id) r from t) where r = 1""")
def _(spark, sf):
    return (Q.mark_duplicates(telemetry(spark, sf, "ts", "node_id")).where("duplicate_flag = 0").select("source_row_id"))


@query("clean_window_table", f"""{_CHECKED}, k as (select *, row_number() over (partition by ts, node_id order by source_row_id) r
    from q where score < 0.4999999),
    b as (select source_row_id, label, {', '.join(f'case when {m} is null then null else least(greatest({m}, {lo}), {hi}) end as {m}' for m, (lo, hi) in BOUNDS.items())} from k where r = 1),
    md as (select {', '.join(f'median({m}) m_{m}' for m in ALL_METRICS)} from b),
    i as (select source_row_id, label, {', '.join(f'coalesce({m}, {0 if m in ZERO_FILLED_COUNTS else "m_" + m}) as {m}' for m in ALL_METRICS)} from b, md),
    r as (select *, {_RATIOS_SQL} from i)
    select source_row_id, label, {', '.join(f'round({c}, 5) as {c}' for c in ALL_METRICS + RATIO_COLUMNS)} from r""")
def _(spark, sf):
    cleaned = Q.check_and_clean(raw(spark, sf), digits=9, keep=["source_row_id", "label", *ALL_METRICS])
    return cleaned.select("source_row_id", "label", *[F.round(c, 5).alias(c) for c in ALL_METRICS + RATIO_COLUMNS])


_SCALED = ["snr_db", "packets_per_second", "cca_failure_count", "channel_occupancy_pct"]


def _scale_sql(where):
    return f"""{_T}, r as (select {', '.join(f'min({m}) lo_{m}, max({m}) hi_{m}' for m in _SCALED)} from t {where})
    select source_row_id, {', '.join(f'round(({m} - lo_{m}) / (case when hi_{m} = lo_{m} then 1 else hi_{m} - lo_{m} end), 6) as {m}_scaled' for m in _SCALED)} from t, r"""


@query("c11_scale_all_rows", _scale_sql(""))
def _(spark, sf):
    t = telemetry(spark, sf, "label", *_SCALED)
    out = Q.scale(t, Q.fit_ranges(t, _SCALED))
    return out.select("source_row_id", *[F.round(f"{m}_scaled", 6).alias(f"{m}_scaled") for m in _SCALED])


@query("c11_scale_normal_rows", _scale_sql("where label = 'normal'"))
def _(spark, sf):
    t = telemetry(spark, sf, "label", *_SCALED)
    out = Q.scale(t, Q.fit_ranges(t, _SCALED, normal_only=True))
    return out.select("source_row_id", *[F.round(f"{m}_scaled", 6).alias(f"{m}_scaled") for m in _SCALED])


@query("b26_constant_columns", f"""with p as ({packets_sql()}) select 'zero_col' as name, 'all_zero' as kind
    union all select 'zero_col', 'no_variance' union all select 'flat_col', 'no_variance'""")
def _(spark, sf):
    p = packets(spark, sf, "frame_len", "retry").withColumns({"zero_col": F.col("retry") * 0.0, "flat_col": F.lit(3.5)})
    zero, flat = Q.useless_columns(p, ["frame_len", "retry", "zero_col", "flat_col"])
    return spark.createDataFrame([(n, "all_zero") for n in zero] + [(n, "no_variance") for n in flat], "name string, kind string")


@query("b26_identifier_report", f"""with p as ({packets_sql()}), x as (select 'node_id' as name, node_id as v from p
    union all select 'ip_src', ip_src from p union all select 'ip_dst', ip_dst from p)
    select name, count(distinct v) as n_unique, min(v) as sample from x group by 1""")
def _(spark, sf):
    return Q.identifier_report(packets(spark, sf, "node_id", "ip_src", "ip_dst", "frame_len"), exact=True)


@query("b27_feature_selection_by_name", "select unnest(['" + "','".join(
    c for c in ("rssi_dbm", "rssi_dbm_ewma", "snr_db_delta", "packets_per_second", "label", "node_id")
    if c.startswith(("rssi_dbm", "snr_db"))) + "']) as name, (select count(*) from lineitem) as n_rows")
def _(spark, sf):
    t = telemetry(spark, sf, "label", "node_id", "rssi_dbm", "snr_db", "packets_per_second")
    t = t.select("label", "node_id", "rssi_dbm", (F.col("rssi_dbm") * 1).alias("rssi_dbm_ewma"),
                 (F.col("snr_db") * 1).alias("snr_db_delta"), "packets_per_second")
    from aerovigil.operators.selection import named_like
    names = named_like(t.columns, JAM_METRICS)
    return (t.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), "n_rows"))


@query("b43_label_codes_and_matrix", f"""{_T} select source_row_id,
    case label when 'normal' then 0 when 'jamming' then 1 when 'dos' then 2 when 'ddos' then 3 when 'hybrid' then 4 else -1 end as code,
    concat_ws(',', cast(cast(snr_db * 100 as bigint) as varchar), cast(cast(mac_retry_count * 100 as bigint) as varchar)) as features from t""")
def _(spark, sf):
    t = telemetry(spark, sf, "label", "snr_db", "mac_retry_count")
    matrix = VectorAssembler(inputCols=["snr_db", "mac_retry_count"], outputCol="v").transform(t)
    text = F.transform(vector_to_array("v"), lambda x: F.round(x * 100).cast("bigint").cast("string"))
    return matrix.select("source_row_id", S.label_code(F.col("label"), -1).alias("code"), F.array_join(text, ",").alias("features"))
