"""Per-node online detectors as keyed streaming state.

Windows are folded in event-time order; the state carried per node is a few numbers per metric, whatever the length of its history.
``advance`` folds one window and is the definition; ``advance_rows`` folds many, a metric at a time, into plain columns with the same results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.streaming.eventtime import in_order

# Monitored metrics and limits.
EWMA_METRICS = ["rssi_dbm", "snr_db", "sinr_db", "packet_delivery_ratio", "channel_occupancy_pct", "bit_error_rate"]
CUSUM_DIRECTIONS = {"snr_db": "down", "sinr_db": "down", "mac_retry_count": "up", "cca_failure_count": "up",
                    "channel_occupancy_pct": "up"}
ALPHA, SIGMAS, WARMUP, SLACK, LIMIT, HISTORY = 0.3, 3.0, 10, 0.5, 5.0, 30

_BASE = ("node_id string, ts timestamp, source_row_id bigint, window_id bigint, ewma_alarms int, ewma_alarm int, "
         "cusum_alarms int, cusum_alarm int, jam_alarm int, consecutive_alarms int, confidence double, severity string")
_EWMA_FIELDS = {"ewma": "double", "std": "double", "z_score": "double", "alarm": "int"}
_CUSUM_FIELDS = {"s_up": "double", "s_dn": "double", "h": "double", "alarm": "int"}
#: Plain columns: ``ewma_<metric>_<field>`` and ``cusum_<metric>_<field>``, null where the window has no value of the metric.
COLUMNS = ", ".join([_BASE, *(f"ewma_{m}_{f} {t}" for m in EWMA_METRICS for f, t in _EWMA_FIELDS.items()),
                     *(f"cusum_{m}_{f} {t}" for m in CUSUM_DIRECTIONS for f, t in _CUSUM_FIELDS.items())])
_STATE = ("windows bigint, mean array<double>, square array<double>, seen array<int>, warm array<double>, "
          "warm_seen array<int>, center array<double>, width array<double>, total array<double>, recent array<int>")


def fresh() -> dict:
    e, c = len(EWMA_METRICS), len(CUSUM_DIRECTIONS)
    return {"windows": 0, "mean": [0.0] * e, "square": [0.0] * e, "seen": [0] * e, "warm": [0.0] * (c * WARMUP),
            "warm_seen": [0] * c, "center": [0.0] * c, "width": [0.0] * c, "total": [0.0] * c, "recent": []}


def reset(state: dict) -> None:
    """Both detectors start anew, as after a confirmed attack or a reboot; the window number and the recent alarms go on."""
    state.update({k: v for k, v in fresh().items() if k not in ("windows", "recent")})


def _ewma(state: dict, i: int, x: float) -> dict:
    if not state["seen"][i]:
        state["mean"][i], state["square"][i], state["seen"][i] = x, x * x, 1
        return {"metric": EWMA_METRICS[i], "ewma": x, "std": 0.0, "z_score": 0.0, "alarm": 0}
    state["mean"][i] += ALPHA * (x - state["mean"][i])
    state["square"][i] += ALPHA * (x * x - state["square"][i])
    state["seen"][i] += 1
    mean = state["mean"][i]
    spread = math.sqrt(max(0.0, state["square"][i] - mean * mean)) + 1e-9
    z = abs(x - mean) / spread
    return {"metric": EWMA_METRICS[i], "ewma": mean, "std": spread, "z_score": round(z, 4),
            "alarm": int(state["seen"][i] >= WARMUP and z > SIGMAS)}


def _cusum(state: dict, i: int, metric: str, direction: str, x: float) -> dict:
    """One-sided CUSUM; its sum returns to 0 after an alarm, the result still shows the sum that raised it."""
    if state["warm_seen"][i] < WARMUP:
        state["warm"][i * WARMUP + state["warm_seen"][i]] = x
        state["warm_seen"][i] += 1
        if state["warm_seen"][i] == WARMUP:
            calm = state["warm"][i * WARMUP:(i + 1) * WARMUP]
            center = sum(calm) / WARMUP
            state["center"][i] = center
            state["width"][i] = math.sqrt(sum((v - center) ** 2 for v in calm) / WARMUP) + 1e-6
        return {"metric": metric, "s_up": 0.0, "s_dn": 0.0, "h": None, "alarm": 0, "phase": "warmup"}
    sign = 1.0 if direction == "up" else -1.0
    width = state["width"][i]
    total = max(0.0, state["total"][i] + sign * (x - state["center"][i]) - SLACK * width)
    alarm = int(total > LIMIT * width)
    state["total"][i] = 0.0 if alarm else total
    return {"metric": metric, "s_up": round(total, 4) if sign > 0 else 0.0, "s_dn": -round(total, 4) if sign < 0 else 0.0,
            "h": round(LIMIT * width, 4), "alarm": alarm, "phase": "active"}


def advance(state: dict, values: dict) -> dict:
    """Folds one window into the state and returns its result; absent metrics are skipped, a true ``reset`` starts the detectors anew."""
    def known(name: str) -> bool:
        return values.get(name) is not None and not math.isnan(values[name])

    if values.get("reset") is True or values.get("reset") == 1:
        reset(state)
    state["windows"] += 1
    ewma_details = [_ewma(state, i, float(values[m])) for i, m in enumerate(EWMA_METRICS) if known(m)]
    cusum_details = [_cusum(state, i, m, d, float(values[m])) for i, (m, d) in enumerate(CUSUM_DIRECTIONS.items()) if known(m)]
    ewma, cusum = sum(d["alarm"] for d in ewma_details), sum(d["alarm"] for d in cusum_details)
    alarm = int(ewma >= 2 or (cusum >= 1 and ewma >= 1))
    state["recent"] = [*state["recent"], alarm][-HISTORY:]
    count = sum(state["recent"])
    level = "NONE" if not alarm else "HIGH" if count >= 10 else "MEDIUM" if count >= 3 else "LOW"
    metrics = len(EWMA_METRICS) + len(CUSUM_DIRECTIONS)
    return {"window_id": state["windows"], "ewma_alarms": ewma, "ewma_alarm": int(ewma >= 2), "cusum_alarms": cusum,
            "cusum_alarm": int(cusum >= 1), "jam_alarm": alarm, "consecutive_alarms": count,
            "confidence": round(min((ewma + cusum) / metrics, 1.0), 4), "severity": level,
            "ewma_details": ewma_details, "cusum_details": cusum_details}


def _ewma_rows(state: dict, i: int, xs: list[float]) -> dict[str, np.ndarray]:
    """``_ewma`` of consecutive values."""
    mean, square, seen = state["mean"][i], state["square"][i], state["seen"][i]
    means, squares = np.empty(len(xs)), np.empty(len(xs))
    for k, x in enumerate(xs):
        if seen:
            mean += ALPHA * (x - mean)
            square += ALPHA * (x * x - square)
        else:
            mean, square = x, x * x
        seen += 1
        means[k], squares[k] = mean, square
    first = state["seen"][i] == 0
    state["mean"][i], state["square"][i], state["seen"][i] = mean, square, seen
    std = np.sqrt(np.maximum(0.0, squares - means * means)) + 1e-9
    z = np.abs(np.asarray(xs) - means) / std
    if first:
        std[0] = z[0] = 0.0
    alarm = (np.arange(seen - len(xs) + 1, seen + 1) >= WARMUP) & (z > SIGMAS)
    return {"ewma": means, "std": std, "z_score": np.array([round(v, 4) for v in z.tolist()]), "alarm": alarm}


def _cusum_rows(state: dict, i: int, metric: str, direction: str, xs: list[float]) -> dict[str, np.ndarray]:
    """``_cusum`` of consecutive values; ``h`` is NaN in the warm-up."""
    up, calm = direction == "up", min(len(xs), WARMUP - state["warm_seen"][i])
    for x in xs[:calm]:
        _cusum(state, i, metric, direction, x)
    sums, alarm, h = np.zeros(len(xs)), np.zeros(len(xs), bool), np.full(len(xs), np.nan)
    if calm < len(xs):
        sign, width, center, total = 1.0 if up else -1.0, state["width"][i], state["center"][i], state["total"][i]
        slack, limit = SLACK * width, LIMIT * width
        h[calm:] = round(limit, 4)
        for k in range(calm, len(xs)):
            total = max(0.0, total + sign * (xs[k] - center) - slack)
            sums[k] = round(total, 4)
            if total > limit:
                alarm[k], total = True, 0.0
        state["total"][i] = total
    nothing = np.zeros(len(xs))
    return {"s_up": sums if up else nothing, "s_dn": nothing if up else np.where(np.isnan(h), 0.0, -sums), "h": h, "alarm": alarm}


def advance_rows(state: dict, rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """``advance`` over the rows of a frame in their order, as plain columns (``COLUMNS`` from ``window_id`` on)."""
    n = len(rows)
    values = {m: pd.to_numeric(rows[m]).to_numpy(dtype=float, na_value=np.nan) for m in dict.fromkeys([*EWMA_METRICS, *CUSUM_DIRECTIONS]) if m in rows.columns}
    starts = [0, n]   # a reset begins a new run of rows
    anew: set[int] = set()
    if "reset" in rows.columns:
        anew = {k for k, v in enumerate(rows["reset"].tolist()) if v is True or v == 1}
        starts = sorted({*starts, *anew})
    out: dict[str, np.ndarray] = {}
    for kind, metrics, fields in (("ewma", EWMA_METRICS, _EWMA_FIELDS), ("cusum", CUSUM_DIRECTIONS, _CUSUM_FIELDS)):
        out |= {f"{kind}_{m}_{f}": np.full(n, np.nan) for m in metrics for f in fields}
    for start, end in zip(starts, starts[1:]):
        if start in anew:
            reset(state)
        for m, column in values.items():
            at = start + np.flatnonzero(~np.isnan(column[start:end]))
            if not len(at):
                continue
            xs = column[at].tolist()
            if m in EWMA_METRICS:
                for f, v in _ewma_rows(state, EWMA_METRICS.index(m), xs).items():
                    out[f"ewma_{m}_{f}"][at] = v
            if m in CUSUM_DIRECTIONS:
                for f, v in _cusum_rows(state, list(CUSUM_DIRECTIONS).index(m), m, CUSUM_DIRECTIONS[m], xs).items():
                    out[f"cusum_{m}_{f}"][at] = v
    ewma = sum((out[f"ewma_{m}_alarm"] == 1).astype(int) for m in EWMA_METRICS)
    cusum = sum((out[f"cusum_{m}_alarm"] == 1).astype(int) for m in CUSUM_DIRECTIONS)
    alarm = ((ewma >= 2) | ((cusum >= 1) & (ewma >= 1))).astype(int)
    recent = [0] * HISTORY + state["recent"]
    passed = np.concatenate([[0], np.cumsum([*recent[-HISTORY:], *alarm.tolist()])])
    count = passed[HISTORY + 1:] - passed[1:n + 1]
    level = np.where(alarm == 0, "NONE", np.where(count >= 10, "HIGH", np.where(count >= 3, "MEDIUM", "LOW")))
    metrics = len(EWMA_METRICS) + len(CUSUM_DIRECTIONS)
    share = np.array([round(min(k / metrics, 1.0), 4) for k in range(metrics + 1)])
    first = state["windows"] + 1
    state["windows"] += n
    state["recent"] = [*state["recent"], *alarm.tolist()[-HISTORY:]][-HISTORY:]
    return {"window_id": np.arange(first, first + n), "ewma_alarms": ewma, "ewma_alarm": (ewma >= 2).astype(int), "cusum_alarms": cusum,
            "cusum_alarm": (cusum >= 1).astype(int), "jam_alarm": alarm, "consecutive_alarms": count, "confidence": share[ewma + cusum],
            "severity": level.astype(object), **out}


def _fresh() -> tuple:
    return tuple(fresh().values())


def _fold(carried: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    state = {n: list(v) if not isinstance(v, int) else v for n, v in zip(fresh(), carried)}
    out = {"ts": rows["ts"], "source_row_id": rows["source_row_id"], **advance_rows(state, rows)}
    return tuple(state.values()), pd.DataFrame(out)


def detect_columns(stream: DataFrame, delay: str = "10 seconds", bucket_ms: int = 60_000) -> DataFrame:
    """``detect_stream`` with plain columns (``COLUMNS``) in place of the details."""
    return in_order(stream, _fold, _fresh, _STATE, COLUMNS, delay, bucket_ms=bucket_ms)


def detect_stream(stream: DataFrame, delay: str = "10 seconds", bucket_ms: int = 60_000) -> DataFrame:
    """EWMA and CUSUM alarms per node, in event time, over a stream of (source_row_id, node_id, ts, metrics[, reset]).

    Windows up to ``delay`` late are put in their place; the results do not depend on the order of arrival or on micro-batches.
    """
    def details(kind: str, metrics: list[str], fields: dict[str, str], present: str) -> Column:
        each = [F.when(F.col(f"{kind}_{m}_{present}").isNotNull(), F.struct(
            F.lit(m).alias("metric"), *[F.col(f"{kind}_{m}_{f}").alias(f) for f in fields],
            *([F.when(F.col(f"{kind}_{m}_h").isNull(), "warmup").otherwise("active").alias("phase")] if kind == "cusum" else []))) for m in metrics]
        return F.array_compact(F.array(*each))

    found = detect_columns(stream, delay, bucket_ms)
    return found.select(*[c.split()[0] for c in _BASE.split(", ")], details("ewma", EWMA_METRICS, _EWMA_FIELDS, "ewma").alias("ewma_details"),
                        details("cusum", list(CUSUM_DIRECTIONS), _CUSUM_FIELDS, "alarm").alias("cusum_details"))
