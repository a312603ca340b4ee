"""Streaming trust per node: Beta counts and clamped trust in a handful of doubles, folded in event-time order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from aerovigil.operators.trust import ALPHA0, BETA0, apply_clamp, prefix_clamps
from aerovigil.streaming.eventtime import in_order

RESULT = "node_id string, source_row_id bigint, beta_trust double, clamped_trust double"
_STATE = "alpha double, beta double, clamped double"


def _fresh() -> tuple:
    return float(ALPHA0), float(BETA0), 1.0


def _fold(carried: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    alpha, beta, clamped = carried
    a = alpha + rows["positive_evidence"].astype(float).clip(lower=0).fillna(0).cumsum().to_numpy()
    b = beta + rows["negative_evidence"].astype(float).clip(lower=0).fillna(0).cumsum().to_numpy()
    level = np.asarray(apply_clamp(clamped, *prefix_clamps(rows["trust_step"].to_numpy(dtype=float))))
    out = pd.DataFrame({"source_row_id": rows["source_row_id"], "beta_trust": a / (a + b), "clamped_trust": level})
    return (float(a[-1]), float(b[-1]), float(level[-1])), out


def trust_stream(stream: DataFrame, delay: str = "10 seconds", bucket_ms: int = 60_000) -> DataFrame:
    """Input: source_row_id, node_id, ts, positive_evidence, negative_evidence, trust_step. Rows up to ``delay`` late take their place."""
    return in_order(stream, _fold, _fresh, _STATE, RESULT, delay, bucket_ms=bucket_ms)
