"""Running trust per node: clamped additive trust and Beta trust."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.functions.joins import join_keys
from aerovigil.operators.ordered import ROWS_PER_TASK, OrderedRows, order_rows

# Prior of the Beta trust.
ALPHA0, BETA0 = 5.0, 1.0


def prefix_clamps(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix compositions of x -> clip(x + step, 0, 1), each as (low, high, shift).

    Clamp maps are closed under composition, so log2(n) vector steps give all prefixes.
    """
    low, high, shift = np.zeros(len(steps)), np.ones(len(steps)), steps.astype(float).copy()
    span = 1
    while span < len(steps):
        l1, h1, d1 = low[:-span], high[:-span], shift[:-span]
        l2, h2, d2 = low[span:].copy(), high[span:].copy(), shift[span:].copy()
        low[span:] = np.minimum(h2, np.maximum(l2, l1 + d2))
        high[span:] = np.minimum(h2, np.maximum(l2, h1 + d2))
        shift[span:] = d1 + d2
        span *= 2
    return low, high, shift


def apply_clamp(x, low, high, shift):
    return np.minimum(high, np.maximum(low, x + shift))


def clamped_trust(df: DataFrame, channels: dict[str, tuple[Column, Column]], start: float = 1.0,
                  order: tuple[str, ...] = ("ts", "source_row_id"), rows_per_task: int = ROWS_PER_TASK,
                  carry: list[str] | None = None) -> DataFrame:
    """Trust of each channel per row of a node: ``c_before``, ``c_middle``, ``c_after``, beside the row id and the columns ``carry``.

    Carried columns pass through the tasks as they are, so that the rows need no join to get their trust.

    Every row adds two steps in turn, each followed by a clip to [0, 1]. Tasks hold one node, or one
    chunk of a node with more than ``rows_per_task`` rows; chunks are composed first and seeded then.
    """
    names, carry = list(channels), [c for c in carry or [] if c != "source_row_id"]
    kept = list(dict.fromkeys(["source_row_id", "node_id", *order, *carry]))
    narrow = df.select(*kept, *[c.cast("double").alias(f"_step_{n}_{i}") for n, pair in channels.items() for i, c in enumerate(pair)])
    s = order_rows(narrow, list(order), ["node_id"], rows_per_task=rows_per_task)
    steps = [f"_step_{n}_{i}" for n in names for i in (0, 1)]
    rows = s.rows.select(*dict.fromkeys([*kept, *s.group, "_pos", *steps]))
    if s.chunked:
        seeds = _chunk_seeds(rows.select(*s.group, "_pos", *steps), s, names, start)
        rows = join_keys(rows, seeds, s.group)
    else:
        rows = rows.withColumns({f"{n}_start": F.lit(float(start)) for n in names})
    passed = ["source_row_id", *carry]
    schema = T.StructType([rows.schema[c] for c in passed]
                          + [T.StructField(f"{n}_{k}", T.DoubleType()) for n in names for k in ("before", "middle", "after")])

    def fold(table: pa.Table) -> pa.Table:
        at = table["_pos"].to_numpy()
        if (at[1:] < at[:-1]).any():
            table = table.take(pa.array(np.argsort(at, kind="stable")))
        out = table.select(passed)
        for n in names:
            pair = np.column_stack([table[f"_step_{n}_{i}"].to_numpy() for i in (0, 1)]).ravel()
            first = table[f"{n}_start"][0].as_py()
            states = apply_clamp(first, *prefix_clamps(pair)).reshape(-1, 2)
            for k, values in (("before", np.concatenate([[first], states[:-1, 1]])), ("middle", states[:, 0]), ("after", states[:, 1])):
                out = out.append_column(f"{n}_{k}", pa.array(values))
        return out

    return rows.groupBy(*s.group).applyInArrow(fold, schema)


def _chunk_seeds(rows: DataFrame, s: OrderedRows, names: list[str], start: float) -> DataFrame:
    """Trust at the start of every chunk: each chunk as one clamp map, then applied in chunk order."""
    schema = "node_id string, _chunk bigint, " + ", ".join(
        f"{n}_{k} double" for n in names for k in ("low", "high", "shift"))

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        out = {"node_id": [key[0]], "_chunk": [key[1]]}
        for n in names:
            low, high, shift = prefix_clamps(pdf[[f"_step_{n}_0", f"_step_{n}_1"]].to_numpy().ravel())
            out[f"{n}_low"], out[f"{n}_high"], out[f"{n}_shift"] = [low[-1]], [high[-1]], [shift[-1]]
        return pd.DataFrame(out)

    def seed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        out = {"node_id": pdf["node_id"], "_chunk": pdf["_chunk"]}
        for n in names:
            x, starts = float(start), []
            for low, high, shift in zip(pdf[f"{n}_low"], pdf[f"{n}_high"], pdf[f"{n}_shift"]):
                starts.append(x)
                x = min(high, max(low, x + shift))
            out[f"{n}_start"] = starts
        return pd.DataFrame(out)

    chunks = rows.groupBy(*s.group).applyInPandas(compose, schema)
    # One row per chunk: a node has rows / rows_per_task of them.
    return chunks.groupBy("node_id").applyInPandas(
        seed, "node_id string, _chunk bigint, " + ", ".join(f"{n}_start double" for n in names))


def beta_trust(s: OrderedRows, df: DataFrame, positive: str, negative: str) -> DataFrame:
    """``trust_before`` and ``trust_after``: alpha / (alpha + beta) around each row of its node."""
    gain = {"_a": ("sum", F.greatest(F.col(positive), F.lit(0.0))), "_b": ("sum", F.greatest(F.col(negative), F.lit(0.0)))}
    after = s.running(df, gain)
    before = s.running(after, {f"{n}0": spec for n, spec in gain.items()}, exclusive=True)

    def score(a: str, b: str) -> Column:
        alpha = F.lit(ALPHA0) + F.coalesce(a, F.lit(0.0))
        return alpha / (alpha + F.lit(BETA0) + F.coalesce(b, F.lit(0.0)))

    return before.withColumns({"trust_before": score("_a0", "_b0"), "trust_after": score("_a", "_b")}).drop(
        "_a", "_b", "_a0", "_b0")


def trust_registry(df: DataFrame, positive: str = "positive_evidence", negative: str = "negative_evidence") -> DataFrame:
    """Final alpha, beta, trust and number of rows per node."""
    sums = df.groupBy("node_id").agg(
        (F.lit(ALPHA0) + F.sum(F.greatest(F.col(positive), F.lit(0.0)))).alias("alpha"),
        (F.lit(BETA0) + F.sum(F.greatest(F.col(negative), F.lit(0.0)))).alias("beta"),
        F.count("*").alias("history_count"))
    return sums.withColumn("final_trust", F.col("alpha") / (F.col("alpha") + F.col("beta")))
