"""Per-node series operators over ``OrderedRows``: rolling statistics, deltas, EWMA, CUSUM, flags.

Each operator takes and returns a frame that carries the helper columns of ``order_rows``; the same
window specification is used throughout, so Spark sorts once and chains the window operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.functions import scalars as S
from aerovigil.operators.ordered import OrderedRows

EWMA_ALPHA = 0.3
WARMUP = 10
_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
_EWMA_LEVELS = 7  # 2 ** 7 rows; the weight beyond them is below 2e-20 at alpha 0.3
HALO_ROWS = 2 ** _EWMA_LEVELS


def rolling(series: OrderedRows, c: Column, rows: int, stat: str) -> Column:
    """Statistic over the last ``rows`` rows; 0 where it is undefined."""
    return F.coalesce(_ROLLING[stat](c).over(series.last_rows(rows)), F.lit(0.0))


def delta(series: OrderedRows, c: Column, absolute: bool = False) -> Column:
    """Change against the previous row of the node; 0 on the first row."""
    change = F.coalesce(c - F.lag(c, 1).over(series.window()), F.lit(0.0))
    return F.abs(change) if absolute else change


def fill_forward(series: OrderedRows, df: DataFrame, columns: list[str]) -> DataFrame:
    """Last known value of the node so far, 0 before the first one."""
    seen = {f"_last_{c}": ("max", F.when(F.col(c).isNotNull(), F.struct("_pos", c))) for c in columns}
    out = series.running(df, seen)
    return out.withColumns({c: F.coalesce(F.col(f"_last_{c}")[c], F.lit(0.0)) for c in columns}).drop(*seen)


def ewma(series: OrderedRows, df: DataFrame, columns: list[str], alpha: float = EWMA_ALPHA,
         suffix: str = "_ewma") -> DataFrame:
    """Exponentially weighted mean, seeded with the first row, by doubling.

    With y = alpha * x (y = x on the first row) and b = 1 - alpha the mean is the sum of b**i * y[t-i].
    Level k adds level k-1 shifted by 2**(k-1) rows times b**(2**(k-1)), so seven lags cover 128 rows.
    """
    keep = 1.0 - alpha
    out = df.withColumns({f"{c}{suffix}": F.when(F.col("_pos") == 1, F.col(c)).otherwise(F.col(c) * alpha)
                          for c in columns})
    for level in range(_EWMA_LEVELS):
        shift = 2 ** level
        weight = keep ** shift
        out = out.withColumns({f"{c}{suffix}": F.col(f"{c}{suffix}") + F.coalesce(
            F.lag(f"{c}{suffix}", shift).over(series.window()) * weight, F.lit(0.0)) for c in columns})
    return out


def warmup_statistics(series: OrderedRows, df: DataFrame, columns: list[str]) -> DataFrame:
    """``_mu_x`` and ``_sd_x`` (population) of the first min(10, max(3, n // 5)) rows of the node."""
    sized = series.per_key(df, {"_n": F.count(F.lit(1))})
    calm = F.col("_pos") <= F.least(F.lit(WARMUP), F.greatest(F.lit(3), F.floor(F.col("_n") / 5)))
    specs = {}
    for c in columns:
        specs[f"_mu_{c}"] = F.avg(F.when(calm, F.col(c)))
        specs[f"_sd_{c}"] = F.stddev_pop(F.when(calm, F.col(c)))
    return series.per_key(sized, specs).drop("_n")


def cusum(series: OrderedRows, df: DataFrame, directions: dict[str, str], slack: float = 0.5,
          limit: float = 5.0) -> DataFrame:
    """``x_cusum`` and ``x_cusum_flag``; needs the warm-up columns of ``warmup_statistics``.

    The recursion max(0, S + y) equals P - min(0, running minimum of P) with P the running sum of y
    (mirrored for downward shifts), so two running aggregates replace the row loop.
    """
    steps = {}
    for c, direction in directions.items():
        slack_width = F.lit(slack) * (F.col(f"_sd_{c}") + 1e-6)
        drift = F.col(c) - F.col(f"_mu_{c}")
        steps[f"_sum_{c}"] = ("sum", drift - slack_width if direction == "up" else drift + slack_width)
    summed = series.running(df, steps)
    extremes = {f"_ext_{c}": ("min" if d == "up" else "max", F.col(f"_sum_{c}")) for c, d in directions.items()}
    ext = series.running(summed, extremes)
    out = {}
    for c, direction in directions.items():
        p, e = F.col(f"_sum_{c}"), F.col(f"_ext_{c}")
        out[f"{c}_cusum"] = (p - F.least(e, F.lit(0.0)) if direction == "up"
                             else F.greatest(e, F.lit(0.0)) - p)
    done = ext.withColumns(out)
    flags = {f"{c}_cusum_flag": S.flag(F.col(f"{c}_cusum") > F.lit(limit) * (F.col(f"_sd_{c}") + 1e-6))
             for c in directions}
    return done.withColumns(flags).drop(*steps, *extremes)


def confirmed(series: OrderedRows, condition: Column, rows: int = 3) -> Column:
    """1 where the condition held on this row and the rows - 1 before it."""
    return S.flag(F.sum(S.flag(condition)).over(series.last_rows(rows)) >= rows)


def threshold_flags(series: OrderedRows, targets: dict[str, tuple[float, str]],
                    thresholds: dict[str, float], rows: int = 3) -> dict[str, Column]:
    """``x_flag``: x beyond its threshold over consecutive rows."""
    out = {}
    for c, (_, side) in targets.items():
        limit = F.lit(thresholds[c])
        out[f"{c}_flag"] = confirmed(series, F.col(c) < limit if side == "below" else F.col(c) > limit, rows)
    return out


def noise_drift(series: OrderedRows, df: DataFrame, column: str = "noise_floor_dbm") -> DataFrame:
    """Rise of the highest of the last 31 values over the warm-up mean, and a flag held for 5 rows.

    A rise equal to its limit is not above it; nine digits decide, so that the order of summation does not.
    """
    if column not in df.columns:
        return df.withColumns({"noise_floor_drift_db": F.lit(0.0), "noise_floor_drift_flag": F.lit(0)})
    rise = F.max(column).over(series.last_rows(31)) - F.col(f"_mu_{column}")
    limit = F.greatest(F.lit(3.0), F.col(f"_sd_{column}") * 2.5)
    out = df.withColumn("_rise", rise).withColumn("noise_floor_drift_db", F.greatest(F.col("_rise"), F.lit(0.0)))
    return out.withColumn("noise_floor_drift_flag", confirmed(series, F.round(F.col("_rise") - limit, 9) > 0, 5)).drop("_rise")


def run_length(series: OrderedRows, df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Length of the current run of rows that meet the condition; 0 where it does not hold."""
    out = series.running(df, {"_break": ("max", F.when(~F.coalesce(condition, F.lit(False)), F.col("_pos")))})
    length = F.col("_pos") - F.coalesce("_break", F.lit(0).cast("bigint"))
    return out.withColumn(name, length.cast("int")).drop("_break")


def alarm_sessions(df: DataFrame, condition: Column, gap: str, key: str = "node_id", ts: str = "ts") -> DataFrame:
    """(key, session_start, session_end, rows): rows that meet the condition, joined while the next follows within ``gap``.

    A row exactly ``gap`` after the last one still belongs to its session; ``session_end`` is the time of the last row. Rows with a null
    key or time are left out. Works on tables and, with a watermark on ``ts``, on streams, where a session comes out once closed.
    """
    alarms = df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] != "timestamp" else df
    alarms = alarms.where(condition & F.col(key).isNotNull() & F.col(ts).isNotNull())
    found = alarms.groupBy(F.session_window(ts, gap), key).agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("rows"))
    return found.select(key, "session_start", "session_end", "rows")


def sequences(series: OrderedRows, df: DataFrame, features: list[str], rows: int = 10) -> DataFrame:
    """``sequence``: the last ``rows`` feature vectors; only rows with a full history are kept."""
    step = F.array(*[F.col(c).cast("double") for c in features])
    earlier = [F.lag("_step", k).over(series.window()) for k in range(rows - 1, 0, -1)]
    out = df.withColumn("_step", step)
    out = out.withColumn("sequence", F.array(*earlier, F.col("_step"))).drop("_step")
    return out.where(F.col("_pos") >= rows)   # not by size, so that a plan that drops the sequences never builds them


def last_where(series: OrderedRows, df: DataFrame, condition: Column, fields: list[str], name: str) -> DataFrame:
    """The named fields of the latest row so far that meets the condition."""
    marked = F.when(condition, F.struct("_pos", *fields))
    out = series.running(df, {name: ("max", marked)})
    return out.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(*[F.col(name)[f].alias(f) for f in fields])))
