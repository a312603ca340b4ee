"""Ordered series over keys of any size.

Window functions need all rows of a key in one task. That is fine for ordinary keys and fatal
for a key that holds a large share of the data. ``order_rows`` counts rows per key first. Keys
within ``rows_per_task`` keep the plain window plan. Larger keys get exact positions from a range
partitioning, are cut into equal chunks of ``rows_per_task`` rows, and every chunk carries the last
``halo`` rows of its predecessor so that bounded frames stay exact. Unbounded frames are completed
with per-chunk totals (``running``). With no keys the whole table is one ordered series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerovigil.functions.joins import join_keys
from aerovigil.session import SMALL_SIDE_ROWS, durable, small_side

ROWS_PER_TASK = 1_000_000
MOST_RANGES = 10_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def add_positions(df: DataFrame, order: list[str], keys: list[str] | None = None,
                  rows_per_partition: int = ROWS_PER_TASK, rows: int | None = None,
                  fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exact 1-based ``_pos`` of every row in (keys, order), without gathering a key in one task.

    One exchange: rows are ranged, sorted and written with a number that rises within each range. A small table of the first
    number and the rows before each (key, range) turns it into the position. Ranges are sorted with spilling, so their number
    has an upper limit. With ``fold``, which must keep rows and their order, the sorted ranges pass through it before they are written,
    and ``_before`` and ``_behind`` tell the rows of the same (key, range) on either side.
    """
    keys = keys or []
    rows = df.count() if rows is None else rows
    partitions = min(max(1, -(-rows // rows_per_partition)), MOST_RANGES)
    ranged = df.repartitionByRange(partitions, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = durable((ranged if fold is None else fold(ranged)).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    group = [*keys, "_part"]
    sizes = ranged.groupBy(*group).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part")
    # One row per (key, range): at most one more than ranges plus keys.
    starts = sizes.select(*group, "_first", "_size", (F.coalesce(
        F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    placed = join_keys(ranged, small_side(starts), group).withColumn("_pos", F.col("_at") + F.col("_shift"))
    if fold is not None:
        placed = placed.withColumns({"_before": F.col("_at") - F.col("_first"), "_behind": F.col("_first") + F.col("_size") - 1 - F.col("_at")})
    return placed.drop("_at", "_part", "_shift", "_first", "_size")


@dataclass(frozen=True)
class OrderedRows:
    rows: DataFrame
    keys: list[str]
    order: list[str]
    chunked: bool

    @property
    def group(self) -> list[str]:
        return [*self.keys, "_chunk"] if self.chunked or not self.keys else self.keys

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*(["_pos"] if self.chunked else self.order))

    def last_rows(self, n: int) -> WindowSpec:
        """Frame of the current row and its n - 1 predecessors."""
        return self.window().rowsBetween(-(n - 1), 0)

    def running(self, df: DataFrame, specs: dict[str, tuple[str, Column]],
                exclusive: bool = False) -> DataFrame:
        """Aggregates from the first row of the key to this row (or the row before it)."""
        frame = self.window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        if not self.chunked:
            return df.withColumns({n: _AGG[k](c).over(frame) for n, (k, c) in specs.items()})
        own = {n: (k, F.when(~F.col("_halo"), c)) for n, (k, c) in specs.items()}
        local = df.withColumns({n: _AGG[k](c).over(frame) for n, (k, c) in own.items()})
        totals = df.groupBy(*self.group).agg(*[_AGG[k](c).alias(n) for n, (k, c) in own.items()])
        earlier = ((Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0)))
                   .orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
        carry = totals.select(*self.group, *[
            _AGG[k](n).over(earlier).alias(f"_carry_{n}") for n, (k, _) in own.items()])
        joined = join_keys(local, carry, self.group, "left")
        merged = {}
        for n, (k, _) in own.items():
            here, past = F.col(n), F.col(f"_carry_{n}")
            if k == "sum":
                both = F.coalesce(here + past, here, past)
            elif k == "min":
                both = F.least(here, past)
            else:
                both = F.when(past.isNull() | (here > past), F.coalesce(here, past)).otherwise(past)
            merged[n] = both
        return joined.withColumns(merged).drop(*[f"_carry_{n}" for n in own])

    def per_key(self, df: DataFrame, specs: dict[str, Column]) -> DataFrame:
        """Aggregates over the whole key, attached to each of its rows."""
        if not self.chunked and self.keys:
            whole = Window.partitionBy(*self.keys)
            return df.withColumns({n: c.over(whole) for n, c in specs.items()})
        own = df.where(~F.col("_halo")) if self.chunked else df
        if not self.keys:
            return df.crossJoin(F.broadcast(own.agg(*[c.alias(n) for n, c in specs.items()])))
        return join_keys(df, own.groupBy(*self.keys).agg(*[c.alias(n) for n, c in specs.items()]), self.keys)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop repeated rows and helper columns."""
        out = df.where(~F.col("_halo")) if self.chunked else df
        return out.drop("_halo", "_chunk")


def order_rows(df: DataFrame, order: list[str], keys: list[str] | None = None, *, halo: int = 0,
               rows_per_task: int = ROWS_PER_TASK) -> OrderedRows:
    """Rows prepared for windows over (keys, order); adds ``_pos``, the position within the key."""
    keys = keys or []
    if not keys:
        rows = df.count()
        if rows <= rows_per_task:
            single = df.withColumn("_chunk", F.lit(0))
            plain = OrderedRows(single, keys, order, False)
            return OrderedRows(single.withColumn("_pos", F.row_number().over(plain.window()).cast("bigint")),
                               keys, order, False)
        return OrderedRows(_chunks(df, order, keys, halo, rows_per_task, rows), keys, order, True)

    large = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows_per_task)
    totals = large.agg(F.count("*"), F.sum("_rows")).first()
    if totals[0] == 0:
        plain = OrderedRows(df, keys, order, False)
        return OrderedRows(df.withColumn("_pos", F.row_number().over(plain.window()).cast("bigint")),
                           keys, order, False)
    names = large.select(*keys)
    if totals[0] <= SMALL_SIDE_ROWS:
        names = F.broadcast(names)
    ordinary = join_keys(df, names, keys, "left_anti")
    ordinary = (ordinary
                .withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
                .withColumn("_chunk", F.lit(0).cast("bigint")).withColumn("_halo", F.lit(False)))
    heavy = _chunks(join_keys(df, names, keys, "left_semi"), order, keys, halo, rows_per_task, totals[1])
    return OrderedRows(ordinary.unionByName(heavy), keys, order, True)


def _chunks(df: DataFrame, order: list[str], keys: list[str], halo: int, size: int, rows: int) -> DataFrame:
    if halo >= size:
        raise ValueError("a chunk must be longer than its halo")
    placed = add_positions(df, order, keys, size, rows)
    own = F.floor((F.col("_pos") - 1) / F.lit(size)).cast("bigint")
    near_end = F.pmod(F.col("_pos") - 1, F.lit(size)) >= size - halo
    targets = F.when(near_end & F.lit(halo > 0), F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.select("*", F.posexplode(targets).alias("_copy", "_chunk"))
    return spread.withColumn("_halo", F.col("_copy") == 1).drop("_copy")
