"""Exact interpolated quantiles for tables and groups of any size.

NaN and null count as missing, at any size. Small inputs use Spark's exact ``percentile``, whose memory grows with the number of
distinct values. Above ``direct_cells`` values, an approximate quantile sketch brackets each target rank,
counts prove that the rank lies inside the bracket, and the bracket is narrowed until the values
strictly inside it are few enough to be read. Every step is a partially aggregated group-by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.functions.joins import join_keys
from aerovigil.functions.scalars import to_number
from aerovigil.session import durable, small_side

DIRECT_CELLS = 4_000_000
INSIDE_VALUES = 100_000
DIRECT_CUT_ROWS = 100_000   #: A sketch of twice this accuracy drops none of so many values.
_ACCURACY = 10_000


def present(c: Column) -> Column:
    """The value as a double; null where it is missing."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value + 0.0)


def exact_quantiles(df: DataFrame, specs: dict[str, tuple[Column, float]], *,
                    direct_cells: int = DIRECT_CELLS, inside: int = INSIDE_VALUES,
                    rows: int | None = None) -> dict[str, float | None]:
    """Quantile per name over the whole table, returned as driver scalars."""
    if not specs:
        return {}
    rows = df.count() if rows is None else rows
    if rows * len({str(c) for c, _ in specs.values()}) <= direct_cells:
        # Values that are asked for at several q share one percentile state.
        by_value: dict[str, tuple[Column, list[tuple[str, float]]]] = {}
        for name, (c, q) in specs.items():
            by_value.setdefault(str(c), (c, []))[1].append((name, q))
        aggs, layout = [], []
        for i, (c, wanted) in enumerate(by_value.values()):
            aggs.append(F.percentile(present(c), F.array(*[F.lit(float(q)) for _, q in wanted])).alias(f"p{i}"))
            layout.append([n for n, _ in wanted])
        row = df.agg(*aggs).first()
        return {n: (row[i][j] if row[i] is not None else None)
                for i, names in enumerate(layout) for j, n in enumerate(names)}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit(float(q)).alias("q"), c.cast("double").alias("v"))
        for n, (c, q) in specs.items()])).alias("x")).select("x.*")
    found = {r["metric"]: r["value"] for r in _select_ranks(long, ["metric"], inside).collect()}
    return {n: found.get(n) for n in specs}


def normal_quantiles(df: DataFrame, specs: dict[str, tuple[str, float]], label: str = "label",
                     extra: dict[str, Column] | None = None, **options) -> dict:
    """Quantiles over rows labelled normal; over all rows unless more than ten are normal.

    Absent columns and columns without a value give 0. ``extra`` aggregates over all rows ride along
    with the counting pass and are returned under their names.
    """
    there = {n: s for n, s in specs.items() if s[0] in df.columns}
    extra = extra or {}
    normal = (F.col(label) == "normal") if label in df.columns else F.lit(False)
    row = df.agg(F.count("*").alias("_rows"), F.count_if(normal).alias("_normals"),
                 *[c.alias(n) for n, c in extra.items()]).first()
    few = row["_normals"] <= 10
    found = exact_quantiles(df if few else df.where(normal),
                            {n: (to_number(F.col(c), None), q) for n, (c, q) in there.items()},
                            rows=row["_rows"] if few else row["_normals"], **options)
    return {**{n: float(found.get(n) or 0.0) for n in specs}, **{n: row[n] for n in extra}}


def grouped_quantiles(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, float]], *,
                      rows_per_task: int = 1_000_000, inside: int = INSIDE_VALUES) -> DataFrame:
    """Exact quantiles per group; groups beyond ``rows_per_task`` values use rank selection."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    large = sizes.where(F.col("_rows") * len(specs) > rows_per_task).select(*keys)
    direct = [F.percentile(present(F.col(c)), F.lit(float(q))).alias(n) for n, (c, q) in specs.items()]
    if large.isEmpty():
        return df.groupBy(*keys).agg(*direct)
    ordinary = join_keys(df, small_side(large), keys, "left_anti").groupBy(*keys).agg(*direct)
    long = join_keys(df, small_side(large), keys, "left_semi").select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit(float(q)).alias("q"), F.col(c).cast("double").alias("v"))
        for n, (c, q) in specs.items()])).alias("x")).select(*keys, "x.*")
    chosen = _select_ranks(long, [*keys, "metric"], inside)
    heavy = chosen.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in specs])
    return ordinary.unionByName(join_keys(large, heavy, keys, "left"))  # a group without any value stays, as null


def grouped_median(df: DataFrame, keys: list[str], metrics: list[str], **options) -> DataFrame:
    return grouped_quantiles(df, keys, {m: (m, 0.5) for m in metrics}, **options)


def exact_cuts(df: DataFrame, columns: list[str], parts: int, *, direct_rows: int = DIRECT_CUT_ROWS,
               inside: int = INSIDE_VALUES) -> dict[str, list[float]]:
    """Per column its values at the ranks ceil(i * n / parts) for i from 1 to parts - 1, sorted, without repeats; at any size.

    Up to ``direct_rows`` values a sketch that holds every value answers. Beyond, all ranks of all columns are searched together: sketches
    propose edges around the ranks, counts prove which interval holds a rank, intervals with many values are cut at a sketch of what lies
    inside them, and the values of small ones are read at their ranks. Rows are read once per round; values are placed between edges by
    binary search, and only those of the intervals that are read leave their task. The driver holds some numbers per column and part.
    """
    value = {c: present(F.col(c)) for c in columns}
    sizes = df.agg(*[F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"c{i}")
                     for i, v in enumerate(value.values())]).first()
    size = dict(zip(columns, sizes))
    found: dict[str, list[float]] = {c: [] for c in columns}
    direct = [c for c in columns if 0 < size[c].n <= direct_rows]
    if direct:
        grid = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        row = df.agg(*[F.percentile_approx(value[c], grid, 2 * DIRECT_CUT_ROWS).alias(f"c{i}") for i, c in enumerate(direct)]).first()
        found |= {c: list(v) for c, v in zip(direct, row)}
    wanted = {c: {(i * size[c].n + parts - 1) // parts for i in range(1, parts)} for c in columns if size[c].n > direct_rows}
    edges = {c: [size[c].lo, size[c].hi] for c in wanted}
    if wanted:
        around = {c: _around(ranks, size[c].n) for c, ranks in wanted.items()}
        row = df.agg(*[F.percentile_approx(value[c], F.array(*[F.lit(g / _GRID) for g in around[c]]), _ACCURACY).alias(f"c{i}")
                       for i, c in enumerate(wanted)]).first()
        for c, proposed in zip(wanted, row):
            edges[c] += proposed
    for _ in range(64):
        wanted = {c: ranks for c, ranks in wanted.items() if ranks}
        if not wanted:
            return {c: sorted(set(v)) for c, v in found.items()}
        bounds = {c: sorted(set(edges[c])) for c in wanted}
        counted: dict[str, list] = {c: [] for c in wanted}
        for r in sorted(_count_places(df, bounds).collect(), key=lambda r: r["place"]):  # a row per interval
            counted[r["name"]].append(r)
        # An interval (edge before, edge at its place) and the ranks in it, from the first value of the interval on.
        small, wide = [], []
        for c, ranks in wanted.items():
            below = 0
            for r in counted[c]:
                interior = r["n"] - r["equal"]
                here = sorted(k - below for k in ranks if below < k <= below + r["n"])
                found[c] += [bounds[c][r["place"]] for k in here if k > interior]
                inner = [k for k in here if k <= interior]
                if inner and interior <= inside:
                    small.append((c, r["place"], inner))
                elif inner:
                    wide.append((c, r["place"], [g + 1 for g in _around(inner, interior)]))
                ranks -= {k + below for k in here if k > interior or interior <= inside}
                below += r["n"]
        for intervals, build in ((small, lambda: F.array_sort(F.collect_list("v"))), (wide, lambda: F.percentile_approx(
                "v", F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)]), _ACCURACY))):
            if not intervals:
                continue
            # At most columns x parts intervals.
            picked = df.sparkSession.createDataFrame(intervals, "name string, place int, at array<int>")
            held = _inside_places(df, bounds, intervals).groupBy("name", "place").agg(build().alias("values"))
            read = held.join(F.broadcast(picked), ["name", "place"]).select(
                "name", F.transform("at", lambda i: F.element_at("values", i)).alias("values")).collect()
            for r in read:
                (found if intervals is small else edges)[r["name"]].extend(r["values"])
    raise RuntimeError("rank search did not converge")


def _around(ranks, n: int) -> list[int]:
    """Steps of the sketch grid just below and above each rank among ``n`` values."""
    slack = 2 / _ACCURACY
    near = {g for k in ranks for g in (int(max(k / n - slack, 0) * _GRID), int(min(k / n + slack, 1) * _GRID) + 1)}
    return sorted({min(g, _GRID) for g in near})


def value_places(batch: pa.RecordBatch, edges: dict[str, list[float]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per column with edges: its name, its values (null as negative infinity), which of them are there, and the edges below each value."""
    for c, bounds in edges.items():
        column = batch.column(c)
        v = pc.fill_null(column, float("-inf")).to_numpy(zero_copy_only=False)
        there = np.asarray(pc.is_valid(column)) & ~np.isnan(v)
        yield c, v, there, np.searchsorted(np.array(bounds, dtype=float), v, side="left")


def _doubles(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def _count_places(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(name, place, n, equal): values per interval, and those equal to its upper edge. A task gives a row per interval."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {c: np.zeros((2, len(b) + 1), dtype=np.int64) for c, b in edges.items()}
        for batch in batches:
            for c, v, there, place in value_places(batch, edges):
                at_edge = there & (np.append(edges[c], np.nan)[place] == v)
                for i, chosen in enumerate((there, at_edge)):
                    counts[c][i] += np.bincount(place[chosen], minlength=len(edges[c]) + 1)
        for c, (n, equal) in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"name": pa.array([c] * len(some), pa.string()), "place": pa.array(some, pa.int32()), "n": n[some], "equal": equal[some]})

    found = _doubles(df, edges).mapInArrow(run, "name string, place int, n long, equal long")
    return found.groupBy("name", "place").agg(F.sum("n").alias("n"), F.sum("equal").alias("equal"))


def _inside_places(df: DataFrame, edges: dict[str, list[float]], intervals: list[tuple]) -> DataFrame:
    """(name, place, v): the values strictly inside the given intervals."""
    wanted = {c: sorted(p for name, p, _ in intervals if name == c) for c in {i[0] for i in intervals}}
    bounds = {c: edges[c] for c in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, v, there, place in value_places(batch, bounds):
                kept = there & np.isin(place, wanted[c]) & (np.append(bounds[c], np.nan)[place] != v)
                if kept.any():
                    yield pa.RecordBatch.from_pydict({"name": pa.array([c] * int(kept.sum()), pa.string()), "place": pa.array(place[kept], pa.int32()), "v": v[kept] + 0.0})

    return _doubles(df, bounds).mapInArrow(run, "name string, place int, v double")


def _select_ranks(long: DataFrame, keys: list[str], inside: int) -> DataFrame:
    """Rows (keys, q, v) to (keys, value): the interpolated q-quantile of v, exactly."""
    # Written once: each search round reads the values, and must not compute again what they come from.
    data = durable(long.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*keys, "q", (F.col("v") + 0.0).alias("v")))
    state = durable(data.groupBy(*keys).agg(
        F.first("q").alias("q"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumn("rank", (F.col("n") - 1) * F.col("q"))
        .withColumn("k1", F.floor("rank").cast("bigint")).withColumn("k2", F.ceil("rank").cast("bigint")))
    counted = durable(_count(data, state, keys))
    for _ in range(64):
        wide = counted.where(F.col("interior") > inside)
        if wide.isEmpty():
            break
        # Sketch the bracket, take values a little below k1 and above k2, keep them only if counts agree.
        slack = 2.0 / _ACCURACY
        sketch = (join_keys(data.drop("q"), small_side(wide.drop("q")), keys).where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))
                  .groupBy(*keys).agg(F.percentile_approx(
                      "v", F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)]), _ACCURACY).alias("grid")))
        below = F.col("below") + F.col("at_lo")
        width = F.col("interior")
        lower = F.floor(F.greatest((F.col("k1") - below) / width - slack, F.lit(0.0)) * _GRID).cast("int")
        upper = F.ceil(F.least((F.col("k2") - below) / width + slack, F.lit(1.0)) * _GRID).cast("int")
        lower = F.least(lower, F.lit(_GRID))
        upper = F.greatest(upper, F.lit(0))
        proposal = join_keys(wide, sketch, keys).select(
            *keys, "q", "n", "rank", "k1", "k2",
            F.when(F.col("k1") < below, F.col("lo")).otherwise(F.element_at("grid", lower + 1)).alias("lo"),
            F.when(F.col("k2") >= below + width, F.col("hi")).otherwise(F.element_at("grid", upper + 1)).alias("hi"))
        checked = durable(_count(data, proposal, keys))
        sound = (F.col("below") <= F.col("k1")) & (
            F.col("below") + F.col("at_lo") + F.col("interior") + F.col("at_hi") > F.col("k2"))
        improved = checked.where(sound)
        kept = join_keys(counted, improved.select(*keys), keys, "left_anti")
        counted = durable(kept.unionByName(improved.select(*kept.columns)))
    else:
        raise RuntimeError("quantile bracket did not converge")
    values = (join_keys(data.drop("q"), small_side(counted.drop("q")), keys).where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))
              .groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("mid")))
    full = join_keys(counted, values, keys, "left")

    def at(k: Column) -> Column:
        offset = k - F.col("below")
        return (F.when(offset < F.col("at_lo"), F.col("lo"))
                .when(offset < F.col("at_lo") + F.col("interior"),
                      F.element_at("mid", (offset - F.col("at_lo") + 1).cast("int")))
                .otherwise(F.col("hi")))

    a, b = at(F.col("k1")), at(F.col("k2"))
    return full.select(*keys, (a + (b - a) * (F.col("rank") - F.col("k1"))).alias("value"))


_GRID = 1000


def _count(data: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    base = state.select(*keys, "q", "n", "rank", "k1", "k2", "lo", "hi")
    counts = (join_keys(data.drop("q"), small_side(base.drop("q")), keys).groupBy(*keys).agg(
        F.count_if(F.col("v") < F.col("lo")).alias("below"),
        F.count_if(F.col("v") == F.col("lo")).alias("at_lo"),
        F.count_if((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).alias("interior"),
        F.count_if((F.col("v") == F.col("hi")) & (F.col("hi") > F.col("lo"))).alias("at_hi")))
    return join_keys(base, counts, keys)
