"""Frame helpers of the operators: added columns from Arrow slices, learning rows, exact connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.llm import textkit as K
from aerovigil.session import durable, small_side


def add_columns(docs: DataFrame, compute: Callable[[pa.RecordBatch], list[pa.Array]], fields: str, text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """``docs`` with columns computed from bounded Arrow slices; an added column replaces an input column of its name.

    ``keep`` names the input columns that stay (all unless given); ``compute`` sees the text and the kept columns.
    """
    added = T._parse_datatype_string(fields)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in kept] + added.fields)
    need = list(dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text):
            new = compute(part)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, [*kept, *added.fieldNames()])

    return docs.select(*need).mapInArrow(run, schema)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def learning_rows(docs: DataFrame, wanted: Column, most: int, doc_id: str = "doc_id") -> DataFrame:
    """About ``most`` of the rows that ``wanted`` allows, chosen by a hash of the id: the bounded sample a model is fitted on."""
    rows = docs.filter(wanted)
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("learn"), F.col(doc_id)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def learning_rows_by(docs: DataFrame, wanted: Column, most: int, group: str, doc_id: str = "doc_id") -> DataFrame:
    """About ``most`` of the rows that ``wanted`` allows, with a share for every value of ``group``, chosen by a hash of the id.

    All rows of the rarest values, and about equally many of each other value. Every value keeps at least one row, so more values
    than ``most`` give a row each.
    """
    rows = docs.filter(wanted)
    dice = F.pmod(F.xxhash64(F.lit("learn"), F.col(doc_id)), F.lit(1_000_000_000))
    place = F.struct(dice.alias("dice"), F.col(doc_id).alias("id"))
    held = durable(rows.groupBy(group).agg(F.count("*").alias("count"), F.min(place).alias("_first")))  # a row per value
    if (held.agg(F.sum("count")).first()[0] or 0) <= most:
        return rows
    left, groups, share = most, held.count(), 0.0
    while groups:  # values that fit within the equal share leave the rest of theirs to the others
        share = left / groups
        small = held.filter(F.col("count") <= share).agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
        if most - small[1] == left:
            break
        left, groups = most - small[1], held.count() - small[0]
    rate = held.select(group, (F.lit(float(share)) / F.col("count")).alias("_rate"), "_first")
    kept = rows.join(small_side(rate), group).filter((dice < 1e9 * F.col("_rate")) | (place == F.col("_first")))
    return kept.select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is the smallest node reachable.

    Alternates large-star and small-star steps, each a minimum per node and a join, until no edge changes. Minima are partially
    aggregated and the joins can be split by skew handling, so a node with very many edges does not load one task. The number
    of rounds grows with the logarithm of the longest chain.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(30,0)"))).first())

    seen = mark(now)
    while seen[0]:
        pairs = both(now)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = durable(small.filter("a <> b").distinct())
        after = mark(now)
        if after == seen:
            break
        seen = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def bit_filter(keys: DataFrame, column: str, bits: int) -> bytes:
    """A bit map of 2^bits bits, packed, set where the low bits of a long column fall; its size does not grow with ``keys``."""
    width = bits - 6

    def mark(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << width, bool)
        for part in parts:
            flags[part.column("at").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(flags).tobytes()])],
                                         ["block", "flags"])

    low = keys.select(F.col(column).bitwiseAND((1 << bits) - 1).alias("low")).distinct()
    at = low.select(F.shiftright("low", width).cast("int").alias("block"), F.col("low").bitwiseAND((1 << width) - 1).alias("at"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in at.groupBy("block").applyInArrow(mark, "block int, flags binary").collect():
        out[r.block << (width - 3):(r.block + 1) << (width - 3)] = np.frombuffer(r.flags, np.uint8)
    return out.tobytes()


def in_filter(rows: DataFrame, column: str, bits: int, sent, inside: bool) -> DataFrame:
    """Rows whose long ``column`` falls on a set bit of the broadcast map ``sent``, or those that do not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(flags[batch.column(column).to_numpy() & ((1 << bits) - 1)] == inside))

    return rows.mapInArrow(run, rows.schema)
