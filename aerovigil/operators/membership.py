"""Bloom filter as a table of bit blocks; build and probe are group-bys and joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.session import small_side


@dataclass(frozen=True)
class BloomShape:
    bits: int
    hashes: int
    capacity: int
    error_rate: float

    @staticmethod
    def for_capacity(capacity: int = 10_000, error_rate: float = 0.01) -> BloomShape:
        bits = max(1, int(-capacity * math.log(error_rate) / math.log(2) ** 2))
        return BloomShape(bits, max(1, round(bits / capacity * math.log(2))), capacity, error_rate)


def shape_for(df: DataFrame, item: str, least: BloomShape) -> BloomShape:
    """``least``, or a shape of its error rate for all distinct items of ``df`` when they are more than it is made for."""
    n = df.where(F.col(item).isNotNull()).select(item).distinct().count()
    return least if n <= least.capacity else BloomShape.for_capacity(n, least.error_rate)


def _hex_mod(digest: Column, digits: int, modulus: int) -> Column:
    """A hexadecimal number modulo ``modulus``, sixteen bits at a time."""
    out = F.lit(0).cast("bigint")
    for start in range(1, digits + 1, 4):
        part = F.conv(F.substring(digest, start, 4), 16, 10).cast("bigint")
        out = F.pmod(out * 65536 + part, F.lit(modulus).cast("bigint"))
    return out


def bit_positions(item: Column, shape: BloomShape) -> Column:
    """The bits of an item by double hashing: (md5 + i * sha1) mod bits."""
    text = item.cast("string")
    first, second = _hex_mod(F.md5(text), 32, shape.bits), _hex_mod(F.sha1(text), 40, shape.bits)
    return F.array(*[F.pmod(first + second * i, F.lit(shape.bits).cast("bigint")) for i in range(shape.hashes)])


# Spark's bitmap functions number from 1, and put 0 into a block of its own; bits number from 0.
_BLOCK, _OFFSET = "bitmap_bucket_number(bit + 1)", "bitmap_bit_position(bit + 1)"


def build(df: DataFrame, item: str, shape: BloomShape) -> DataFrame:
    """(block, bitmap): blocks of 32,768 bits, the first is 1. Items are made distinct first, so repeats cost nothing."""
    bits = (df.select(F.col(item).alias("item")).where(F.col("item").isNotNull()).distinct()
            .select(F.explode(bit_positions(F.col("item"), shape)).alias("bit")))
    return (bits.groupBy(F.expr(_BLOCK).alias("block"))
            .agg(F.expr(f"bitmap_construct_agg({_OFFSET})").alias("bitmap")))


def build_by(df: DataFrame, keys: list[str], item: str, shape: BloomShape) -> DataFrame:
    """(keys, block, bitmap): a filter per key, for instance per time window. Filters of one shape merge by ``merge``."""
    bits = (df.select(*keys, F.col(item).alias("item")).where(F.col("item").isNotNull()).distinct()
            .select(*keys, F.explode(bit_positions(F.col("item"), shape)).alias("bit")))
    return (bits.groupBy(*keys, F.expr(_BLOCK).alias("block"))
            .agg(F.expr(f"bitmap_construct_agg({_OFFSET})").alias("bitmap")))


def merge(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The filter of everything that the given filters hold, per key or as a whole: their bitmaps or-ed, no item is read again."""
    return blocks.groupBy(*(keys or []), "block").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))


def summary_by(df: DataFrame, keys: list[str], item: str, shape: BloomShape) -> DataFrame:
    """``summary`` per key."""
    return _described(df.groupBy(*keys).agg(F.count(item).alias("items_added")), shape, keys)


def probe(df: DataFrame, item: str, blocks: DataFrame, shape: BloomShape) -> DataFrame:
    """(item, maybe_present) for every distinct item of ``df``."""
    items = df.select(F.col(item).alias("item")).where(F.col("item").isNotNull()).distinct()
    asked = items.select("item", F.explode(bit_positions(F.col("item"), shape)).alias("bit")).withColumns({
        "block": F.expr(_BLOCK), "offset": F.expr(_OFFSET)})
    # At most bits / 32768 blocks of 4 KiB; broadcast only while there are few.
    joined = asked.join(small_side(blocks, 2_000), "block", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("offset") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte.cast("bigint"), (F.col("offset") % 8).cast("int")).cast("int"), F.lit(0))
    return joined.groupBy("item").agg((F.sum(is_set) == shape.hashes).alias("maybe_present"))


def summary(df: DataFrame, item: str, shape: BloomShape) -> DataFrame:
    """Shape, items added (repeats included) and the expected false-positive rate."""
    return _described(df.agg(F.count(item).alias("items_added")), shape, [])


def _described(added: DataFrame, shape: BloomShape, keys: list[str]) -> DataFrame:
    rate = F.pow(1 - F.exp(-shape.hashes * F.col("items_added") / shape.bits), F.lit(shape.hashes))
    return added.select(*keys, F.lit(shape.capacity).alias("capacity"), F.lit(shape.error_rate).alias("error_rate"),
                        F.lit(shape.bits).alias("m_bits"), F.lit(shape.hashes).alias("k_hashes"), "items_added",
                        F.when(F.col("items_added") == 0, F.lit(0.0)).otherwise(F.round(rate, 6)).alias("estimated_fpr"),
                        F.lit(math.ceil(shape.bits / 8)).alias("memory_bytes"))
