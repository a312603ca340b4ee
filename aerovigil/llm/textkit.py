"""Vectorised text kernels shared by the operators: Arrow strings as byte arrays, word bounds, 64-bit hashes.

Every kernel works on a slice of a record batch of bounded size, so memory does not depend on batch or table size. Only a
single text longer than the slice makes a larger slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII characters that are neither letter nor digit.
SIGNS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    held = {c.lower() for c in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, kind: str = "up") -> np.ndarray:
    """The first n powers of the hash base modulo 2^64 (``down``: of its inverse)."""
    if len(_powers[kind]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of (byte + 1) * base^position over positions i..j-1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), "down")[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside ``apart`` (unless given, ASCII white space)."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    solid = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, A-Z lower-cased."""
    start, end, row = words(data, offsets, apart)
    return span_hash(prefix_hash(lower(data)), start, end), row


_TURN = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words within a row."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += word[k:k + n] * _TURN[k]
    inside = row[:n] == row[size - 1:]
    return mix(total[inside]), row[:n][inside]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct word shingles of each row; fewer words than ``size`` make one shingle, none an empty set."""
    word, row = word_hashes(data, offsets)
    grams, owner = gram_hashes(word, row, size)
    n = len(offsets) - 1
    bounds = np.searchsorted(owner, np.arange(n + 1))
    held = np.bincount(row, minlength=n)
    first = np.cumsum(held) - held
    out = []
    for i in range(n):
        if 0 < held[i] < size:
            few = word[first[i]:first[i] + held[i]]
            out.append(mix((few * _TURN[:len(few)]).sum(dtype=np.uint64, keepdims=True) + _TURN[32 + len(few) % 32]))
        else:
            out.append(np.unique(grams[bounds[i]:bounds[i + 1]]))
    return out


def to_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
