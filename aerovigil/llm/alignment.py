"""Alignment of two tokenizers over the same bytes by divide and conquer at shared cuts.

A document's two token sequences cover the same bytes. An interval of both is divided at a common end near its middle: the end of
the token in the middle of the first sequence is looked for in the second by bisection, then its neighbours' ends at doubling
distances. Both halves are treated alike; an interval without a common end inside is a group. All intervals of a slice of documents
are divided together, a level at a time, so every step is a vectorised bisection.

Two tokens are linked where their bytes overlap, which is within a group only. A pair's count - the documents that hold it linked -
is summed over all documents in Spark. The most frequent pairs, at most ``most``, go back to the documents as a broadcast table;
all others are shuffled by pair and joined with the rest of the counts.

Defined results: null and empty texts, and those that a tokenizer does not give back byte by byte (U+2581 in them), have no tokens:
zeros and ''. Repeated rows and ids are documents of their own; texts of any length are aligned whole; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.llm import textkit as K
from aerovigil.llm import units as U
from aerovigil.llm.tokencount import frequent
from aerovigil.session import durable, small_side

KNOWN = 500_000     #: Pairs whose counts are sent to every worker.
HELD = 1_000_000    #: Distinct pairs that a task combines before it sends them on.
PAIR_ROWS = 1_000   #: Documents whose pairs are looked at together.


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers first..last of each row, and the row of each."""
    size = np.maximum(last - first + 1, 0)
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return np.arange(total) + np.repeat(first - stop + size, size), np.repeat(np.arange(len(first)), size)


def shared_cut(end_a: np.ndarray, end_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of tokens low..high-1 of the first sequence the token whose end is also an end of the second, nearest to
    the middle, and that end's token in the second; -1 where only the interval's own end is shared."""
    found, other = np.full(len(low), -1), np.full(len(low), -1)
    middle = (low + high) // 2 - 1
    left, near, far = np.arange(len(low)), 0, 0
    while len(left):
        m = middle[left]
        below, who_b = _ranges(np.maximum(low[left], m - far), m - near)
        above, who_a = _ranges(m + max(near, 1), np.minimum(high[left] - 2, m + far))
        probe, who = np.concatenate((below, above)), np.concatenate((who_b, who_a))
        at = np.searchsorted(end_b, end_a[probe])
        hit = np.flatnonzero(end_b[at] == end_a[probe])
        order = hit[np.lexsort((np.abs(probe[hit] - m[who[hit]]), who[hit]))]
        who = who[order]
        first = np.ones(len(order), bool)
        first[1:] = who[1:] != who[:-1]
        found[left[who[first]]], other[left[who[first]]] = probe[order[first]], at[order[first]]
        left = left[found[left] < 0]
        near, far = far + 1, max(1, 2 * far)
        left = left[(middle[left] - near >= low[left]) | (middle[left] + near <= high[left] - 2)]
    return found, other


def align(end_a: np.ndarray, end_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each group in both sequences, in order.

    ``end_a`` and ``end_b`` are byte ends that grow over all documents; a document is a range of tokens that ends before
    ``stop_a[i]`` and ``stop_b[i]`` and starts where the one before ended.
    """
    low_a, low_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
    some = stop_a > low_a
    now = [x[some] for x in (low_a, stop_a, low_b, stop_b)]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(now[0]):
        low_a, high_a, low_b, high_b = now
        open_ = np.flatnonzero((high_a - low_a > 1) & (high_b - low_b > 1))
        cut_a, cut_b = np.full(len(low_a), -1), np.full(len(low_a), -1)
        cut_a[open_], cut_b[open_] = shared_cut(end_a, end_b, low_a[open_], high_a[open_])
        done = cut_a < 0
        leaves.append((high_a[done] - 1, high_b[done] - 1))
        low_a, high_a, low_b, high_b, cut_a, cut_b = (x[~done] for x in (low_a, high_a, low_b, high_b, cut_a, cut_b))
        now = [np.column_stack(x).ravel() for x in ((low_a, cut_a + 1), (cut_a + 1, high_a), (low_b, cut_b + 1), (cut_b + 1, high_b))]
    if not leaves:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.sort(np.concatenate([x for x, _ in leaves])), np.sort(np.concatenate([x for _, x in leaves]))


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both tokens of each overlapping pair. Between two neighbouring ends of either sequence lies one pair, and each pair once."""
    every = np.concatenate((end_a, end_b))
    every.sort(kind="stable")  # merges two sorted runs
    if len(every):
        every = every[np.append(True, every[1:] != every[:-1])]
    return np.searchsorted(end_a, every), np.searchsorted(end_b, every)


def _joined(values: pa.Array, stops: np.ndarray, sign: str) -> pa.Array:
    """Strings of ranges that end at ``stops``, joined."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, stops), pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(sign, values.type))


def _aligned(docs: DataFrame, byte_level: str, pieces: str, doc_id: str, text: str) -> DataFrame:
    """A row per document with its counts, the digest of its groups, and its distinct linked pairs with the links of each."""
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField(doc_id, docs.schema[doc_id].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                           T.StructField("groups_sha256", T.StringType()), T.StructField("_pairs", T.ArrayType(T.LongType())),
                           T.StructField("_times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = U.held(U.Both, byte_level, pieces)
        name_a, name_b = (pa.array([str(i) for i in range(len(x))], pa.large_string()) for x in (both.a.bytes, both.b.bytes))
        base, at = np.int64(len(both.b.bytes)), TaskContext.get().partitionId() << 33
        for part in K.slices(batches, text):
            n = part.num_rows
            a, row_a, b, row_b = both(part.column(text))
            end_a, end_b = np.cumsum(both.a.length[a]), np.cumsum(both.b.length[b])
            stop_a, stop_b = (np.searchsorted(r, np.arange(n), "right") for r in (row_a, row_b))
            last_a, last_b = align(end_a, end_b, stop_a, stop_b)
            x, y = links(end_a, end_b)
            row = row_a[x]
            n_groups, n_links = np.bincount(row_a[last_a], minlength=n), np.bincount(row, minlength=n)
            shown = pc.binary_join_element_wise(_joined(name_a.take(pa.array(a)), last_a + 1, ","),
                                                _joined(name_b.take(pa.array(b)), last_b + 1, ","), pa.scalar("|", pa.large_string()))
            digest = [hashlib.sha256(s.as_buffer()).hexdigest() if s.as_py() else ""
                      for s in _joined(shown, np.cumsum(n_groups), ";").cast(pa.large_binary())]
            code = a[x] * base + b[y]
            order = np.lexsort((code, row))
            code, row = code[order], row[order]
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.empty(0, np.int64)
            bounds = pa.array(np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32))
            times = np.diff(np.append(new, len(code))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + n), pa.int64()), part.column(doc_id), pa.array(np.bincount(row_a, minlength=n)),
                 pa.array(np.bincount(row_b, minlength=n)), pa.array(n_groups), pa.array(n_links), pa.array(digest, pa.string()),
                 pa.ListArray.from_arrays(bounds, pa.array(code[new])), pa.ListArray.from_arrays(bounds, pa.array(times))],
                schema.fieldNames())
            at += n

    return docs.select(*dict.fromkeys([doc_id, text])).mapInArrow(run, schema)


def _pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, docs, best): documents that hold each pair; ``best`` where no pair of the same first id has more."""
    def emit(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate(held), return_inverse=True)
        return pair, np.bincount(at, np.concatenate(counts), len(pair)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting, seen = [], [], 0, 0
        for batch in batches:
            for part in (batch.slice(i, PAIR_ROWS) for i in range(0, batch.num_rows, PAIR_ROWS)):
                pair, count = np.unique(part.column("_pairs").flatten().to_numpy(), return_counts=True)
                held.append(pair)
                counts.append(count)
                waiting += len(pair)
                if waiting > HELD + seen:
                    pair, count = emit(held, counts)
                    held, counts, seen, waiting = [pair], [count], len(pair), len(pair)
                    if seen > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], ["pair", "docs"])
                        held, counts, seen, waiting = [], [], 0, 0
        if held:
            pair, count = emit(held, counts)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], ["pair", "docs"])

    total = durable(aligned.select("_pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    total = total.withColumn("a", F.expr(f"pair div {base}"))
    most = total.groupBy("a").agg(F.max("docs").alias("most"))  # a row per id of the first vocabulary
    return durable(total.join(small_side(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def compare(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", most: int = KNOWN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row per row of ``docs``."""
    aligned = durable(_aligned(docs, byte_level, pieces, doc_id, text))
    base = len(U.held(U.Pieces, pieces).bytes)
    counts = _pair_counts(aligned, base)
    least = frequent(counts, "docs", most)
    sent = counts.filter(F.col("docs") >= least).sort("pair").toArrow()  # at most ``most`` rows
    known = docs.sparkSession.sparkContext.broadcast(tuple(sent.column(c).to_numpy() for c in ("pair", "docs", "best")))
    out = ["_row", doc_id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = T.StructType([aligned.schema[c] for c in out] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                          T.StructField("_rest", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()),
                                                                           T.StructField("times", T.IntegerType())])))])
    rest_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs_, best = known.value
        for batch in batches:
            for part in (batch.slice(i, PAIR_ROWS) for i in range(0, batch.num_rows, PAIR_ROWS)):
                n, lists = part.num_rows, part.column("_pairs")
                pair, times = lists.flatten().to_numpy(), part.column("_times").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
                np.add.at(total, row[hit], times[hit] * docs_[at[hit]])
                rest = [None] * n
                for i, p, t in zip(row[~hit].tolist(), pair[~hit].tolist(), times[~hit].tolist()):
                    if rest[i] is None:
                        rest[i] = []
                    rest[i].append({"pair": p, "times": t})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(n_best), pa.array(total),
                                                  pa.array(rest, rest_type)], schema.fieldNames())

    found = aligned.select(*out, "_pairs", "_times").mapInArrow(run, schema)
    columns = [doc_id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rare = counts.filter(F.col("docs") < least)
    if rare.isEmpty():
        return found.select(*columns)
    found = durable(found)
    others = found.filter("_rest is not null").select("_row", F.inline("_rest")).join(rare, "pair")
    more = others.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
                                      F.sum(F.col("times") * F.col("docs")).alias("_sum"))
    found = found.join(more, "_row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
                                                          "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return found.select(*columns)
