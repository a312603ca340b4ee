"""Token counts by pre-token: pieces are counted once per distinct pre-token and joined to each document's own frequencies.

1. One pass cuts the texts into pre-tokens (``units``: white space with the word behind it) and counts each distinct one, combined
   within tasks before the shuffle.
2. Every distinct pre-token is given to the tokenizer once, in the tasks that hold it: the lexicon, written as a table.
3. A second pass takes each document's pre-token frequencies. The lexicon's most frequent entries - at most ``most`` rows and
   ``MOST_BYTES`` bytes, chosen by their count - are joined where the text is read, so hot pre-tokens never travel; all others are
   shuffled by pre-token and joined with the rest of the lexicon. The sum of times x pieces is the count; no ids are kept.

A pre-token is a key of that join only when it is rare, so no task holds a hot one.

Defined results: a null or empty text has no tokens; repeated rows and ids are counted row by row; U+2581 counts as the blank that the
tokenizer takes it for; texts of any length are counted whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
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
from aerovigil.session import durable

LIMIT = 4096
KNOWN = 200_000              #: Lexicon entries that are sent to every worker.
MOST_BYTES = 8_000_000       #: Bytes of these entries.
HELD = 200_000               #: Distinct pre-tokens that a task combines before it sends them on.


def pretokens(column: pa.Array, pieces: U.Pieces) -> tuple[pa.DictionaryArray | None, np.ndarray]:
    """The pre-tokens of all texts, dictionary-encoded, and the row of each."""
    plain = pc.replace_substring(pc.fill_null(column, ""), U.SIGN, " ")
    data, offsets = K.utf8(U.with_blank(plain))
    start, end, row = U.cut(data, offsets, pieces.starts)
    if not len(start):
        return None, row
    start, end, row = pieces.split_long(data, start, end, row)
    return pc.dictionary_encode(U.spans(data, start, end)), row


def distinct(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(pre_token, times) of the whole table."""
    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["pre_token", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = U.held(U.Pieces, model), Counter()
        for part in K.slices(batches, text):
            coded, _ = pretokens(part.column(text), pieces)
            if coded is None:
                continue
            held.update(dict(zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist())))
            if len(held) > HELD:
                yield emit(held)
                held = Counter()
        if held:
            yield emit(held)

    return docs.select(text).mapInArrow(run, "pre_token binary, times long").groupBy("pre_token").agg(F.sum("times").alias("times"))


def lexicon(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(pre_token, times, pieces): each distinct pre-token of the table with its number of pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = U.held(U.Pieces, model)
        for batch in batches:
            for part in K.slices(iter([batch]), "pre_token"):
                found = pieces.encode([u.decode() for u in part.column("pre_token").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) for x in found], pa.int32())], ["pre_token", "times", "pieces"])

    return durable(distinct(docs, model, text).mapInArrow(run, "pre_token binary, times long, pieces int"))


def frequent(table: DataFrame, times: str, most: int, weight: str = "1", most_weight: int = 1 << 62) -> int:
    """The smallest power of two such that at most ``most`` rows, of at most ``most_weight``, have ``times`` at or above it."""
    level = F.floor(F.log2(F.col(times))).cast("int")
    held = table.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.expr(weight)).alias("w")).collect()  # 63 rows at most
    least, rows, total = 63, 0, 0
    for r in sorted(held, key=lambda r: -r.level):
        rows, total = rows + r.n, total + r.w
        if rows > most or total > most_weight:
            break
        least = r.level
    return 1 << least if least < 63 else (1 << 63) - 1


def count(docs: DataFrame, model: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", most: int = KNOWN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row per row of ``docs``."""
    words = lexicon(docs, model, text)
    least = frequent(words, "times", most, "octet_length(pre_token)", MOST_BYTES)
    sent = {bytes(r.pre_token): r.pieces for r in words.filter(F.col("times") >= least).select("pre_token", "pieces").collect()}
    known = docs.sparkSession.sparkContext.broadcast(sent)
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField(doc_id, docs.schema[doc_id].dataType),
                           T.StructField("n_bytes", T.LongType()), T.StructField("_known", T.LongType()),
                           T.StructField("_rest", T.ArrayType(T.StructType([T.StructField("pre_token", T.BinaryType()),
                                                                            T.StructField("times", T.LongType())])))])
    rest_type = pa.list_(pa.struct([("pre_token", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, at = U.held(U.Pieces, model), TaskContext.get().partitionId() << 33
        for part in K.slices(batches, text):
            n = part.num_rows
            total, rest = np.zeros(n, np.int64), [None] * n
            coded, row = pretokens(part.column(text), pieces)
            if coded is not None:
                names = coded.dictionary.to_pylist()
                size = np.fromiter((known.value.get(u, -1) for u in names), np.int64, len(names))
                index = coded.indices.to_numpy()
                each = size[index]
                total += np.bincount(row, np.maximum(each, 0), n).astype(np.int64)
                rare = np.flatnonzero(each < 0)
                pair, times = np.unique(row[rare] * len(names) + index[rare], return_counts=True)
                for p, t in zip(pair.tolist(), times.tolist()):
                    i, u = divmod(p, len(names))
                    if rest[i] is None:
                        rest[i] = []
                    rest[i].append({"pre_token": names[u], "times": t})
            size = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64()), part.column(doc_id), size, pa.array(total),
                                              pa.array(rest, rest_type)], schema.fieldNames())
            at += n

    found = durable(docs.select(*dict.fromkeys([doc_id, text])).mapInArrow(run, schema))
    total = F.col("_known")
    others = found.filter("_rest is not null").select("_row", F.inline("_rest"))
    if not others.isEmpty():
        joined = others.join(words.filter(F.col("times") < least).select("pre_token", "pieces"), "pre_token")
        added = joined.groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("_more"))
        found = found.join(added, "_row", "left")
        total = total + F.coalesce("_more", F.lit(0))
    return found.select(doc_id, "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
