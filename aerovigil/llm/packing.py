"""Packing by power-of-two decomposition.

A document of n tokens is split, in order, into pieces whose lengths are powers of two: as many of the largest length as fit,
then the binary digits of the rest. A piece is a sequence of its own, so no sequence crosses documents and none is padded;
equal lengths form one bucket, from which batches of one shape are drawn. Sequence ids are gapless and follow bucket by bucket.

Defined results: a null text counts as empty and gives one piece holding only the
end id; repeated rows and ids are packed one by one; texts are cut freely but never shortened; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.llm import textkit as K
from aerovigil.session import durable, small_side

LENGTH = 2048
END = 1                    #: Id that ends each document.
KNOWN_PIECES = 250_000     #: Pieces whose ids a worker remembers; beyond it the memory starts anew.
SLICE_BYTES = 2 << 20

_SIGNS_ONLY = re.compile(rb"[!-&(-/:-@\[-`{-~]+")


class Encoder:
    """Token ids of many texts at once; equal to encoding each text whole.

    The tokenizer drops white space, lower-cases, and cuts a word where letters meet other signs. So texts are cut the same way
    up front - at ASCII white space, and between a Latin letter and an ASCII sign in words without an apostrophe - and each
    distinct piece is encoded once. Pieces of letters only, or of signs only, stay one token group each, so many of them are
    encoded as one text and told apart by the tokens that end a group.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of the pieces of lower-cased bytes."""
        start, end, row = K.words(data, offsets)
        letter, sign = (data >= 97) & (data <= 122), K.SIGNS[data]
        lead = (data >= 0xC3) & (data <= 0xC5)  # two-byte letters, but for the signs of times and division
        follow = lead[:-1] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        letter[1:] |= follow
        letter[:-1] |= follow
        meet = np.flatnonzero(letter[:-1] & sign[1:] | sign[:-1] & letter[1:]) + 1
        word = np.searchsorted(start, meet, "right") - 1
        whole = np.zeros(len(start) + 1, bool)
        whole[np.searchsorted(start, np.flatnonzero(data == 39), "right") - 1] = True
        inside = (word >= 0) & ~whole[word]
        inside &= (meet > start[word]) & (meet < end[word])
        meet, word = meet[inside], word[inside]
        order = np.argsort(np.concatenate((start, meet)), kind="stable")
        return (np.concatenate((start, meet))[order], np.sort(np.concatenate((end, meet))), np.concatenate((row, row[word]))[order])

    def learn(self, new: list[bytes]) -> None:
        """Ids of pieces not met before, appended to the pool."""
        plain = [w.isalpha() or bool(_SIGNS_ONLY.fullmatch(w)) or w.decode().isalpha() for w in new]
        simple = [w for w, p in zip(new, plain) if p]
        other = [w for w, p in zip(new, plain) if not p]
        found: list[np.ndarray] = []
        words: list[bytes] = []
        for at in range(0, len(simple), 20_000):
            part = simple[at:at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part):
                self._add(part, ids, stop)
            else:  # a vocabulary with other group ends
                other += part
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            found.append(np.array(e.ids, np.uint32))
            words.append(w)
        if words:
            self._add(words, np.concatenate(found), np.cumsum([len(f) for f in found]))

    def _add(self, words: list[bytes], ids: np.ndarray, stop: np.ndarray) -> None:
        at, n = len(self.known), len(words)
        while at + n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used:self.used + len(ids)] = ids
        begin = np.concatenate(([0], stop[:-1]))
        self.first[at:at + n], self.size[at:at + n] = self.used + begin, stop - begin
        self.used += len(ids)
        self.known.update(zip(words, range(at, at + n)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of the rows in them."""
        data, offsets = K.utf8(column)
        n = len(offsets) - 1
        raw = data.tobytes()
        if any(t in raw for t in self.special):  # strings that are tokens of their own are told apart by case
            start, end, row = K.words(data, offsets)
        else:
            data = K.lower(data)
            start, end, row = self.pieces(data, offsets)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        # The pieces as an Arrow array over the same bytes with the white space cut out.
        packed = data[~K.SPACE[data]]
        bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        piece = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
        coded = pc.dictionary_encode(piece)
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        times = self.size[number].astype(np.int64)
        stop = np.cumsum(times)
        at = np.arange(stop[-1]) + np.repeat(self.first[number] - stop + times, times)
        held = np.concatenate(([0], stop))[np.searchsorted(row, np.arange(n + 1))]
        return self.pool[at], held


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that what it knows serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def lengths(total: int, most: int = LENGTH) -> list[int]:
    """Piece lengths of a document: powers of two, none above ``most``, largest first."""
    out = [most] * (total // most)
    rest = total % most
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """A row per piece, with its number within (task, length) in ``_number``."""
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    fields = [T.StructField(doc_id, docs.schema[doc_id].dataType),
              *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "_number")),
              T.StructField("_part", T.IntegerType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(tokenizer), {}, TaskContext.get().partitionId()
        for part in K.slices(batches, text, SLICE_BYTES):
            ids, held = encode(part.column(text))
            owner, rows, own = [], [], []
            for i in range(part.num_rows):
                doc = np.append(ids[held[i]:held[i + 1]], np.uint32(END)).astype("<u4")
                at = 0
                for n in lengths(len(doc), length):
                    number = seen[n] = seen.get(n, -1) + 1
                    owner.append(i)
                    rows.append((at, n, zlib.crc32(doc[at:at + n].data), len(doc), number))
                    if with_ids:
                        own.append(doc[at:at + n].astype(np.int32))
                    at += n
            columns = [part.column(doc_id).take(pa.array(owner)), *(pa.array(c, pa.int64()) for c in zip(*rows)),
                       pa.array(np.full(len(rows), task, np.int32))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.list_(pa.int32()))] if with_ids else []), schema.fieldNames())

    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): a row per piece, a sequence each.

    The pieces are written once; ids then follow from the number of pieces per task and length, a small table.
    """
    cut = durable(pieces(docs, tokenizer, length, with_ids, doc_id, text))
    held = cut.groupBy("_part", "length").agg((F.max("_number") + 1).alias("n"))
    held = held.withColumn("_block", F.floor(F.col("_part") / 1024))
    # In two steps, so that the last window has a row for 1024 tasks and a length only.
    whole = held.groupBy("length", "_block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("length", "_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.withColumn("_own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(whole, ["length", "_block"])
    first = first.select("_part", "length", (F.col("_base") + F.col("_own")).alias("_first"))
    out = cut.join(small_side(first), ["_part", "length"])
    return out.select(doc_id, "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_number")).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def batches(packed: DataFrame, size: int = 64) -> DataFrame:
    """``batch`` numbers of sequences of one length: the bucket's sequences in order, ``size`` tokens times 2048 at most."""
    first = packed.groupBy("length").agg(F.min("sequence_id").alias("_low"))
    each = F.floor(F.lit(size * LENGTH) / F.col("length"))
    return packed.join(F.broadcast(first), "length").withColumn("batch", F.floor((F.col("sequence_id") - F.col("_low")) / each)).drop("_low")
