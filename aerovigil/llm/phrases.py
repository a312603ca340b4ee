"""Frequent phrases and their collocation score by Rabin-Karp fingerprints.

1. Each slice's words are laid out with one blank between them. The fingerprint of a run of words within a piece is a difference of
   two values of one prefix polynomial, mixed with the language and the number of words. Level by level - one word, two, and so on -
   tasks add up equal fingerprints before the shuffle, which adds up the whole table; those with ``least`` occurrences or more are
   kept as a bit map (sized by their number, 8 MB at most). The next level takes only runs whose two shorter runs are on the map, so
   the many runs that cannot be frequent are never exchanged. A frequent phrase has frequent parts and a frequent fingerprint, so
   none is lost.
2. A last pass looks the runs up in the maps. For those found it follows a pointer to one occurrence, compares the text of every
   other occurrence with the text there, and gives occurrences that differ a pointer of their own. Only these phrases are
   materialised; the shuffle adds them up by text. Two phrases that share a fingerprint, and false hits of a map, are thus told apart
   by their text and counted exactly.
3. Parts, containing phrases and scores are joins of the table of frequent phrases. Every part of a frequent phrase is frequent
   itself. Scores use 38-digit decimals.

Counts are summed by whole phrase, so a hot word is one row per task. Joins by phrase part are plain shuffles whose skewed side Spark
may split, or broadcasts after a check of their size.

Defined results: a null text is empty and has no words; a null language is ``und``; repeated rows count again; a text without words adds
nothing; ties are ordered by occurrences, then by the phrase's bytes; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.llm import textkit as K
from aerovigil.llm.frames import bit_filter
from aerovigil.session import durable, small_side

LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
HELD = 600_000                  #: Distinct fingerprints that a task combines before it sends them on.
PARTS = 8                       #: Parts of a language that are ranked by themselves first.
FILTER_BITS = (16, 26)          #: Bounds of the bit map's size: 8 KB to 8 MB.
NO_LANGUAGE = "und"

_APART = np.zeros(256, bool)
_APART[[9, 32]] = True
_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True


class Slice:
    """The words of a slice of rows laid out with one blank between them, and the fingerprints of their runs."""

    def __init__(self, part: pa.RecordBatch, text: str, lang: str | None):
        data, offsets = K.utf8(part.column(text))
        data = K.lower(data)
        start, end, row = K.words(data, offsets, _APART | _PIECE)
        n = end - start
        self.row, self.n_rows = row, part.num_rows
        self.start = np.cumsum(n + 1) - n - 1      # of each word in the new layout
        self.end = self.start + n
        keep = ~(_APART | _PIECE)[data]
        self.data = np.full(int(self.end[-1]) + 1 if len(n) else 0, 32, np.uint8)
        at = np.ones(len(self.data), bool)
        at[self.end] = False
        self.data[at] = data[keep]
        self.piece = np.searchsorted(np.flatnonzero(_PIECE[data]), start) + row  # grows from piece to piece and from row to row
        self.prefix = K.prefix_hash(self.data)
        names = pa.array([NO_LANGUAGE] * self.n_rows) if lang is None else pc.fill_null(part.column(lang), NO_LANGUAGE)
        coded = pc.dictionary_encode(names.cast(pa.large_string()))
        self.names = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[row] if len(row) else np.empty(0, np.int64)
        bytes_, bounds = K.utf8(coded.dictionary)
        self.turn = K.mix(K.span_hash(K.prefix_hash(bytes_), bounds[:-1], bounds[1:]) + np.uint64(1))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of ``size`` words within a piece, and the run's fingerprint."""
        n = len(self.start) - size + 1
        first = np.flatnonzero(self.piece[:max(n, 0)] == self.piece[size - 1:]) if n > 0 else np.empty(0, np.int64)
        if not len(first):
            return first, np.empty(0, np.uint64)
        span = K.span_hash(self.prefix, self.start[first], self.end[first + size - 1])
        return first, K.mix(span + self.turn[self.lang[first]] * np.uint64(2 * size + 1))

    def texts(self, first: np.ndarray, size: int) -> pa.Array:
        """The text of runs that start at the given words."""
        start, end = self.start[first], self.end[first + size - 1]
        long = end - start
        bounds = np.append(0, np.cumsum(long))
        at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], long)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(self.data[at])])


def hits(packed: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the low bits of each key are set in a packed bit map."""
    low = (key & np.uint64(8 * len(packed) - 1)).astype(np.int64)
    return (packed[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)


def fingerprints(docs: DataFrame, size: int, shorter, lang: str | None, text: str) -> DataFrame:
    """(print, times) of the runs of ``size`` words whose two runs of one word less are on the broadcast map ``shorter``."""
    def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, waiting, seen = [], [], 0, 0
        for part in K.slices(batches, text):
            words = Slice(part, text, lang)
            first, key = words.runs(size)
            if shorter is not None:
                begin, less = words.runs(size - 1)
                often = np.zeros(len(words.start) + 1, bool)
                often[begin] = hits(np.frombuffer(shorter.value, np.uint8), less)
                key = key[often[first] & often[first + 1]]
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n.astype(np.int64))
            waiting += len(key)
            if waiting > seen + HELD:
                key, n = merged(keys, times)
                keys, times, seen, waiting = [key], [n], len(key), len(key)
                if seen > HELD:
                    yield pa.RecordBatch.from_arrays([K.to_long(key), pa.array(n)], ["print", "times"])
                    keys, times, seen, waiting = [], [], 0, 0
        if keys:
            key, n = merged(keys, times)
            yield pa.RecordBatch.from_arrays([K.to_long(key), pa.array(n)], ["print", "times"])

    columns = [text] if lang is None else list(dict.fromkeys([text, lang]))
    found = docs.select(*columns).mapInArrow(run, "print long, times long")
    return found.repartition("print").groupBy("print").agg(F.sum("times").alias("times"))  # tasks have added up their own


def _occurrences(docs: DataFrame, maps: list, lang: str | None, text: str, doc_id: str) -> DataFrame:
    """(lang, size, phrase, f, example) per slice for runs whose fingerprint is on the map; size 0 counts all words of the slice."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("phrase", T.StringType()),
                           T.StructField("f", T.LongType()), T.StructField("example", docs.schema[doc_id].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text):
            words = Slice(part, text, lang)
            names, ids = pa.array(words.names, pa.string()), part.column(doc_id)
            total = np.bincount(words.lang, minlength=len(words.names))
            out = [(np.arange(len(names)), 0, pa.array([""] * len(names), pa.string()), total, pa.nulls(len(names), ids.type))]
            for size, sent in enumerate(maps, 1):
                first, key = words.runs(size)
                hit = hits(np.frombuffer(sent.value, np.uint8), key)
                first, key = first[hit], key[hit]
                while len(first):
                    _, at, group = np.unique(key, return_index=True, return_inverse=True)  # ``at`` points to one occurrence of each
                    shown = words.texts(first, size)
                    same = pc.equal(shown, shown.take(pa.array(at[group]))).to_numpy(zero_copy_only=False)
                    same &= words.lang[first] == words.lang[first[at[group]]]
                    out.append((words.lang[first[at]], size, shown.take(pa.array(at)).cast(pa.string()),
                                np.bincount(group[same], minlength=len(at)), ids.take(pa.array(words.row[first[at]]))))
                    first, key = first[~same], key[~same]
            for code, size, shown, times, example in out:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(code)), pa.array(np.full(len(code), size, np.int32)), shown,
                                                  pa.array(times.astype(np.int64)), example], schema.fieldNames())

    columns = [doc_id, text] if lang is None else [doc_id, text, lang]
    return docs.select(*dict.fromkeys(columns)).mapInArrow(run, schema)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang: str | None = "lang", text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """(lang, size, phrase, f, example) of all runs of 1 to ``longest`` words with ``least`` occurrences or more.

    ``example`` names a document that holds the phrase. A row of size 0 per language has the number of all its words.
    """
    maps: list = []
    for size in range(1, longest + 1):
        prints = fingerprints(docs, size, maps[-1] if maps else None, lang, text)
        often = durable(prints.filter(F.col("times") >= least).select("print"))
        bits = min(max(FILTER_BITS[0], (16 * often.count()).bit_length()), FILTER_BITS[1])
        maps.append(docs.sparkSession.sparkContext.broadcast(bit_filter(often, "print", bits)))
    held = _occurrences(docs, maps, lang, text, doc_id)
    found = held.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"), F.min("example").alias("example"))
    return durable(found.filter((F.col("f") >= least) | (F.col("size") == 0)))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP,
                 lang: str | None = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, example): each language's best phrases of two or more words.

    A phrase is cut in two wherever the score ``floor(1000000 a a / (l r))`` is lowest, and dropped if it stands inside a longer phrase
    that has at least ``covered`` percent of its occurrences.
    """
    held = frequent_phrases(docs, least, longest, lang, text, doc_id)
    counts = held.filter("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    phrases = held.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), "example")

    # A longer phrase covers a shorter one through a chain of phrases, each one word longer, whose counts only fall; so each phrase
    # needs the largest count of the phrases one word longer alone.
    ends = F.array(F.slice(words, F.lit(1), F.col("size") - 1), F.slice(words, F.lit(2), F.col("size") - 1))
    inside = phrases.filter("size > 2").select("lang", F.explode(ends).alias("part"), "a")
    inside = inside.select("lang", F.array_join("part", " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    phrases = phrases.join(inside, ["lang", "phrase"], "left")
    phrases = phrases.filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")

    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
                           "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    counts = small_side(counts)
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])

    score = F.expr("(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0)))"
                   " div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))").cast("long")
    cut = cut.withColumn("score", score)
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("example").alias("example"), lowest)
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "example")
    # First within parts of a language, so that the last window gets ``PARTS`` times ``top`` rows of it at most.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(PARTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    total = held.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(small_side(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                                                       "example")
