"""Benchmark decontamination: a BM25 inverted index of the test items, asked with every passage of every training text.

Index: postings (term, item, impact) with BM25 impacts divided by the item's score for itself, so a score is the weighted share
of the item that a passage holds. Items lie in blocks; each term keeps its largest impact per block.

Query: passages are overlapping windows of words, long enough that any item lies whole in one. Their width follows from the item's
own length (its power-of-two class) alone, so what is found of an item does not depend on the other items. Terms so common that together
they stay below the threshold only add to a bound. For the other terms the block maxima are summed per (passage, block);
blocks that cannot reach the threshold are skipped, as in block-max WAND, and only the postings of the rest are read. All
items at or above the threshold are returned. A hit counts if the passage also holds enough of the item's question (word
three-grams) and of its answer (terms).

Items without ``question`` and ``answer`` columns: the answer is the last sentence, the question all before it (the whole item
where fewer than ``QUESTION_WORDS`` words come before).

Defined results: null or empty texts and items hit nothing; a text is searched whole; repeated rows and items are each
reported; equal scores are all returned; with no items nothing is a hit; an added or kept column of a clashing name is the
input's own. The index is sent out in portions of about ``ITEMS`` items, one after the other; the statistics are those of all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.llm import textkit as K
from aerovigil.session import durable

ITEMS = 20_000      #: Items in one broadcast index.
BLOCK = 16          #: Items whose impacts share one maximum.
K1, B = 1.2, 0.75
THRESHOLD = 0.5     #: Least share of an item's own BM25 score.
QUESTION = 0.5      #: Least share of the question's three-grams.
ANSWER = 0.5        #: Least share of the answer's terms.
GRAM = 3
QUESTION_WORDS = 6  #: A question split off an item has at least so many words.


@dataclass
class Index:
    """CSR arrays over sorted term hashes; ``heavy`` terms are looked up, ``light`` ones only bounded until the exact score."""

    ids: list
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    heavy: np.ndarray
    rest: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    block_from: np.ndarray
    block_to: np.ndarray
    block_rest: np.ndarray
    question: list[tuple[int, np.ndarray]]
    answer: list[np.ndarray]
    window: int


def _terms(texts: list[str]) -> list[np.ndarray]:
    data, offsets = K.utf8(lowered(pa.array(texts, pa.string())))
    word, row = K.word_hashes(data, offsets, K.SIGNS)
    return np.split(word, np.searchsorted(row, np.arange(1, len(texts))))


def _grams(word: np.ndarray, size: int) -> np.ndarray:
    return np.unique(K.gram_hashes(word, np.zeros(len(word), np.int64), max(1, size))[0])


def lowered(column: pa.Array) -> pa.Array:
    """Unicode lower case: passages are often found in capitals."""
    return pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _parts(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text) if re.search(r"\w", s)]
    asked = " ".join(sentences[:-1])
    return (asked if len(asked.split()) >= QUESTION_WORDS else text, sentences[-1] if sentences else text)


def postings(items: DataFrame, text: str = "_text") -> DataFrame:
    """(term, item, tf, length) of every item, counted by Spark tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text):
            data, offsets = K.utf8(lowered(part.column(text)))
            word, row = K.word_hashes(data, offsets, K.SIGNS)
            order = np.lexsort((word, row))
            word, row = word[order], row[order]
            new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])))) if len(word) else np.empty(0, np.int64)
            length = np.bincount(row, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [K.to_long(word[new]), part.column("_item").take(pa.array(row[new])), pa.array(np.diff(np.append(new, len(word)))),
                 pa.array(length[row[new]])], ["term", "item", "tf", "length"])

    return items.select("_item", text).mapInArrow(run, "term long, item long, tf long, length long")


def build(rows: list, posted, threshold: float, passage: int) -> Index:
    """Index of items searched in passages of one width: ``rows`` of (_item, id, text, question, answer) and their postings with impacts."""
    number = {r["_item"]: i for i, r in enumerate(rows)}
    item = np.array([number[i] for i in posted["item"].to_pylist()], np.int64)
    term = np.array(posted["term"].to_pylist(), np.int64).view(np.uint64)
    impact = np.array(posted["impact"].to_pylist(), float)
    own = np.bincount(item, impact, len(rows))
    impact = impact / np.maximum(own[item], 1e-12)
    order = np.lexsort((item, term))
    item, term, impact = item[order], term[order], impact[order]
    terms, start, size = np.unique(term, return_index=True, return_counts=True)
    top = np.maximum.reduceat(impact, start) if len(term) else np.empty(0)
    rank = np.argsort(top, kind="stable")
    light = np.zeros(len(terms), bool)
    light[rank[np.cumsum(top[rank]) < threshold / 2]] = True
    heavy = ~light
    rest = np.bincount(item, impact * light[np.repeat(np.arange(len(terms)), size)], len(rows))
    # Ranges of equal (term, block) within the postings.
    owner = np.repeat(np.arange(len(terms)), size)
    key = owner * (len(rows) // BLOCK + 1) + item // BLOCK
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    block_rest = np.zeros(len(rows) // BLOCK + 1)
    np.maximum.at(block_rest, np.arange(len(rows)) // BLOCK, rest)
    parts = [(r["question"], r["answer"]) if r["question"] or r["answer"] else _parts(r["text"] or "") for r in rows]
    asked = _terms([q or a or "" for q, a in parts])
    size = [min(GRAM, len(w)) for w in asked]
    question = list(zip(size, map(_grams, asked, size)))
    answer = [np.unique(w) for w in _terms([a or q or "" for q, a in parts])]
    return Index([r["id"] for r in rows], terms, np.append(start, len(term)), item, impact, heavy, rest,
                 np.searchsorted(owner[first], np.arange(len(terms) + 1)), item[first] // BLOCK,
                 np.maximum.reduceat(impact, first) if len(first) else np.empty(0), first, np.append(first[1:], len(key)), block_rest,
                 question, answer, passage)


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges start..stop: the number of the range and the position, for each position in it."""
    n = stop - start
    owner = np.repeat(np.arange(len(start)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(value, first)


def search(index: Index, column: pa.Array, threshold: float = THRESHOLD) -> list[tuple[int, int, float, int, int]]:
    """(row, item number, score, first and last word) of every passage and item at or above the threshold."""
    data, offsets = K.utf8(lowered(column))
    word, row = K.word_hashes(data, offsets, K.SIGNS)
    return _search(index, word, row, len(offsets) - 1, threshold)


def _search(index: Index, word, row, n, threshold):
    if not len(word) or not len(index.terms):
        return []
    at = np.searchsorted(index.terms, word)
    at[at == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[at] == word)
    term, owner = at[known], row[known]
    base = np.searchsorted(row, np.arange(n + 1))
    place = known - base[owner]
    found = []
    for shift in (0, index.window // 2):
        width = (place + shift) // index.window
        most = int(width.max()) + 1 if len(width) else 1
        passage = owner * most + width
        pair = np.unique(passage * len(index.terms) + term)
        passage, term_in = pair // len(index.terms), pair % len(index.terms)
        use = index.heavy[term_in]
        p, t = passage[use], term_in[use]
        # Block maxima summed per (passage, block).
        who, pos = _expand(index.block_start[t], index.block_start[t + 1])
        blocks = len(index.block_rest)
        key, bound = _sums(p[who] * blocks + index.block[pos], index.block_max[pos])
        live = key[bound + index.block_rest[key % blocks] >= threshold - 1e-9]
        if not len(live):
            continue
        mine = p[who] * blocks + index.block[pos]
        where = np.searchsorted(live, mine)
        where[where == len(live)] = 0
        ok = live[where] == mine
        who, pos = who[ok], pos[ok]
        again, post = _expand(index.block_from[pos], index.block_to[pos])
        items = len(index.ids)
        key, score = _sums(p[who][again] * items + index.item[post], index.impact[post])
        near = score + index.rest[key % items] >= threshold - 1e-9
        for k, s in zip(key[near].tolist(), score[near].tolist()):
            passage_no, i = divmod(k, items)
            lo, hi = np.searchsorted(passage, [passage_no, passage_no + 1])
            for t1 in term_in[lo:hi][~index.heavy[term_in[lo:hi]]]:  # the exact score: what the light terms add
                a, b = index.start[t1], index.start[t1 + 1]
                j = a + np.searchsorted(index.item[a:b], i)
                if j < b and index.item[j] == i:
                    s += float(index.impact[j])
            if s >= threshold - 1e-9:
                r, w = divmod(passage_no, most)
                first = max(0, w * index.window - shift)
                last = min(int(base[r + 1] - base[r]), (w + 1) * index.window - shift)
                found.append((r, i, s, first, last))
    return found


def hits(index: Index, column: pa.Array, threshold: float, question: float, answer: float) -> dict[tuple[int, int], list[float]]:
    """(row, item number) to score, question share and answer share, for verified hits: the best passage of each."""
    data, offsets = K.utf8(lowered(column))
    return _hits(index, *K.word_hashes(data, offsets, K.SIGNS), len(offsets) - 1, threshold, question, answer)


def _hits(index: Index, word, row, n, threshold, question, answer):
    base = np.searchsorted(row, np.arange(n + 1))
    out: dict[tuple[int, int], list[float]] = {}
    for r, i, score, first, last in _search(index, word, row, n, threshold):
        held = word[base[r] + first:base[r] + last]
        (size, asked), told = index.question[i], index.answer[i]
        q = np.isin(asked, _grams(held, size)).mean() if len(asked) else 0.0
        a = np.isin(told, held).mean() if len(told) else 0.0
        if q >= question and a >= answer:
            best = out.setdefault((r, i), [0.0, 0.0, 0.0])
            out[r, i] = [max(best[0], score), max(best[1], float(q)), max(best[2], float(a))]
    return out


def found_in(portion: list[Index], column: pa.Array, threshold: float, question: float, answer: float) -> list[tuple]:
    """(row, item id, score, question share, answer share) of every hit of a portion's items."""
    data, offsets = K.utf8(lowered(column))
    word, row = K.word_hashes(data, offsets, K.SIGNS)
    return [(r, index.ids[i], *values) for index in portion
            for (r, i), values in _hits(index, word, row, len(offsets) - 1, threshold, question, answer).items()]


def portions(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD, passage: int = 64,
             portion: int = ITEMS) -> Iterator[list[Index]]:
    """Indexes of one portion of the items after the other, an index per passage width, with the statistics of all items."""
    parts = [F.col(c) if c in items.columns else F.lit(None).cast("string") for c in ("question", "answer")]
    whole = F.col(text) if text in items.columns else F.concat_ws("\n", *parts)
    rows = durable(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id).alias("id"), whole.alias("_text"),
                                parts[0].alias("question"), parts[1].alias("answer")))
    posted = postings(rows)
    stats = posted.select("item", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not stats.n:
        return
    often = posted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / stats.mean))
    posted = durable(posted.join(often, "term").select("term", "item", "length", impact.alias("impact")))
    count = -(-stats.n // portion)
    for k in range(count):  # one portion at a time: about ``portion`` items reach the driver
        mine = F.pmod(F.hash(F.lit(7), F.col("_item")), F.lit(count)) == k
        some = rows.filter(mine).select("_item", "id", F.col("_text").alias("text"), "question", "answer").orderBy("id", "_item").collect()
        got = posted.filter(F.pmod(F.hash(F.lit(7), F.col("item")), F.lit(count)) == k).toArrow()
        length = dict(zip(got["item"].to_pylist(), got["length"].to_pylist()))
        width = {i: max(passage, 2 << (n - 1).bit_length()) for i, n in length.items()}
        each = np.array([width[i] for i in got["item"].to_pylist()], np.int64)
        yield [build([r for r in some if width.get(r["_item"]) == w], got.filter(pa.array(each == w)), threshold, w)
               for w in sorted(set(width.values()))]


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD, passage: int = 64,
            portion: int = ITEMS) -> list[Index]:
    return [index for some in portions(items, item_id, text, threshold, passage, portion) for index in some]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
          threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, portion: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each document row and item found in it."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType),
                           *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    spark, done = docs.sparkSession, []

    def search_with(some: list[Index]) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in K.slices(batches, text):
                found = found_in(sent.value, part.column(text), threshold, question, answer)
                if found:
                    row, named, *values = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays([part.column(doc_id).take(pa.array(row, pa.int64())), pa.array(named), *map(pa.array, values)],
                                                     schema.fieldNames())

        return docs.select(doc_id, text).mapInArrow(run, schema), sent

    held = None
    for some in portions(items, item_id, text, threshold, portion=portion):
        if held is not None:  # more than one portion: each is searched, written and let go before the next is built
            done.append(durable(held[0]))
            held[1].destroy()
        held = search_with(some)
    out = spark.createDataFrame([], schema) if held is None else held[0]
    for part in done:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD,
          question: float = QUESTION, answer: float = ANSWER, portion: int = ITEMS) -> DataFrame:
    """``docs`` without the rows that hold a test item; one pass per portion of items, no shuffle."""
    sent = None
    for some in portions(items, item_id, text, threshold, portion=portion):
        if sent is not None:
            docs = durable(docs)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in K.slices(batches, text):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in found_in(sent.value, part.column(text), threshold, question, answer)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
