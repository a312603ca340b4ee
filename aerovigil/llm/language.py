"""Language identification with string kernels: blended spectrum, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams (n = 1, 2, 3, lower case) present in both, over those that occur in a
landmark, divided by the geometric mean of their own numbers. With landmarks L the model of a language is K(x, L) w; as K is linear
in the presence vector of x, the landmark matrix and w multiply to one weight per n-gram and language, and a batch of texts is
scored by one product of presence and weight matrices.

Defined results: a text that is null or has no letter is ``und`` with score 0; other texts, of any length, are read whole; equal
scores go to the language that sorts first; with no learning rows every text is ``und``; repeated rows get equal results; an
added column replaces an input column of its name; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovigil.llm import textkit as K
from aerovigil.llm.frames import add_columns, fold, learning_rows_by

LEARN_ROWS = 4_000     #: Most texts that the regression is fitted on.
LANDMARKS = 240        #: Texts that span the kernel space.
SIZES = (1, 2, 3)
RIDGE = 1e-3
UNKNOWN = "und"


def codes(chars: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers, one array per n."""
    wide = chars.astype(np.uint32)
    yield wide
    if len(wide) > 1:
        two = (wide[:-1] << np.uint32(8)) | wide[1:]
        yield two + np.uint32(1 << 8)
        if len(wide) > 2:
            yield ((two[:-1] << np.uint32(8)) | wide[2:]) + np.uint32((1 << 16) + (1 << 8))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return K.utf8(pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column))


def presence(column: pa.Array, grams: np.ndarray) -> np.ndarray:
    """Texts by n-grams: 1 where present, each row divided by the root of its sum."""
    table = _tables.setdefault(id(grams), None)
    if table is None:
        _tables.clear()
        table = np.full((1 << 24) + (1 << 16) + (1 << 8), len(grams), np.int32)
        table[grams] = np.arange(len(grams))
        _tables[id(grams)] = table
    data, offsets = lowered(column)
    out = np.zeros((len(offsets) - 1, len(grams) + 1), np.float32)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        for code in codes(data[a:b]):
            out[i, table[code]] = 1
    out = out[:, :-1]
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


_tables: dict[int, np.ndarray | None] = {}


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        value = presence(column, self.grams) @ self.weights
        best = value.argmax(1)
        score = np.clip(value[np.arange(len(best)), best].astype(float), 0, 1)
        return [self.languages[b] if y else UNKNOWN for b, y in zip(best, letters)], np.where(letters, score, 0.0)


def train(docs: DataFrame, lang: str = "lang", folds: int = 4, held: int = 2, most: int = LEARN_ROWS, landmarks: int = LANDMARKS,
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most about ``most`` texts with a language, outside the held-out fold, with a share for every language.

    Landmarks are different sets of n-grams, equally many per language.
    """
    known = F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id, folds) != held)
    rows = learning_rows_by(docs.select(doc_id, lang, text), known, most, lang, doc_id).select(lang, text)

    def sets(part: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = lowered(part.column(text))
        own = [np.unique(np.concatenate([*codes(data[a:b]), np.empty(0, np.uint32)])).astype(np.int32) for a, b in zip(offsets, offsets[1:])]
        return [pa.array(own, pa.list_(pa.int32()))]

    # At most about ``most`` rows; a text has no more distinct n-grams than 2^24, usually a few thousand.
    got = add_columns(rows, sets, "_grams array<int>", text, [lang]).toArrow()
    langs = np.array(got[lang].to_pylist(), dtype=object)
    own = [np.asarray(g) for g in (s.values.to_numpy() for s in got["_grams"])] if len(langs) else []
    names = sorted(set(langs.tolist()))
    if not names:
        return Model([], np.empty(0, np.int64), np.empty((0, 0)))
    order = np.argsort([int(K.mix(np.array([len(g) + g.sum(dtype=np.int64)], np.uint64))[0]) for g in own], kind="stable")
    seen: set[tuple[str, bytes]] = set()
    once = np.array([i for i in order if (k := (langs[i], own[i].tobytes())) not in seen and not seen.add(k)])  # copies span nothing
    chosen = np.concatenate([once[langs[once] == n][:max(1, landmarks // len(names))] for n in names])
    grams = np.unique(np.concatenate([own[i] for i in chosen])).astype(np.int64)

    def vectors(which) -> np.ndarray:
        x = np.zeros((len(which), len(grams)), np.float32)
        for r, i in enumerate(which):
            at = np.searchsorted(grams, own[i])
            at[at == len(grams)] = 0
            x[r, at[grams[at] == own[i]]] = 1
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    base = vectors(chosen)
    left, right = np.zeros((len(chosen),) * 2), np.zeros((len(chosen), len(names)))
    for at in range(0, len(own), 256):
        part = np.arange(at, min(at + 256, len(own)))
        k = (vectors(part) @ base.T).astype(float)
        y = (langs[part][:, None] == np.array(names, dtype=object)[None]).astype(float)
        left += k.T @ k
        right += k.T @ y
    inner = (base @ base.T).astype(float)
    weights = np.linalg.solve(left + RIDGE * len(own) * (inner + 1e-6 * np.eye(len(chosen))), right)
    return Model(names, grams, (base.T.astype(float) @ weights).astype(np.float32))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; one pass over the texts, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        names, score = sent.value.predict(part.column(text))
        return [pa.array(names, pa.string()), pa.array(score)]

    return add_columns(docs, compute, "lang_pred string, score double", text, keep)
