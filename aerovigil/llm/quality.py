"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosted shallow trees.

Each text becomes a row of surface measures. Boosting visits one measure after the other and adds a small tree to that
measure's lookup table, then does the same for the pairs with the largest gain. Scoring adds one table entry per measure and
pair: a vectorised look-up, no tree is walked.

Defined results: a null text counts as empty and is scored like any other; an added column replaces an input column of its
name; repeated rows get equal scores; with no learning rows, or labels of one class only, every score is the share of label 1
(0.5 without rows); an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovigil.llm import textkit as K
from aerovigil.llm.frames import add_columns, fold, learning_rows

LEARN_ROWS = 20_000   #: Most labelled texts that the model is fitted on.
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 80, 40, 0.15, 3

NAMES = ("log_bytes", "log_words", "word_length", "letters", "upper", "digits", "bangs", "bars", "marks", "stops", "commas",
         "other_signs", "distinct_words", "top_word", "same_as_last", "short_words", "words_per_line", "distinct_lines",
         "byte_entropy", "capital_words")
_KIND = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = (1 if 97 <= _i <= 122 or _i >= 128 else 2 if 65 <= _i <= 90 else 3 if 48 <= _i <= 57 else 4 if _c == "!" else
                 5 if _c == "|" else 6 if _c in "#$%&*" else 7 if _c == "." else 8 if _c == "," else 0 if _i in (9, 10, 11, 12, 13, 32)
                 else 9)


def measures(text: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    data, offsets = K.utf8(text)
    n = len(offsets) - 1
    size = np.diff(offsets)
    start, end, row = K.words(data, offsets)
    code = K.span_hash(K.prefix_hash(K.lower(data)), start, end)
    held = np.bincount(row, minlength=n)
    first = np.cumsum(held) - held
    out = np.zeros((n, len(NAMES)))
    kinds = _KIND[data]
    lengths = end - start
    capital = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.empty(0, bool)
    for i in range(n):
        chars = data[offsets[i]:offsets[i + 1]]
        k = np.bincount(kinds[offsets[i]:offsets[i + 1]], minlength=10) / max(1, size[i])
        w = code[first[i]:first[i] + held[i]]
        m = max(1, held[i])
        counts = np.sort(w)
        runs = np.diff(np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1], [True])))) if len(w) else np.zeros(1)
        bytes_ = np.bincount(chars, minlength=256)
        share = bytes_[bytes_ > 0] / max(1, size[i])
        lines = chars.tobytes().split(b"\n")
        ln = lengths[first[i]:first[i] + held[i]]
        out[i] = (np.log1p(size[i]), np.log1p(held[i]), ln.mean() if held[i] else 0, k[1] + k[2], k[2], k[3], k[4], k[5], k[6],
                  k[7], k[8], k[9], len(runs) / m ** 0.8, runs.max() / m, (w[1:] == w[:-1]).sum() / m, (ln <= 3).sum() / m,
                  np.log1p(held[i] / len(lines)), len(set(lines)) / len(lines), -(share * np.log2(share)).sum(),
                  capital[first[i]:first[i] + held[i]].sum() / m)
    return out


@dataclass
class Additive:
    """Bin edges, one table per measure, one per pair of measures, and the intercept (a logit)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(cut, x[:, j], "right")]
        for (i, j), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree over ordered bins from gradient and curvature sums: split the segment with the largest gain again."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def value(a, b):
        return (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)

    def best(a, b):
        at = np.arange(a + 1, b)
        left = (cg[at] - cg[a]) ** 2 / (ch[at] - ch[a] + 1.0)
        right = (cg[b] - cg[at]) ** 2 / (ch[b] - ch[at] + 1.0)
        k = int(np.argmax(left + right))
        return left[k] + right[k] - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0), int(at[k])

    for _ in range(leaves - 1):
        found = max((best(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1), default=None)
        if found is None or found[0] <= 1e-9:
            break
        cuts = sorted([*cuts, found[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = value(a, b)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The additive model of labels ``y`` (0 or 1) on measures ``x``; both bounded by ``LEARN_ROWS``."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model

    def quantiles(j, bins):
        return np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins))

    model.edges = [quantiles(j, BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    logit = np.full(len(y), model.base)

    def slope():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slope()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES)
            model.tables[j] += step
            logit += step[b]
    model.coarse = [quantiles(j, PAIR_BINS) for j in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    g, h = slope()

    def grids(i, j, g, h):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        at = small[i] * shape[1] + small[j]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = {}
    for i in range(len(small)):
        for j in range(i):
            gg, hh = grids(i, j, g, h)
            gains[i, j] = (gg ** 2 / (hh + 1)).sum() - (gg.sum(0) ** 2 / (hh.sum(0) + 1)).sum() - (gg.sum(1) ** 2 / (hh.sum(1) + 1)).sum()
    for i, j in sorted(gains, key=gains.get, reverse=True)[:PAIRS]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in model.pairs.items():
            gg, hh = grids(i, j, *slope())
            rows = _tree(gg.sum(1), hh.sum(1), 2)
            step = np.zeros_like(values)
            for v in np.unique(rows):
                part = rows == v
                step[part] = RATE * _tree(gg[part].sum(0), hh[part].sum(0), 2)
            values += step
            logit += step[small[i], small[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0,
          most: int = LEARN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Additive:
    """Fits on at most about ``most`` labelled rows outside the held-out fold, one per id."""
    chosen = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_label"))
    chosen = learning_rows(chosen, fold(doc_id, folds) != held, most, doc_id)
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)  # at most about ``most`` rows by the hash threshold
    measured = add_columns(rows, lambda part: [pa.array(list(measures(part.column(text))), pa.list_(pa.float64()))],
                           "_measures array<double>", text, [doc_id, "_label"])
    got = measured.groupBy(doc_id).agg(F.min("_label").alias("y"), F.min("_measures").alias("x")).orderBy(doc_id).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Additive, column: str = "quality_score", text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``column``; one pass over the texts, no shuffle."""
    return add_columns(docs, lambda part: [pa.array(model.score(measures(part.column(text))))], f"`{column}` double", text, keep)
