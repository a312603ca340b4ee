"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters: groups of lexicon entries and a few patterns. The lexicon holds words, and beginnings of words, that are significantly
more frequent in texts labelled toxic in the learning fold; entries are dealt into voters by strength and kind, so a voter is a
list that fires or abstains. Given labels serve this choice of entries only; they are no voter and no start value.

Label model: voters fire with a rate per class. Rates and the class prior are estimated by expectation-maximisation from the votes
alone, starting from the guess that a text is toxic where some list fires. Voters that still correlate within a class share their
weight, by the square of the correlation. Its posterior is the soft label on which a ridge-penalised logistic classifier of voter
counts and densities is fitted (Newton steps). Scoring needs the hit counts of a text only.

Defined results: a null or empty text has no hits and gets the classifier's base score; texts are read whole; without learning
rows the score is 0; repeated rows get equal scores; an added column replaces an input column of its name; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovigil.llm import textkit as K
from aerovigil.llm.frames import add_columns, fold, learning_rows

LEARN_ROWS = 20_000     #: Most labelled texts that voters, label model and classifier are fitted on.
ENTRIES = 4_096         #: Most lexicon entries.
MIN_TEXTS = 4           #: Texts labelled toxic that an entry occurs in at least.
STRONG = 5.0            #: Least z-score of an entry.
HEADS = (4, 5, 6, 7)    #: Lengths in bytes of the word beginnings.
TIERS = 6               #: Voters per kind, by strength.
PATTERNS = 2
CORRELATED = 0.3        #: Correlations within a class below this count as none.


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind (0 word, 1 beginning) and row of every possible lexicon entry, in order of occurrence."""
    data, offsets = K.utf8(column)
    start, end, row = K.words(data, offsets, K.SIGNS)
    prefix = K.prefix_hash(K.lower(data))
    code, kind, rows = [K.span_hash(prefix, start, end)], [np.zeros(len(start), np.int8)], [row]
    for n in HEADS:
        long = end - start > n
        code.append(K.mix(K.span_hash(prefix, start[long], start[long] + n)))
        kind.append(np.ones(int(long.sum()), np.int8))
        rows.append(row[long])
    return np.concatenate(code), np.concatenate(kind), np.concatenate(rows)


def lexicon(rows: DataFrame, label: str, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the entries and the voter of each, counted over the learning rows by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text):
            code, kind, row = entries(part.column(text))
            toxic = part.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((row, code))
            code, kind, row = code[order], kind[order], row[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            code, kind, hit = code[new], kind[new], toxic[row[new]]
            some, first, back = np.unique(code, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([K.to_long(some), pa.array(kind[first].astype(np.int32)),
                                              pa.array(np.bincount(back, hit, len(some)).astype(np.int64)),
                                              pa.array(np.bincount(back, 1 - hit, len(some)).astype(np.int64))], ["entry", "kind", "hit", "miss"])

    totals = rows.agg(F.coalesce(F.sum(F.col(label)), F.lit(0)).alias("hit"), F.count("*").alias("n")).first()
    if not totals.hit or totals.hit == totals.n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    share = totals.hit / totals.n
    n = F.col("hit") + F.col("miss")
    z = (F.col("hit") - n * share) / F.sqrt(n * share * (1 - share))
    found = rows.select(text, label).mapInArrow(run, "entry long, kind int, hit long, miss long")
    found = found.groupBy("entry", "kind").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    found = found.filter(F.col("hit") >= MIN_TEXTS).filter(F.col("miss") * 4 < F.col("hit")).withColumn("z", z).filter(F.col("z") >= STRONG)
    got = found.orderBy(F.desc("z"), "entry").limit(ENTRIES).toPandas()
    code = got["entry"].to_numpy(np.int64).view(np.uint64)
    voter = np.zeros(len(got), np.int64)
    for kind in (0, 1):
        mine = np.flatnonzero(got["kind"] == kind)
        voter[mine] = kind * TIERS + np.arange(len(mine)) * TIERS // max(1, len(mine))
    order = np.argsort(code)
    return code[order], voter[order]


def hits(column: pa.Array, code: np.ndarray, voter: np.ndarray) -> np.ndarray:
    """Per text: hits of each lexicon voter, of each pattern, and the number of words."""
    data, offsets = K.utf8(column)
    n = len(offsets) - 1
    out = np.zeros((n, 2 * TIERS + PATTERNS + 1))
    some, _, row = entries(column)
    if len(code):
        at = np.searchsorted(code, some)
        at[at == len(code)] = 0
        ok = code[at] == some
        np.add.at(out, (row[ok], voter[at[ok]]), 1)
    start, end, row = K.words(data, offsets, K.SIGNS)
    out[:, -1] = np.bincount(row, minlength=n)
    shout = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=shout[1:])
    loud = (shout[end] - shout[start] == end - start) & (end - start > 2)
    out[:, 2 * TIERS] = np.bincount(row[loud], minlength=n)
    bang = np.flatnonzero(data == 33)
    out[:, 2 * TIERS + 1] = np.bincount(np.searchsorted(offsets, bang, "right") - 1, minlength=n)
    return out


def features(counted: np.ndarray) -> np.ndarray:
    """Logarithms of the counts, shares of the words, and which voters fired."""
    lists, size = counted[:, :2 * TIERS], np.maximum(counted[:, -1:], 1)
    both = np.concatenate((counted[:, :-1], lists[:, :TIERS].sum(1, keepdims=True), lists[:, TIERS:].sum(1, keepdims=True)), axis=1)
    return np.concatenate((np.log1p(both), np.minimum(both / size, 1) * 10, (lists > 0).astype(float), np.log1p(size) / 10), axis=1)


def votes(counted: np.ndarray) -> np.ndarray:
    """0 or 1 per voter: a list fires on one hit, and again as a voter of its own on three; patterns fire on a tenth of the words."""
    lists = counted[:, :2 * TIERS]
    patterns = counted[:, 2 * TIERS:2 * TIERS + PATTERNS] > np.maximum(counted[:, -1:], 10) / 10
    return np.concatenate((lists > 0, lists > 2, patterns), axis=1).astype(float)


@dataclass
class LabelModel:
    """Class prior, firing rates per class, and the weight left to each voter by its correlations."""

    prior: float
    rates: np.ndarray
    weight: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        r = self.rates
        logit = np.log(self.prior / (1 - self.prior)) + (
            self.weight * (v * np.log(r[1] / r[0]) + (1 - v) * np.log((1 - r[1]) / (1 - r[0])))).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def shared_voice(v: np.ndarray, p: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The weight of each voter: one voice is shared by voters whose votes correlate where the class is given."""
    both = np.zeros((v.shape[1], v.shape[1]))
    for rate, mass in zip(rates, (1 - p, p)):
        left = v - rate
        together = (left * mass[:, None]).T @ left / (mass.sum() + 1)
        spread = np.sqrt(np.diag(together)) + 1e-6
        both += np.abs(together / spread[:, None] / spread) / 2
    both[both < CORRELATED] = 0
    np.fill_diagonal(both, 1)
    return 1 / (both ** 2).sum(1)


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 40, alone: int = 3) -> LabelModel:
    """Accuracies and correlations of voters by expectation-maximisation from a first guess ``start`` of the posterior.

    The first ``alone`` rounds take the voters as independent, later ones weigh them by their correlations.
    """
    p, model = np.clip(start, 0.02, 0.98), None
    weight = np.ones(v.shape[1])
    for k in range(rounds):
        mass = np.array([(1 - p).sum(), p.sum()])
        rates = np.clip((np.stack([1 - p, p]) @ v + 0.5) / (mass[:, None] + 1), 1e-4, 1 - 1e-4)
        if k >= alone:
            weight = shared_voice(v, p, rates)
        model = LabelModel(float(np.clip(mass[1] / len(v), 1e-3, 1 - 1e-3)), rates, weight)
        p = model.posterior(v)
    return model


def weak_labels(counted: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """The label model of the voters' hit counts and its posterior; no given label takes part."""
    v = votes(counted)
    model = label_model(v, 0.9 * v[:, :2 * TIERS].max(1))
    return model, model.posterior(v)


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and scales of a logistic regression on soft labels."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    w = np.zeros(z.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-6
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + keep, z.T @ (p - q) - keep @ w)
    return w, mean, scale


@dataclass
class Model:
    code: np.ndarray
    voter: np.ndarray
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    labels: LabelModel | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(column))
        x = (features(hits(column, self.code, self.voter)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, most: int = LEARN_ROWS,
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most about ``most`` labelled rows outside the held-out fold."""
    chosen = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    chosen = learning_rows(chosen, fold(doc_id, folds) != held, most, doc_id)
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(doc_id, text, "_label")  # bounded by the hash threshold
    code, voter = lexicon(rows, "_label", text)
    model = Model(code, voter)
    counted = add_columns(rows, lambda part: [pa.array(list(hits(part.column(text), code, voter)), pa.list_(pa.float64()))],
                          "_hits array<double>", text, [doc_id, "_label"])
    got = counted.groupBy(doc_id).agg(F.min("_label").alias("y"), F.min("_hits").alias("x")).orderBy(doc_id).toPandas()
    if not len(got) or got["y"].nunique() < 2:
        return model
    x = np.array(got["x"].tolist(), float)
    model.labels, posterior = weak_labels(x)
    model.weights, model.mean, model.scale = logistic(features(x), posterior)
    return model


def score(docs: DataFrame, model: Model, column: str = "toxicity", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``column``; one pass over the texts, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, lambda part: [pa.array(sent.value.score(part.column(text)))], f"`{column}` double", text, keep)
