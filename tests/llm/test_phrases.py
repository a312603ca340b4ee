"""Collocations against a plain count of every run of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from aerovigil.llm import phrases

WORDS = ["New", "york", "city", "the", "a", "über", "ÄÖ", "l'été", "x-y", "中文", "\x00"]
GAPS = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "!", "\x0b"]


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(5)
    made = []
    for i in range(400):
        text = "".join(dice.choice(WORDS[:3 + i % 9]) + dice.choice(GAPS) for _ in range(dice.randint(0, 30)))
        made.append((i // 2, text, [None, "en", "de", "und"][i % 4], "x"))
    made += [(900 + i, "one and only phrase " * 3, "fr", "x") for i in range(12)]  # copies
    return made + [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, ". , ;", "it", "x"), (None, "new york city " * 2000, "en", "x")]


def by_loop(rows, least=10, longest=3, covered=50, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang, text = lang or "und", (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    held = [p for p, a in f.items() if len(p) > 2 and a >= least]
    gone = set()
    for p in held:
        for n in range(2, len(p) - 1):
            for i in range(1, len(p) - n + 1):
                part = (p[0], *p[i:i + n])
                if 100 * f[p] >= covered * f[part]:
                    gone.add(part)
    out = {}
    for p in held:
        if p in gone:
            continue
        a = f[p]
        cuts = [(1000000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[(p[0], *p[k + 1:])]))
    return sorted((lang, rank, p.decode(), -a, x, y, total[lang], -s)
                  for lang, held in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(held)[:top], 1))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
KIND = "doc_id long, text string, lang string, phrase string"


@pytest.mark.parametrize("longest, covered, top", [(3, 50, 2000), (4, 30, 7)])
def test_collocations_by_loop(spark, rows, longest, covered, top):
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    got = phrases.collocations(docs, longest=longest, covered=covered, top=top)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == by_loop(rows, 10, longest, covered, top)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(re.sub("[ \t]+", " ", t or "").translate({c: c + 32 for c in range(65, 91)}))
    assert all(any(r.phrase in t for t in texts[r.example]) for r in got.collect())


def test_equal_fingerprints_are_told_apart(spark, rows, monkeypatch):
    """All runs share 16 fingerprints and all map bits are set, so only the texts decide."""
    few = [r for r in rows if len(r[1] or "") < 5000]
    real = phrases.Slice.runs
    monkeypatch.setattr(phrases.Slice, "runs", lambda self, size: (lambda f, k: (f, k & np.uint64(15)))(*real(self, size)))
    docs = spark.createDataFrame(few, KIND).coalesce(1)
    batch = docs.select("doc_id", "text", "lang").toArrow().combine_chunks().to_batches()[0]
    held = phrases.Slice(batch, "text", "lang")
    first, key = held.runs(2)
    assert len(np.unique(key)) <= 16 < len(set(held.texts(first, 2).to_pylist()))
    sent = type("Sent", (), {"value": b"\xff" * 8192})()
    counted = Counter()
    run = phrases._occurrences  # the worker's loop, run here on one batch
    captured = {}

    class Frame:
        schema, sparkSession = docs.schema, spark

        def select(self, *c):
            return self

        def mapInArrow(self, fn, schema):
            captured["fn"] = fn

    run(Frame(), [sent] * 3, "lang", "text", "doc_id")
    for out in captured["fn"](iter([batch])):
        for r in out.to_pylist():
            if r["size"]:
                counted[r["lang"], r["phrase"]] += r["f"]
    expect = Counter()
    for _, text, lang, _ in few:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall("[^ \t]+", piece)
            expect.update((lang or "und", " ".join(words[i:i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert counted == expect


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], KIND)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "")], KIND)).collect() == []
