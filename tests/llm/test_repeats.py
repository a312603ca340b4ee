import hashlib
from collections import Counter

import numpy as np
import pytest

from aerovigil.llm import repeats


def brute(texts, length):
    """(removed, spans, hash of the rest) of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = True
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def letters(rng, least, most):
    return rng.choice(np.array([97, 98], np.uint8), int(rng.integers(least, most))).tobytes()


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda k, a="abcdefgh é": "".join(rng.choice(list(a), k))
    shared = [word(int(k)) for k in rng.integers(30, 160, 6)]
    texts = [None, "", "short", "ab" * 90, "ab" * 90 + "c", "x" * 300, word(500), "Der " * 60 + word(50)]
    for _ in range(n):
        parts = [word(int(rng.integers(0, 80)), "abc ") for _ in range(3)]
        for s in rng.choice(shared, 2):
            a, b = sorted(rng.integers(0, len(s) + 1, 2))
            parts.insert(int(rng.integers(0, len(parts))), s if rng.random() < 0.6 else s[a:b])
        texts.append("".join(parts))
    return texts + texts[10:13] + [texts[12]]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 10**6), (2, 40), (3, 5)])
def test_equals_brute_force(spark, seed, frequent):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.strip(docs, 48, frequent=frequent).collect()}
    want = brute(texts, 48)
    assert sum(w[1] for w in want) > 1000
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


@pytest.mark.parametrize("pairwise", [2, 50])
def test_offsets_of_one_gram(monkeypatch, pairwise):
    """The grouped and the pairwise way find the same repeated windows."""
    monkeypatch.setattr(repeats, "PAIRWISE", pairwise)
    rng = np.random.default_rng(5)
    core, length = "g" * 32, 40
    items = sorted((core.encode() + letters(rng, 3, 9), letters(rng, 0, 9)) for _ in range(40))
    items = [x for i, x in enumerate(items) if x not in items[:i]]
    common = [0] + [repeats._common(a[0], b[0], 0) for a, b in zip(items, items[1:])]
    got = repeats.repeated_offsets([x[0] for x in items], [x[1] for x in items], [1] * len(items), common, length)
    for i, (right, left) in enumerate(items):
        for o in range(length - len(right), len(left) + 1):
            want = any(j != i and length - len(r) <= o <= len(x) and r[:length - o] == right[:length - o] and x[len(x) - o:] == left[len(left) - o:]
                       for j, (r, x) in enumerate(items))
            assert any(a <= o <= b for a, b in got[i]) == want


def test_merge_is_sorted_with_exact_prefixes():
    rng = np.random.default_rng(7)
    runs = []
    for k in (0, 1, 5, 40, 40):
        runs.append(sorted((letters(rng, 0, 12), b"l" * int(rng.integers(0, 3)), 1, b"") for _ in range(k)))
    merged = list(repeats.merge([repeats.decode_run(repeats.encode_run(r)) for r in runs]))
    assert [m[1] for m in merged] == sorted(e[0] for r in runs for e in r)
    assert sorted((m[1], m[2]) for m in merged) == sorted((e[0], e[1]) for r in runs for e in r)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == repeats._common(a[1], b[1], 0)


def test_empty_table_and_kept_bytes(spark):
    assert repeats.strip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a" + "xyzw" * 20), (2, "b" + "xyzw" * 20), (None, "unique")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in repeats.strip(docs, 48, with_text=True).collect()}
    assert got == {1: b"a", 2: b"b", None: b"unique"}
