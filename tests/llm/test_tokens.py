"""Token counts and tokenizer alignment against the libraries on whole texts and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from aerovigil.llm import alignment, tokencount
from aerovigil.llm import units as U

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SIGNS = [*"ab cde  \t\n\r\x0b'.s12  é中文😀▁,-_\x00\x1c\x7f", "the ", "'s ", "   ", "\n\n", "<s>", "<0x41>", "<|endoftext|>", " ", " ", "　"]


def messy(seed: int, n: int) -> list[str]:
    dice = random.Random(seed)
    return ["".join(dice.choice(SIGNS) for _ in range(dice.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    made = messy(7, 300) + ["", None, " ", "▁", "hahe " * 400, "a" * 3000, "Wort中" * 50_000, "copy of a text", "copy of a text"]
    return [(i % 290, t, "x", 0) for i, t in enumerate(made)] + [(None, "no id", "x", 1)]  # some ids stand twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, pre_token string, _row long").repartition(3)


@pytest.fixture(scope="module")
def libraries():
    return U.ByteLevel(BYTE), U.Pieces(PIECE)


@pytest.mark.parametrize("most", [tokencount.KNOWN, 50, 0])
def test_counts_are_those_of_whole_texts(docs, rows, libraries, most):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in tokencount.count(docs, PIECE, most=most).collect())
    tokens = [len(libraries[1].model.encode(t or "")) for _, t, *_ in rows]
    assert got == sorted((i if i is not None else -1, len((t or "").encode()), n, n > 4096) for (i, t, *_), n in zip(rows, tokens))


def by_loop(rows, libraries):
    """Tokens, groups and links of each row, and in how many rows each pair is linked."""
    a_model, b_model = libraries
    out, held = [], Counter()
    for i, t, *_ in rows:
        a = a_model.model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.model.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(a_model.bytes[x] for x in a) != whole or b"".join(b_model.bytes[x] for x in b) != whole:
            a, b = [], []
        ends_a, ends_b = (np.cumsum([len(m.bytes[x]) for x in ids]).tolist() for m, ids in ((a_model, a), (b_model, b)))
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[x:m], b[y:n]))
            x, y = m, n
        links, x, y = [], 0, 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            step_a, step_b = ends_a[x] <= ends_b[y], ends_b[y] <= ends_a[x]
            x, y = x + step_a, y + step_b
        held.update(set(links))
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, a, b, groups, links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, held


@pytest.mark.parametrize("most", [alignment.KNOWN, 40, 0])
def test_alignment_is_that_of_a_plain_loop(spark, rows, libraries, most):
    short = [r for r in rows if len(r[1] or "") < 4000]
    frame = spark.createDataFrame(short, "doc_id long, text string, pair string, n_a long").repartition(3)
    expect, held = by_loop(short, libraries)
    best: dict[int, int] = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    want = sorted((i if i is not None else -1, len(a), len(b), len(g), len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), d)
                  for i, a, b, g, k, d in expect)
    got = alignment.compare(frame, BYTE, PIECE, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == want


def test_groups_of_random_ends():
    dice = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 200, 3000):
        for share in (0.0, 0.02, 0.5, 1.0):
            a = np.unique(np.append(dice.integers(1, 4 * n, n), 4 * n))
            b = np.unique(np.concatenate((dice.integers(1, 4 * n, n), dice.permutation(a)[:int(share * len(a))], [4 * n])))
            last_a, last_b = alignment.align(a, b, np.array([len(a)]), np.array([len(b)]))
            assert a[last_a].tolist() == np.intersect1d(a, b).tolist() == b[last_b].tolist()
            x, y = alignment.links(a, b)
            first_a, first_b = np.append(0, a[:-1]), np.append(0, b[:-1])
            assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(len(a)) for j in np.flatnonzero((first_b < a[i]) & (b > first_a[i])).tolist()} or n > 500


def test_units_give_the_tokens_of_whole_texts(libraries):
    import pyarrow as pa
    both, texts = U.Both(BYTE, PIECE), messy(11, 3000)
    a, row_a, b, row_b = both(pa.array(texts))
    for i, t in enumerate(texts):
        if t and "▁" not in t:
            assert a[row_a == i].tolist() == both.a.model.encode(" " + t, add_special_tokens=False).ids
            assert b[row_b == i].tolist() == both.b.model.encode(t)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count(none, PIECE).collect() == [] and alignment.compare(none, BYTE, PIECE).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in tokencount.count(nothing, PIECE).sort("doc_id").collect()] == [(1, 0, 0, False), (2, 0, 0, False)]
    assert [tuple(r) for r in alignment.compare(nothing, BYTE, PIECE).sort("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
