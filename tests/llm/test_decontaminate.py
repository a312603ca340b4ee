import numpy as np
import pytest

from aerovigil.llm import decontaminate


def make(seed=1, n=60):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "te") for b in ("ra", "sen", "dol", "vik", "po", "tam", "gu")]
    text = lambda k: " ".join(rng.choice(words, k))
    items = [(i, f"{text(12)}, {text(10)}? {text(6)}.") for i in range(40)]
    docs, planted = [], set()
    for d in range(n):
        t = text(int(rng.integers(0, 400)))
        if d % 3 == 0:
            i = int(rng.integers(0, 40))
            t = f"{t}. {items[i][1].upper() if d % 2 else items[i][1]} {text(50)}"
            planted.add((d, i))
        docs.append((d, t))
    return docs, items, planted


@pytest.mark.parametrize("portion", [20_000, 7])
def test_planted_items_are_found(spark, portion):
    docs, items, planted = make()
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(None, None, "x"), (99, "", "x")], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items + [(100, None), (101, "")], "item_id long, text string")
    got = decontaminate.leaks(df, bench, portion=portion).toPandas()
    assert set(zip(got["doc_id"], got["item_id"])) == planted
    assert (got["score"] <= 1 + 1e-9).all()
    kept = decontaminate.clean(df, bench, portion=portion)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in planted} | {None, 99}


def test_search_equals_all_scores(spark):
    """Block maxima and light terms only skip what cannot reach the threshold."""
    docs, items, _ = make(3)
    index, = decontaminate.indexes(spark.createDataFrame(items, "item_id long, text string"), threshold=0.3)
    import pyarrow as pa
    for _, t in docs[:12]:
        got = {}
        for _, i, s, a, b in decontaminate.search(index, pa.array([t]), 0.3):
            got[i, a, b] = s
        words = decontaminate._terms([t])[0]
        want = {}
        for shift in (0, index.window // 2):
            for w in range((len(words) + shift) // index.window + 1):
                a, b = max(0, w * index.window - shift), min(len(words), (w + 1) * index.window - shift)
                held = np.unique(words[a:b]) if b > a else words[:0]
                for i in range(len(items)):
                    mine = index.item == i
                    owner = np.repeat(np.arange(len(index.terms)), np.diff(index.start))
                    s = index.impact[mine & np.isin(index.terms[owner], held)].sum()
                    if s >= 0.3:
                        want[i, a, b] = s
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_question_and_answer_are_both_needed(spark):
    bench = spark.createDataFrame([(1, "what is the name of the tallest hill in the north land", "old grey mount peak")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "they asked what is the name of the tallest hill in the north land and nobody knew"),
                                  (2, "what is the name of the tallest hill in the north land? It is Old Grey Mount Peak."),
                                  (3, "old grey mount peak")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [2]


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 1
    assert decontaminate.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_a_hit_does_not_depend_on_other_items(spark):
    """The triples of a short item lie scattered over a long text; a long item beside it does not widen the short one's passages."""
    short = "what is the old name of the tall grey hill in the north? it is misty peak."
    words = short.replace("?", "").replace(".", "").split()
    rng = np.random.default_rng(2)
    filler = [f"w{i}" for i in range(3000)]
    spread = []
    for i in range(0, len(words) - 2, 3):
        spread += list(rng.choice(filler, 400)) + words[i:i + 3]
    docs = spark.createDataFrame([(1, " ".join(spread)), (2, f"some words {short} and more")], "doc_id long, text string")
    long = " ".join(rng.choice(filler[:1500], 1500)) + "? the end."
    for items in ([(1, short)], [(1, short), (2, long)]):
        got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert [(r.doc_id, r.item_id) for r in got.collect()] == [(2, 1)]


def test_every_portion_and_width_is_searched(spark):
    docs, items, planted = make(5)
    rng = np.random.default_rng(5)
    wide = [(200 + i, " ".join(f"x{i}y{k}" for k in rng.permutation(n)) + "? so it is.") for i, n in enumerate((30, 70, 200, 900))]
    extra = [(500 + i, f"before {t} after") for i, (_, t) in enumerate(wide)]
    got = decontaminate.leaks(spark.createDataFrame(docs + extra, "doc_id long, text string"),
                              spark.createDataFrame(items + wide, "item_id long, text string"), portion=9)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == planted | {(500 + i, 200 + i) for i in range(4)}
