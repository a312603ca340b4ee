import numpy as np

from aerovigil.llm import neighbours


def exact(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = unit @ unit[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(score.round(12), ids) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_recall_and_copies(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 16)).astype(np.float32).astype(float)
    vectors[100:160] = vectors[100]  # one hot vector
    ids = list(range(500))
    rows = [(i, v.tolist(), i % 3) for i, v in zip(ids, vectors)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0] * 15 + [None], 0), (1004, [float("inf")] * 16, 0),
           (1050, None, 0), (None, [1.0] * 16, 0), (1006, [1.0, 2.0], 0), (3, vectors[3].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = neighbours.nearest(df, df.filter("vec_id % 50 = 0"), k=5).toPandas().sort_values(["query_id", "rank"])
    want = exact(ids, vectors, range(0, 500, 50), 5)
    assert set(got["query_id"]) == set(want)
    found = got.groupby("query_id")["vec_id"].apply(list).to_dict()
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.95
    assert found[100] == [101, 102, 103, 104, 105] and found[150] == [100, 101, 102, 103, 104]
    assert got.groupby("query_id")["rank"].apply(list).tolist() == [[1, 2, 3, 4, 5]] * 10
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.allclose(got["score"], [unit[q] @ unit[v] for q, v in zip(got["query_id"], got["vec_id"])], atol=1e-12)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df.limit(1), df.limit(1)).count() == 0


def test_near_copies_are_told_apart(spark):
    """Groups whose vectors differ by far less than eight bits per component."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 16))
    for a, b, noise in ((100, 200, 1e-2), (200, 600, 1e-4)):
        vectors[a:b] = vectors[a] + noise * vectors[a:b]
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(df, df.filter("vec_id % 25 = 0"), k=5).toPandas()
    found = got.groupby("query_id")["vec_id"].apply(set).to_dict()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    right = {}
    for q in range(0, 900, 25):
        far = ((unit - unit[q]) ** 2).sum(1)
        want = [i for i in np.argsort(far, kind="stable") if i != q][:5]
        right.setdefault((q >= 100) + int(q >= 200) + (q >= 600), []).append(len(found[q] & set(want)) / 5)
    assert all(np.mean(x) >= 0.95 for x in right.values()), {g: float(np.mean(x)) for g, x in right.items()}


def test_extreme_magnitudes_have_true_cosines(spark):
    made = [(0, [1e200, 0.0]), (1, [2e-200, 1e-200]), (2, [0.0, 3.0]), (3, [-1e300, 1e300])]
    rows = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.nearest(rows, rows, k=3).collect()}
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in made}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    assert len(got) == 12 and all(abs(s - unit[a] @ unit[b]) < 1e-12 for (a, b), s in got.items())
