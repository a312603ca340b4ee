import zlib

import numpy as np
import pyarrow as pa
import pytest

from aerovigil.llm import language, quality, queries, toxicity


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.mark.parametrize(("name", "column", "least"), [("op2_quality_classifier", "quality", 0.98), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [held(i, 5, 0) for i in got["doc_id"]]).all()
    rows = got[got["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (rows["predicted"] == rows[column]).mean() >= least


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_language_id"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both["held_out"] == [held(i, 4, 2) for i in both["doc_id"]]).all()
    assert (both["lang"] == both["lang_pred"])[both["held_out"]].mean() >= 0.99


def test_odd_texts(spark):
    """Null, empty, symbol-only and very long texts, null ids, repeated rows and clashing columns."""
    texts = [None, "", "   ", "1234 !!! €", "hello there friend " * 20, "bonjour mes amis " * 20, "x" * 3_000_000, "hello there friend " * 20]
    rows = [(i, t, "en" if i % 2 == 0 else "fr", 0.5) for i, t in enumerate(texts)] + [(None, "hello", None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, "score").toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    twin = got[got["doc_id"].isin([4, 7])]["score"]
    assert twin.nunique() == 1
    bad = toxicity.train(docs, labels)
    assert toxicity.score(docs, bad, "score").toPandas()["score"].between(0, 1).all()
    tongue = language.identify(docs, language.train(docs)).toPandas().set_index("doc_id")
    assert (tongue.loc[[0, 1, 2, 3], "lang_pred"] == "und").all() and (tongue.loc[[0, 1, 2, 3], "score"] == 0).all()
    for none in (docs.limit(0), docs):
        few = labels.limit(0)
        assert quality.score(none, quality.train(none, few), "s").count() == none.count()
        assert toxicity.score(none, toxicity.train(none, few), "s").count() == none.count()
    assert language.identify(docs, language.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_label_model_finds_accuracies():
    """Independent voters of known quality: posterior beats every voter; copies of one voter share its weight."""
    rng = np.random.default_rng(2)
    y = rng.random(5000) < 0.3
    rates = [(0.05, 0.8), (0.1, 0.7), (0.2, 0.6), (0.02, 0.5)]
    v = np.stack([np.where(y, rng.random(5000) < b, rng.random(5000) < a) for a, b in rates], axis=1).astype(float)
    v = np.concatenate((v, v[:, :1], v[:, :1]), axis=1)
    model = toxicity.label_model(v, v[:, 0])
    assert ((model.posterior(v) > 0.5) == y).mean() > max(((v[:, k] > 0) == y).mean() for k in range(4))
    assert model.weight[0] < 0.5 < model.weight[1]


def test_posterior_uses_no_label_voter(spark):
    """The label model has the lists and patterns as voters only, and its posterior follows them where the labels are turned round."""
    rng = np.random.default_rng(5)
    calm, rude = [f"calm{i}" for i in range(60)], ["grumblex", "snarfle", "vexnog", "blarghy"]
    toxic = rng.random(1500) < 0.2
    texts = [" ".join([*rng.choice(calm, 30), *(rng.choice(rude, 3) if t else [])]) for t in toxic]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    given = toxic.copy()
    wrong = rng.choice(1500, 60, replace=False)     # labels given wrongly
    given[wrong] = ~given[wrong]
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(given)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    counted = toxicity.hits(pa.array(texts), model.code, model.voter)
    assert model.labels.rates.shape[1] == toxicity.votes(counted).shape[1] == 4 * toxicity.TIERS + toxicity.PATTERNS
    posterior = model.labels.posterior(toxicity.votes(counted))
    assert ((posterior > 0.5) == toxic)[wrong].mean() > 0.9
    got = toxicity.score(docs, model, "s").orderBy("doc_id").toPandas()
    assert ((got["s"] >= 0.5) == toxic).mean() > 0.95


def test_kernel_is_the_set_product():
    texts = ["abcd", "abce", "zzz"]
    grams = np.unique(np.concatenate([np.concatenate(list(language.codes(np.frombuffer(t.encode(), np.uint8)))) for t in texts])).astype(np.int64)
    p = language.presence(pa.array(texts), grams)
    sets = [{t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    for i in range(3):
        for j in range(3):
            assert p[i] @ p[j] == pytest.approx(len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5, abs=1e-5)


def test_rare_language_and_copies(spark):
    """A language far below one learning row in a plain sample is learned, and copies of a text take one landmark."""
    rng = np.random.default_rng(3)
    words = {"en": ["the", "house", "with", "water", "there"], "fr": ["une", "maison", "avec", "eau", "vous"], "xx": ["zqk", "wvjx", "qqzy", "kxwv"]}
    rows = [(i, "the house " * 5 if i % 3 == 0 else " ".join(rng.choice(words[n], 12)), n) for i, n in enumerate(["en", "fr"] * 3000)]
    rows = [(i, t, "en" if i % 3 == 0 else n) for i, t, n in rows]
    rows += [(10_000 + i, " ".join(rng.choice(words["xx"], 12)), "xx") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, most=100, landmarks=60)
    assert model.languages == ["en", "fr", "xx"]
    got = language.identify(docs, model).filter("lang = 'xx'").toPandas()
    assert (got["lang_pred"] == "xx").all() and len(got) == 12
    from pyspark.sql import functions as F
    from aerovigil.llm.frames import learning_rows_by
    sizes = {r["lang"]: r["count"] for r in learning_rows_by(docs, F.lit(True), 100, "lang").groupBy("lang").count().collect()}
    assert sizes["xx"] == 12 and 20 <= sizes["en"] <= 80 and 20 <= sizes["fr"] <= 80
