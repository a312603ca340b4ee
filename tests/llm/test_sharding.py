import zlib

import numpy as np
import pytest

from aerovigil.llm import sharding


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_shards_are_even_and_complete(spark, per_task):
    rng = np.random.default_rng(4)
    texts = [None, "", "é" * 50] + ["x" * int(n) for n in rng.integers(0, 900, 400)] + ["the same text"] * 250
    rows = [(int(i) if i % 50 else None, t, 9) for i, t in enumerate(texts)] + [(5, "twice", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(5)
    got = sharding.shard(docs, 8, rows_per_task=per_task).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= 2 * (900 + 16)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(got["size"], got["text_crc32"])) == want
    held = got[got["text_crc32"] == zlib.crc32(b"the same text")]["shard"]
    assert held.max() - held.min() + 1 == held.nunique()  # copies stand together


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    got = sharding.shard(docs, 8).toPandas()
    assert got["shard"].between(0, 7).all() and len(got) == 2
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_written_shards_hold_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * i, "s") for i in range(50)], "doc_id long, text string, source string")
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "source").collect())) == sorted(map(tuple, docs.collect()))
    assert back.select("shard").distinct().count() == 4
