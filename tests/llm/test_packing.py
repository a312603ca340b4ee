import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from aerovigil.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "  \n\t ", "Hello, world! It's 3.14 o'clock\x0b\x0cand more space", "naïve ＡＢＣ é Ⅷ ﬁ Σας ΟΔΟΣ",
         "<|endoftext|> a<|startoftext|>b", "x" * 5000, "word " * 3000, "日本語 テキスト 🙂👍🏽", "a'll 've ''s 't's", "İstanbul ſ K", "ÉTÉ!! été!! Été, 3×4÷2. é×, ÷é, Ñ%ñ ŒUVRE-œuvre e\u0301, =\u0338 a=\u0338b ,\u0301x",
         "12.5% a1b2-c3 --- ...!!! (nested) {x}[y] 'tis o'er-'s", "Ǆ ǅ ß ẞ straße; ĳ Ŀ ŀ, ŉ."]


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_whole_texts():
    ids, held = packing.Encoder(PATH)(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert [*ids[held[i]:held[i + 1]].tolist(), 1] == ids_of(t), t


def test_lengths_are_binary_digits():
    assert packing.lengths(1) == [1]
    assert packing.lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]
    for n in range(1, 5000, 37):
        assert sum(packing.lengths(n)) == n and all(x & (x - 1) == 0 for x in packing.lengths(n))


def test_pieces_rebuild_documents(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 0), (None, "no id", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int").repartition(3)
    got = packing.pack(docs, PATH).toPandas()
    assert sorted(got["sequence_id"]) == list(range(len(got))) and (got["offset"] == 0).all()
    assert got.sort_values("sequence_id")["length"].is_monotonic_increasing
    for i, t in enumerate(TEXTS):
        own = got[got["doc_id"] == i].sort_values("start", kind="stable")
        if i == 3:  # repeated row
            assert len(own) % 2 == 0
            own = own.drop_duplicates("start")
        assert np.concatenate(own["ids"].tolist()).tolist() == ids_of(t)
        assert (own["doc_tokens"] == len(ids_of(t))).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert got["doc_id"].isna().any()


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
