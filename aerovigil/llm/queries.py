"""Queries of the operators over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerovigil.llm import (alignment, decontaminate, jaccard, language, neighbours, packing, phrases, quality, repeats, secrets, sharding, tokencount,
                           toxicity)
from aerovigil.llm.textkit import table
from aerovigil.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", folds=5, held=0)
    scored = quality.score(docs, model, "score", keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Sets and links by their definition; components by spreading the smallest id until nothing changes.
_JACCARD_SQL = """
with recursive bag as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as s from bag),
coded as (select doc_id, hash(s) as s from sets),
size as (select doc_id, count(*) as n from coded group by 1),
both_in as (
  select a.doc_id as x, b.doc_id as y, count(*) as o from coded a join coded b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
pair as (
  select x, y from both_in join size p on p.doc_id = x join size q on q.doc_id = y where 100 * o >= 85 * (p.n + q.n - o)),
edge as (select x, y from pair union select y, x from pair),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.y from reach r join edge e on r.y = e.x),
component as (select x, min(y) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join size s on s.doc_id = d.doc_id left join component c on c.x = d.doc_id
"""


@query(_JACCARD_SQL)
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), words=4, percent=85)


@query()
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query()
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip(table(spark, sf_dir, "documents"))


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, folds=4, held=2), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(quality.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", folds=5, held=0)
    scored = toxicity.score(docs, model, "score", keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op4_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.pmod("vec_id", F.lit(50)) == 0), k=5)


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return alignment.compare(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


#: Runs of words by their definition; the score in 128-bit integers.
_PHRASE_SQL = """
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
bag as (select lang, list_filter(string_split_regex(p, '[ \\x09]+'), lambda x: x <> '') as w from piece),
run as (
  select lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
  from bag, (values (1), (2), (3)) as s(size)),
freq as (select lang, size, phrase, count(*) as f from run group by all),
total as (select lang, sum(f)::bigint as n from freq where size = 1 group by 1),
cand as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from freq where size > 1 and f >= 10),
inner_part as (
  select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from cand where size = 3),
longer as (select lang, phrase, max(a) as b from inner_part group by all),
kept as (
  select c.* from cand c left join longer o on o.lang = c.lang and o.phrase = c.phrase where o.b is null or 100 * o.b < 50 * c.a),
cut as (
  select kept.*, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:size], ' ') as y
  from kept, (values (1), (2)) as t(k) where k < size),
scored as (
  select cut.lang, cut.phrase, a, k, p.f as l, q.f as r, (1000000::hugeint * a * a) // (p.f::hugeint * q.f) as score
  from cut join freq p on p.lang = cut.lang and p.phrase = x join freq q on q.lang = cut.lang and q.phrase = y),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select r.lang, rank, phrase, a, l, r.r, n, score::bigint as score from ranked r join total t on t.lang = r.lang where rank <= 2000
"""


@query(_PHRASE_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("example")
