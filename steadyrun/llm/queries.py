"""The queries of this subpackage, one per operator, over the whole tables they are meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyrun.llm import (
    block_max, collocations, decontaminate, grammar, multi_index, near_dedup, ordinal, outliers, packing, placement,
    style_tree, surrogates, url_lists,
)
from steadyrun.sources.scratch import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = [f"shard-{k:04d}" for k in range(256)]
    spread = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return placement.placed(docs, F.col("doc_id"), shards, spread_by=spread).select("doc_id", "slot", "shard")


def op3_surrogates(spark: SparkSession, sf_dir: str, key: str = "steadyrun") -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.surrogated(docs, key)


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op1_repair_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = shared_dir(spark, "shards")
    docs = _table(spark, sf_dir, "documents")
    vocabulary = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    grammar.shards(docs, vocabulary, alphabet=50257, added_tokens=True).write.parquet(path)
    return grammar.read_documents(spark, path)


def op8_dominance_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocabulary = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, vocabulary, capacity=2048, added_tokens=True)


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    texts = docs.select("doc_id", F.col("text").alias("body"))
    rated = ordinal.scored(texts, ordinal.fit(docs, ratings), F.col("body"))
    return rated.select("doc_id", "scored.*", ordinal.accepted(F.col("scored"), 0.5).alias("kept"))


def op7_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.robust_outliers(_table(spark, sf_dir, "documents")).drop("distance")


#: Captures are the pages, fetched on a day taken from their number; the list's entries are dated by a hash of
#: the host they are about. Both are derived from the pages alone, in the dialect Spark and DuckDB share.
_CAPTURES = "select page_id, url, date_add(date '2023-01-01', cast(page_id * 37 % 730 as int)) as fetched from pages"
_HOSTS = """
select host, cast(conv(substring(md5(host), 1, 6), 16, 10) as int) as h
from (select distinct lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host from pages) t
where host <> ''
"""
_ENTRIES = f"""
select list_name, pattern, verdict, 'add' as action, date_add(date '2023-01-01', h % 400) as effective from listed
union all
select list_name, pattern, verdict, 'remove', date_add(date '2023-01-01', h % 400 + 60 + h % 90) from listed where h % 3 = 0
union all
select list_name, pattern, verdict, 'add', date_add(date '2023-01-01', h % 400 + 200 + h % 90) from listed where h % 6 = 0
"""
_LISTED = """
select 'hosts' as list_name, host as pattern, case when h % 5 = 0 then 'allow' else 'block' end as verdict, h
from hosts where h % 2 = 0 or host like '%pills%' or host like '%casino%'
union all
select 'domains', regexp_replace(host, '^(www|blog|m)[.]', ''), 'block', h from hosts where h % 11 = 0
union all
select 'folders', concat(host, '/de'), case when h % 4 = 0 then 'allow' else 'block' end, h from hosts where h % 7 < 3
"""


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = spark.sql(_HOSTS.replace("pages", "{pages}"), pages=pages)
    listed = spark.sql(_LISTED.replace("from hosts", "from {hosts}"), hosts=hosts)
    entries = spark.sql(_ENTRIES.replace("from listed", "from {listed}"), listed=listed)
    captures = spark.sql(_CAPTURES.replace("from pages", "from {pages}"), pages=pages)
    return url_lists.judged(captures, entries)


OP9_SQL = f"""
with hosts as (
  select host, cast(concat('0x', substring(md5(host), 1, 6)) as int) as h
  from (select distinct lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host from pages) t where host <> ''),
listed as ({_LISTED}),
entries as ({_ENTRIES.replace("date_add(date '2023-01-01', ", "(date '2023-01-01' + (").replace(") as effective", ")) as effective").replace(") from listed where", ")) from listed where")}),
days as (
  select list_name, pattern, verdict, effective as day, max(case when action = 'add' then 1 else 0 end) as listed
  from entries group by all),
turns as (
  select *, coalesce(lag(listed) over (partition by list_name, pattern, verdict order by day), 0) as before from days),
changes as (select * from turns where listed <> before),
held as (
  select *, lead(day) over (partition by list_name, pattern, verdict order by day) as until from changes),
captures as (
  select page_id, url, (date '2023-01-01' + cast(page_id * 37 % 730 as int)) as fetched,
         lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host,
         lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) as path
  from pages),
met as (
  select c.page_id, c.url, h.pattern, h.verdict,
         row_number() over (partition by c.page_id, c.url order by length(h.pattern) desc, h.verdict desc) as n
  from captures c join held h
    on h.listed = 1 and c.fetched >= h.day and (h.until is null or c.fetched < h.until)
   and (c.host = h.pattern or ends_with(c.host, concat('.', h.pattern))
        or starts_with(concat(c.host, c.path, '/'), concat(h.pattern, '/'))))
select c.page_id, c.url, c.fetched, m.verdict, m.pattern, coalesce(m.verdict <> 'block', true) as kept
from captures c left join met m on c.page_id = m.page_id and c.url = m.url and m.n = 1
"""


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extracted(_table(spark, sf_dir, "pages"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


#: Vectors that take part, as whole numbers.
_WHOLE = """
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

OP11_SQL = f"""
with whole as ({_WHOLE} and label is not null),
v as (select vec_id, e, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from whole),
scores as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
  from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 100 = 0),
positives as (
  select * from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
       cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as int) as rank,
       s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from positives p join scores s
  on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify rank <= 10
"""


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP12_SQL = f"""
with v as ({_WHOLE})
select q.vec_id as query_id,
       cast(row_number() over (partition by q.vec_id order by list_inner_product(q.e, c.e) desc, c.vec_id) as int) as rank,
       c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
qualify rank <= 5
"""


def op13_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
pieces as (select lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) as piece from texts),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as words from pieces),
placed as (select lang, words, unnest(range(1, len(words) + 1)) as i from worded),
phrases as (
  select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase
  from placed, (select unnest(range(1, 6)) as k) sizes where i + k - 1 <= len(words)),
counts as (select lang, k, phrase, count(*) as a from phrases group by all),
totals as (select lang, cast(sum(a) as bigint) as n from counts where k = 1 group by lang),
candidates as (select *, string_split(phrase, ' ') as words from counts where k >= 2 and a >= 100),
within as (
  select c.lang, array_to_string(c.words[i : i + m - 1], ' ') as phrase, max(c.a) as longer
  from candidates c, (select unnest(range(1, 5)) as i) places, (select unnest(range(2, 5)) as m) sizes
  where m < c.k and i + m - 1 <= c.k group by all),
cuts as (
  select c.lang, c.phrase, c.a, l.a as l, r.a as r, t.n,
         cast((1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a) as bigint) as score
  from candidates c join totals t on t.lang = c.lang, (select unnest(range(1, 5)) as cut) cuts
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.words[1 : cut], ' ')
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.words[cut + 1 :], ' ')
  left join within w on w.lang = c.lang and w.phrase = c.phrase
  where cut < c.k and not coalesce(100 * w.longer >= 100 * c.a, false)
  qualify row_number() over (partition by c.lang, c.phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
       phrase, a, l, r, n, score
from cuts qualify rank <= 2000
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_repair_shards": (op1_repair_shards, None),
    "op2_lookup_sharding": (op2_lookup_sharding, None),
    "op3_surrogates": (op3_surrogates, None),
    "op4_minmax_near_dedup": (op4_minmax_near_dedup, None),
    "op5_qgram_decontamination": (op5_qgram_decontamination, None),
    "op6_ordinal_quality": (op6_ordinal_quality, None),
    "op7_mcd_outliers": (op7_mcd_outliers, None),
    "op8_dominance_packing": (op8_dominance_packing, None),
    "op9_url_lists": (op9_url_lists, OP9_SQL),
    "op10_style_tree": (op10_style_tree, None),
    "op11_multi_index": (op11_multi_index, OP11_SQL),
    "op12_block_max": (op12_block_max, OP12_SQL),
    "op13_stream_collocations": (op13_stream_collocations, OP13_SQL),
}
