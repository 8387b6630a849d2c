"""One query an operator, over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seriescope.llm import chat, collocation, editcount, html, language, mixing, negatives, packing, quality, secrets, sharding, simhash, winnow
from seriescope.llm.tokens import public_vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from item_words where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as win
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from words, sizes where len(w) >= n)),
hits as (select doc_id, item_id, d.n, p from doc_windows d join item_windows i on d.n = i.n and d.win = i.win),
hit_words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
hit_items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


def op2_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


#: Bytes of a shard.
SHARD_BYTES = 1 << 20


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP4_SQL = f"""
with hashed as (
  select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
levels as (select doc_id, n_bytes, h, d, h >> (60 - d) as bucket from hashed, range(0, 61) as r(d)),
sizes as (select d, bucket, sum(n_bytes) as total from levels group by d, bucket),
leaf as (select doc_id, n_bytes, h, min(l.d) as depth from levels l join sizes s on l.d = s.d and l.bucket = s.bucket where total <= {SHARD_BYTES} group by doc_id, n_bytes, h)
select doc_id, n_bytes, cast(depth as integer) as depth, substr(lpad(bin(h), 60, '0'), 1, cast(depth as integer)) as shard from leaf
"""


def op5_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    verdicts = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return verdicts.select("doc_id", *quality.BASE, "base_failed", "kept")


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after two edits of every document: a replacement at a place that its id
    picks, and an insertion at its middle."""
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    at = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), size + 1).cast("int")
    first = F.struct(at.alias("start"), F.least(at + 12, size).cast("int").alias("end"), F.lit(" a replaced passage").alias("text"))
    second = F.struct(F.floor(size / 2).cast("int").alias("start"), F.floor(size / 2).cast("int").alias("end"), F.lit("inserted here, ").alias("text"))
    vocabulary = public_vocabulary()
    state = editcount.build(docs.withColumn("edits", F.array(first, second)), vocabulary, keep=("edits",))
    return editcount.update(state, vocabulary).select("doc_id", "n_before", "n_after", "encoded_chars")


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_vocabulary())


def op10_typed_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql("select cast(-1 as bigint) conv_id, cast(id as bigint) turn, if(id = 0, 'user', 'assistant') role, '</s>[INST] ok [/INST]' text from range(2)")
    parts = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.format_chats(parts).withColumn("turns", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), chat.text_of(t), F.lit("\n"))), "")
    loss = chat.learned(F.col("formatted"), F.col("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
grams as (
  select lang, m, array_to_string(w[p : p + m - 1], ' ') as phrase
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as p from pieces, range(1, 6) as x(m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 100),
n as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
cand as (select lang, m, phrase, string_split(phrase, ' ') as w, f as a from f where m > 1),
cuts as (select lang, phrase, a, k, array_to_string(w[1 : k], ' ') as head, array_to_string(w[k + 1 :], ' ') as rest from (select *, unnest(range(1, m)) as k from cand)),
scored as (
  select c.lang, c.phrase, c.a, n.n, x.f as l, y.f as r, (1000 * c.a::hugeint * n.n) // (x.f::hugeint * y.f) as score, k
  from cuts c join n on n.lang = c.lang join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(w[p : p + j - 1], ' ') as phrase, max(a) as longer
  from (select lang, w, a, j, unnest(range(1, m - j + 2)) as p from cand, range(2, 5) as y(j) where j < m) group by all)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
      from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where longer is null or 100 * longer < 100 * a)
where rank <= 2000
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh row has a wrong label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    rows = negatives.usable(rows)
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select * from scores where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
found as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join scores n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from found where rank <= 10
"""


def op13_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing_decontamination": op1_winnowing_decontamination,
    "op2_simhash_covering": op2_simhash_covering,
    "op3_compression_language": op3_compression_language,
    "op4_extendible_sharding": op4_extendible_sharding,
    "op5_isolation_forest": op5_isolation_forest,
    "op6_edit_aware_counts": op6_edit_aware_counts,
    "op7_entropy_secrets": op7_entropy_secrets,
    "op8_line_block_extraction": op8_line_block_extraction,
    "op9_linear_grouping_packing": op9_linear_grouping_packing,
    "op10_typed_chat_formatting": op10_typed_chat_formatting,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pivotal_mixing": op13_pivotal_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op1_winnowing_decontamination": OP1_SQL, "op4_extendible_sharding": OP4_SQL, "op11_phrase_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL}
