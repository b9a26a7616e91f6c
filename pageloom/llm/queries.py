"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, langid, minhash, negatives, neighbours, packing, quality, sharding, simhash, tokens, urls
from .batches import read

#: Bytes of text that a shard holds at most.
SHARD_BYTES = 1 << 20
#: What op3's query judges by, before the trained model.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    index = neighbours.Index(table)
    try:
        return index.search(table.where("vec_id % 50 = 0"), 5, id_col="vec_id", vec_col="embedding")
    finally:
        index.close()  # what was found is checkpointed


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"), words=3, radius=3)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.scorer(docs, read(spark, sf_dir, "labels"), ~langid.in_fold("id", 3, 1))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", langid.in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"), SHARD_BYTES, keep=["doc_id"])


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(read(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.in_fold("doc_id", 5, 0)))
    found = langid.identify(docs, model, ["doc_id"])
    return found.select("doc_id", langid.in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "margin", "fit")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(read(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("bigint").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return negatives.mined(read(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), whole.alias("vec")), "id % 50 = 0")


QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_token_counts, op3_url_filter, op4_simhash, op5_quality, op6_extendible_shards, op7_qgram_decontamination, op8_sum_of_squares, op9_quotation_linking, op10_language_id, op11_minhash, op12_fill_in_middle, op13_hard_negatives)}

#: The shortest prefix of the hash bits whose documents fit a shard; documents of equal hashes are taken to fit.
SHARD_SQL = f"""
with recursive rows_ as (
  select doc_id, cast(coalesce(octet_length(encode(text)), 0) as bigint) n_bytes,
         cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) h from documents),
bucket as (
  select 0 depth, cast(0 as bigint) p, cast(sum(n_bytes) as bigint) bytes from rows_
  union all
  select c.depth, c.p, c.bytes from (
    select b.depth + 1 depth, r.h >> (59 - b.depth) p, cast(sum(r.n_bytes) as bigint) bytes
    from bucket b join rows_ r on (r.h >> (60 - b.depth)) = b.p
    where b.bytes > {SHARD_BYTES} and b.depth < 60 group by b.depth, r.h >> (59 - b.depth)) c)
select r.doc_id, r.n_bytes, substr(lpad(bin(r.h), 60, '0'), 1, b.depth) shard, cast(b.depth as integer) "depth"
from rows_ r join bucket b on (r.h >> (60 - b.depth)) = b.p where b.bytes <= {SHARD_BYTES}"""

#: The units as a list, cut by position; what is rebuilt is the text itself.
FIM_SQL = """
with units as (
  select doc_id, coalesce(text, '') text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) d,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') u from documents),
drawn as (
  select *, len(u) n, cast(('0x' || d[1:8]) as bigint) h1, cast(('0x' || d[9:16]) as bigint) h2, cast(('0x' || d[17:24]) as bigint) h3, cast(('0x' || d[25:32]) as bigint) h4 from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from drawn),
parts as (
  select doc_id, cast(n as bigint) n, form, text, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from cut)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
       sha256(case form when 'plain' then text else p || m || s end) restored_sha256 from parts"""

#: All documents' shingles meet: links from shared shingles, components from links.
MINHASH_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
shingles as (
  select doc_id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from words where len(w) > 0),
each_ as (select doc_id, hash(unnest(s)) h, len(s) n from shingles),
links as (
  select a.doc_id x, b.doc_id y from each_ a join each_ b on a.h = b.h and a.doc_id <> b.doc_id
  where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached as (
  select doc_id x, doc_id y from words
  union
  select r.x, l.y from reached r join links l on r.y = l.x),
least_ as (select x doc_id, min(y) component_id from reached group by x)
select w.doc_id, cast(coalesce(len(s.s), 0) as bigint) n_shingles, component_id, w.doc_id = component_id kept
from words w join least_ using (doc_id) left join shingles s using (doc_id)"""

#: Every anchor with all rows.
NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, cast(list_inner_product(a.v, b.v) as bigint) score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (select anchor_id, other_id positive_id, score positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as integer) "rank", other_id negative_id, positive_score, score negative_score
from positives p join scores s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) <= 3"""

ORACLE_SQL = {"op11_minhash": MINHASH_SQL, "op13_hard_negatives": NEGATIVES_SQL, "op12_fill_in_middle": FIM_SQL, "op6_extendible_shards": SHARD_SQL}
