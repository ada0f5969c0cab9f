"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunked_bpe, decontam, hard_negatives, langid, license, ngram_join, quality, spelling, substring, token_count, winnow
from .common import remainder, table, texts


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.digest_conversations(chat.format_turns(turns.unionByName(own)))


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (
  select *, '<s>' || replace(regexp_replace(regexp_replace(replace(role, '\', '\b'), '<(/?s>|</?SYS>>|\|[a-z_]+\|>)', '\\l\1', 'g'), '\[(/?INST\]|(?:IMAGE|AUDIO|DOCUMENT|OTHER) \d+\])', '\\o\1', 'g'), chr(10), '\n') || chr(10)
    || regexp_replace(regexp_replace(replace(text, '\', '\b'), '<(/?s>|</?SYS>>|\|[a-z_]+\|>)', '\\l\1', 'g'), '\[(/?INST\]|(?:IMAGE|AUDIO|DOCUMENT|OTHER) \d+\])', '\\o\1', 'g') || '</s>' as piece
  from t)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, piece)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, piece) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(piece)) as bigint) as formatted_chars
from p group by conv_id
"""


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents")).withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder("doc_id", 4) != 2)
    scored = quality.score(docs, quality.fit(docs.where(~F.col("held_out")), labels), ("held_out",))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 3) == 1
    model = langid.fit(texts(docs, "lang").where(~held))
    return langid.predict(texts(docs).withColumn("held_out", held), model, ("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edits(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), size=3, threshold="9/10")


OP5_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) end as s from d),
n as (select doc_id, len(s) as n from s),
u as (select doc_id, unnest(s) as g from s),
links as (
  select a.doc_id as x, b.doc_id as y from u a join u b on a.g = b.g and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
e as (select x, y from links union all select y, x from links),
r(doc_id, to_id) as (select doc_id, doc_id from n union select r.doc_id, e.y from r join e on r.to_id = e.x)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.to_id) as component_id from n join r using (doc_id) group by n.doc_id, n.n
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), keep_text=False)


OP6_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
runs as (
  select doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
low as (select h, min(doc_id) as m from runs group by h),
gone as (select doc_id, unnest(range(p, p + 50)) as k from runs join low using (h) where m < doc_id),
k as (select doc_id, list(distinct k) as ks from gone group by doc_id),
kept as (
  select d.doc_id, len(w) as n, coalesce(len(ks), 0) as r,
         case when ks is null then w else list_filter(list_transform(w, lambda x, i: case when list_contains(ks, i) then null else x end), lambda x: x is not null) end as w
  from d left join k using (doc_id))
select doc_id, cast(n as bigint) as n_words, cast(r as bigint) as n_removed, sha256(coalesce(array_to_string(w, ' '), '')) as kept_sha256 from kept
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.find_licenses(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with t(license, notice) as (values %s),
pairs_t as (
  select license, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) as pairs
  from (select license, string_split(trim(regexp_replace(lower(notice), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from t)),
d as (select row_number() over () as r, doc_id, text from documents where text is not null),
units as (
  select r, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as unit from d
  union all select r, doc_id, 0, text from d where contains(text, chr(10))),
own as (
  select r, doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) as own
  from (select r, doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from units)),
scored as (
  select r, doc_id, line, license, len(list_intersect(own, pairs)) * 2.0::double / (len(own) + len(pairs)) as dice
  from own join pairs_t on len(own) between len(pairs) * %s and len(pairs) * %s)
select doc_id, cast(line as int) as line, license, dice from scored where dice >= %s
qualify row_number() over (partition by r, line order by dice desc, license) = 1
""" % (", ".join("('%s', '%s')" % x for x in license.TEMPLATES), license.THRESHOLD / (2 - license.THRESHOLD) - 0.001, (2 - license.THRESHOLD) / license.THRESHOLD + 0.001, license.THRESHOLD)


def op7_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.find_passages(table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_edited(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), keep_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows)


OP11_SQL = """
with r as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.r, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from r a join r b on a.r <> b.r where a.vec_id % 50 = 0),
p as (
  select r, anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, other_id nulls last) as k
  from s where same qualify k <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by r, k order by score desc, other_id nulls last) as int) as rank, other_id as negative_id, positive_score, score as negative_score
from p join s using (r, anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_texts(table(spark, sf_dir, "documents"), keep_ids=False)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
with recursive crc as (
  select list(c order by b) as tab from (select b, list_reduce(range(8), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), b) as c from (select unnest(range(256)) as b))),
runs as (
  select doc_id, run, count(*) as times, any_value(hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run))) as x
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents)
  where length(run) >= 6 group by all),
hashed as (
  select run, times, xor(list_reduce(list_transform(range(1, length(x), 2), lambda k: cast('0x' || substr(x, k, 2) as bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h from runs, crc),
words as (
  select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(times) as bigint) as n
  from hashed group by 1 having length(word) >= 6 and sum(times) >= 5),
d as (select word, k, left(word, k - 1) || substr(word, k + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as k from words)),
near as (
  select a.word, b.word as other from d a join d b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select rest, word from d where rest in (select word from words)
  union select word, rest from d where rest in (select word from words)),
best as (
  select near.word, count(*) as n_near, first(other order by o.n desc, other) as other, first(o.n order by o.n desc, other) as other_n from near join words o on o.word = other group by near.word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n from words w left join best b on b.word = w.word),
chain(word, last) as (select word, word from forms union all select c.word, f.form from chain c join forms f on f.word = c.last where f.form is not null)
select f.word, f.form, c.last as root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word join forms e on e.word = c.last and e.form is null
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_compression_quality": op2_compression_quality,
    "op3_language_id": op3_language_id,
    "op4_winnowing": op4_winnowing,
    "op5_ngram_join": op5_ngram_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op7_license_passages": op7_license_passages,
    "op8_token_count": op8_token_count,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chunked_bpe": op12_chunked_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op1_chat_format": OP1_SQL, "op5_ngram_join": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_license_scan": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_spelling_variants": OP13_SQL}
