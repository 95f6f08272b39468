"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logicspark.llm import (
    bpe,
    chat,
    embeddings,
    fingerprints,
    language,
    mixing,
    near_copies,
    ngram_trie,
    passages,
    quality,
    repair,
    sharding,
    token_links,
)
from logicspark.llm.shared import cut, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.without_repeats(docs).select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("kept_chars"),
        F.size("removed").alias("n_removed"),
        "removed",
        "text",
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "row.doc_id",
        quality.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predicted(docs, language.fit(docs)).select(
        "doc_id", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(table(spark, sf_dir, "documents"))
    first = F.try_element_at("positions", F.lit(1)).alias("first_position")
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", first)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.formatted(turns.union(own)))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = repair.damaged(turns)
    audits = cut(repair.audited(damaged))
    digests = repair.digests(repair.repaired(damaged, audits))
    out = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for part in (audits, digests):
        own = part.withColumnRenamed("conv_id", "_conv_id")
        out = out.join(own, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")
    return out.fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}).fillna(
        0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    )


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_links.linked(table(spark, sf_dir, "documents"), *paths)


def op13_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.held_out(F.col("doc_id"), 5, 1)
    model = ngram_trie.fit(docs.where(~held_out))
    scores = ngram_trie.scored(docs.withColumn("held_out", held_out), model)
    return scores.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


OP7 = r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as digest,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
named as (
  select source, cast(sum(size) as bigint) as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 as turn
  from sized group by source),
weighted as (
  select *, 3 * source_size as cap,
         cast(case turn when 0 then 5 when 1 then 2 else 1 end as double) as weight,
         case turn when 0 then 0.0::double when 1 then 0.5::double else -0.5::double end as ramp
  from named),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source
               rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as level
  from weighted),
targets as (
  select source, source_size, ramp,
         least(cap::double, weight * (select max(level) from levels where level * weight <= cap)) as target
  from levels),
places as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, t.ramp,
         (sum(s.size) over (partition by s.source order by digest rows unbounded preceding) - s.size)::bigint
           + s.size / 2 as middle
  from sized s join targets t on s.source is not distinct from t.source),
taken as (
  select *, (middle < target)::bigint + (middle + source_size < target)::bigint
            + (middle + 2 * source_size < target)::bigint as times
  from places)
select doc_id, source, size, source_size, target, cast(times * size as bigint) as taken,
       case when times > 0 then 2 * (middle / target)
         / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (middle / target))) end as first_position
from taken
"""

OP11 = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key
  from conversations),
coded as (
  select *, xor(list_reduce(
           flatten(list_transform(string_split(key, ''),
                                  lambda c: [cast(ord(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda crc, b: case when b >= 0 then xor(crc, b) else xor(crc >> 1, 3988292384 * (crc & 1)) end,
           4294967295::bigint), 4294967295::bigint) % 20 as code
  from keyed),
damaged as (
  select conv_id, turn, k, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded cross join (values (0), (1)) copies(k)
  where code <> 0 and (k = 0 or code = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), k) as place,
         count(*) over (partition by conv_id) as n,
         regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last_char
  from damaged),
faulted as (
  select *, case when last_char = '' then 'blank'
                 when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
                 when last_char not in ('.', '!', '?') then 'truncated' else 'none' end as fault,
         substr(role, 1, 1) as initial,
         lag(substr(role, 1, 1)) over (partition by conv_id order by place) as before
  from placed),
summed as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faulted group by conv_id),
-- Costs and audits to go from each place on: nothing written (q0), after system (q1), user (q2), assistant (q3).
going as (
  select conv_id, n + 1 as place, {'c': 0, 'a': ''} as q0, {'c': 4, 'a': 'II'} as q1, {'c': 2, 'a': 'I'} as q2,
         {'c': 0, 'a': ''} as q3
  from (select distinct conv_id, n from placed)
  union all
  select conv_id, place,
         list_min([w0, {'c': 2 + w2.c, 'a': 'I' || w2.a}, {'c': 4 + w3.c, 'a': 'II' || w3.a}]),
         list_min([w1, {'c': 2 + w2.c, 'a': 'I' || w2.a}, {'c': 4 + w3.c, 'a': 'II' || w3.a}]),
         list_min([w2, {'c': 2 + w3.c, 'a': 'I' || w3.a}]),
         list_min([w3, {'c': 2 + w2.c, 'a': 'I' || w2.a}])
  from (
    select f.conv_id, f.place,
           list_min([{'c': 3 + q0.c, 'a': 'D' || q0.a}, {'c': no + 2 + t + q2.c, 'a': 'R' || q2.a},
                     {'c': no + t + case when initial = 's' then q1.c when initial = 'u' then q2.c else 1000000000 end,
                      'a': 'K' || case when initial = 's' then q1.a else q2.a end}]) as w0,
           list_min([{'c': 3 + q1.c, 'a': 'D' || q1.a}, {'c': no + 2 + t + q2.c, 'a': 'R' || q2.a},
                     {'c': no + t + case when initial = 'u' then q2.c else 1000000000 end, 'a': 'K' || q2.a}]) as w1,
           list_min([{'c': 3 + q2.c, 'a': 'D' || q2.a}, {'c': no + 2 + t + q3.c, 'a': 'R' || q3.a},
                     {'c': no + t + case when initial = 'a' then q3.c else 1000000000 end, 'a': 'K' || q3.a}]) as w2,
           list_min([{'c': 3 + q3.c, 'a': 'D' || q3.a}, {'c': no + 2 + t + q2.c, 'a': 'R' || q2.a},
                     {'c': no + t + case when initial = 'u' then q2.c else 1000000000 end, 'a': 'K' || q2.a}]) as w3
    from going g join (
           select *, case when fault in ('blank', 'duplicate') then 1000000000 else 0 end as no,
                  case when fault = 'truncated' then 1 else 0 end as t
           from faulted) f
      on f.conv_id is not distinct from g.conv_id and f.place = g.place - 1)),
audits as (select conv_id, q0.c as cost, q0.a as audit from going where place = 1),
edits as (
  select conv_id, i, substr(audit, i, 1) as edit, i - len(replace(substr(audit, 1, i), 'I', '')) as inserted
  from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as i from audits)),
outputs as (
  select e.conv_id, e.i, e.edit, f.role, f.text, f.initial,
         row_number() over (partition by e.conv_id order by e.i) - 1 as o,
         first_value(e.edit = 'K' and f.initial = 's') over (partition by e.conv_id order by e.i) as opened
  from edits e left join faulted f
    on e.edit <> 'I' and f.conv_id is not distinct from e.conv_id and f.place = e.i - e.inserted
  where e.edit <> 'D'),
hashed as (
  select conv_id, sha256(string_agg(
           case when edit = 'K' then role when (o - opened::int) % 2 = 0 then 'user' else 'assistant' end
           || ':' || case when edit = 'I' then '' else text end, chr(10) order by i)) as repaired_sha256
  from outputs group by conv_id)
select c.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0)::bigint as blank,
       coalesce(s.duplicate, 0)::bigint as duplicate, coalesce(s.truncated, 0)::bigint as truncated,
       coalesce(s.illegal, 0)::bigint as illegal, coalesce(a.cost, 0)::bigint as cost, coalesce(a.audit, '') as audit,
       coalesce(h.repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join summed s on s.conv_id is not distinct from c.conv_id
left join audits a on a.conv_id is not distinct from c.conv_id
left join hashed h on h.conv_id is not distinct from c.conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_repeats": op2_repeats,
    "op3_embeddings": op3_embeddings,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_near_copies": op9_near_copies,
    "op10_chat": op10_chat,
    "op11_repair": op11_repair,
    "op12_token_links": op12_token_links,
    "op13_trie_scores": op13_trie_scores,
}
ORACLES: dict[str, str] = {"op7_mixing": OP7, "op11_repair": OP11}
