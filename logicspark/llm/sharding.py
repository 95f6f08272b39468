"""Shards of a reproducible shuffle that can be computed from a row's number alone.

Rows are numbered over the whole table in the order of a digest of id and text. A Feistel network over a grid of
``width * height`` cells, just large enough for all rows, permutes the numbers; a number that leaves the range walks on
through the network until it is back in it (cycle walking). Permuted number p goes to shard ``p mod shards``, slot
``p div shards``, so shards differ by one row at most and slots have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logicspark.llm.shared import cut, digest_bucket, id_digest, root_buckets

SHARDS = 8
ROUNDS = 6
SEED = 20_240_229
PRIME = 2_147_483_647
#: Steps of the cycle walk. A step leaves the range with a chance below 1 / sqrt(rows); under 1,600 rows no walk is
#: longer than this, above it the chance of a longer one is below 40 ** -41, and such a row fails the job.
WALK = 41


def _grid(rows: int) -> tuple[int, int]:
    width = max(1, math.isqrt(max(0, rows - 1)) + 1)
    return width, max(1, -(-rows // width))


def _constants(seed: int) -> list[tuple[int, int]]:
    """Factor and addend of each round, below the prime."""
    state, found = seed % PRIME, []
    for _ in range(ROUNDS):
        a = (state * 48_271 + 11) % PRIME
        state = (a * 48_271 + 11) % PRIME
        found.append((a | 1, state))
    return found


def _network(value: str, rows: int, seed: int) -> str:
    """SQL of the Feistel network on ``value``. State (a, b) becomes (b, a + f(b)); the round function f is the square
    of a modular product, so that the network is not linear."""
    width, height = _grid(rows)
    rounds = ", ".join(
        f"named_struct('f', {factor}L, 'c', {addend}L, 'm', {(width, height)[k % 2]}L)"
        for k, (factor, addend) in enumerate(_constants(seed))
    )
    product = f"((s.b % {PRIME}L) * r.f + r.c) % {PRIME}L"
    mixed = f"(({product}) * ({product}) + r.c) % {PRIME}L"
    return (
        f"aggregate(array({rounds}), named_struct('a', ({value}) % {width}L, 'b', ({value}) div {width}L),"
        f" (s, r) -> named_struct('a', s.b, 'b', (s.a + {mixed}) % r.m), s -> s.b * {width}L + s.a)"
    )


def permuted(number: str, rows: int, seed: int = SEED) -> Column:
    """The place in the shuffle of the row whose number (0 to rows - 1) column ``number`` holds; one to one."""
    walked = f"aggregate(sequence(1, {WALK}), {_network(number, rows, seed)}, (p, i) ->"
    walked += f" if(p < {rows}L, p, {_network('p', rows, seed)}))"
    return F.expr(f"transform(array({walked}), p -> if(p < {rows}L, p, raise_error('cycle walk too long')))[0]").cast(
        "bigint"
    )


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and row_number, from 0 without gaps, in the order of a digest of id, CRC and size.

    Rows equal in all three take neighbouring numbers in any order, which cannot be told apart."""
    sized = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        )
    )
    buckets = root_buckets(sized.count())
    spread = F.md5(F.concat_ws(":", "digest", "text_crc32", "size").cast("binary"))
    rows = sized.withColumn("digest", id_digest(F.col("doc_id"))).withColumn("bucket", digest_bucket(spread, buckets))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "text_crc32", "size"))
    return (
        rows.withColumn("inside", inside)
        .join(offsets, "bucket")
        .select("doc_id", "size", "text_crc32", (F.col("offset") + F.col("inside") - 1).alias("row_number"))
    )


def shards(docs: DataFrame, count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id, text; further columns are ignored).

    Returns doc_id, size (UTF-8 bytes + 1, a null text has none), text_crc32 (0 for null), law ('rows'), shard, slot,
    grown_shard (null, as this law moves rows when shards are added), row_number and place. Null ids count as the empty
    one, repeated rows each get a place, no rows give no rows. Results repeat on equal tables."""
    rows = cut(numbered(docs))
    return rows.withColumn("place", permuted("row_number", rows.count(), seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % count).cast("int").alias("shard"),
        F.expr(f"place div {count}").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
        "place",
    )
