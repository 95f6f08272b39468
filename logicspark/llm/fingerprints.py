"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into tokens; each run of ``WIDTH`` tokens is a k-mer, labelled with its number among equal k-mers of the
text. The hashes of labelled k-mers lie on a ring. Each of ``SKETCHES`` equally spaced marks selects the ``2`` minimal
hashes at or after it (walking round the ring), puts these k-mers back in text order and hashes the ordered tuple. The
likeness of two fingerprints is the share of equal tuples: it falls when k-mers change, are repeated or change places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logicspark.llm.shared import cut

WIDTH = 3
SKETCH_BITS = 6
SKETCHES = 1 << SKETCH_BITS
#: Low bits of a packed k-mer hold its position. Positions beyond 2^24 repeat, which only blurs order there.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Texts of longer tokens than this on average are cut into pieces of PIECE code points instead.
LONG_TOKENS = 32
PIECE = 8


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with array column ``out`` of SKETCHES integers for the string column ``text`` (null: empty).

    Texts of fewer than WIDTH tokens have one short k-mer, the empty text that of the empty token."""
    kept = [F.col(f"`{c}`") for c in df.columns]

    def step(name: str, expression: str) -> None:
        nonlocal df
        df = df.select(*kept, *[c for c in carried], F.expr(expression).alias(name))

    carried: list[str] = []
    step("_words", f"split(coalesce({text}, ''), '[ \\\\t\\\\n\\\\r\\\\f]+')")
    step(
        "_tokens",
        f"if(char_length(coalesce({text}, '')) > {LONG_TOKENS} * size(_words),"
        f" regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0), _words)",
    )
    step("_hashes", "transform(_tokens, t -> xxhash64(t))")
    following = ", ".join(f"get(_hashes, i + {k})" for k in range(1, WIDTH))
    step(
        "_kmers",
        f"sort_array(transform(slice(_hashes, 1, greatest(size(_hashes) - {WIDTH - 1}, 1)),"
        f" (h, i) -> (xxhash64(h, {following}) & {~PLACE}L) | (i & {PLACE})))",
    )
    carried = ["_kmers"]
    step(
        "_runs",
        "filter(sequence(0, size(_kmers) - 1), i -> i = 0"
        f" or shiftright(_kmers[i], {PLACE_BITS}) <> shiftright(_kmers[i - 1], {PLACE_BITS}))",
    )
    labelled = (
        "transform(slice(_kmers, s + 1, coalesce(get(_runs, j + 1), size(_kmers)) - s),"
        f" (x, nth) -> (xxhash64(shiftright(x, {PLACE_BITS}), nth) & {~PLACE}L) | (x & {PLACE}))"
    )
    carried = []
    step("_ring", f"sort_array(flatten(transform(_runs, (s, j) -> {labelled})))")
    carried = ["_ring"]
    part = f"(shiftright({{}}, {64 - SKETCH_BITS}) + {SKETCHES // 2})"
    step(
        "_heads",
        "filter(sequence(0, size(_ring) - 1), i -> i = 0"
        f" or {part.format('_ring[i]')} <> {part.format('_ring[i - 1]')})",
    )
    carried = ["_ring"]
    step(
        "_first",
        f"concat(flatten(transform(_heads, (s, j) -> array_repeat(s, int({part.format('_ring[s]')}"
        f" - if(j = 0, -1, {part.format('_ring[_heads[greatest(j - 1, 0)]]')}))))),"
        f" array_repeat(0, int({SKETCHES - 1} - {part.format('_ring[size(_ring) - 1]')})))",
    )
    tuple_hash = (
        f"transform(array(struct(_ring[s] as x, _ring[(s + 1) % size(_ring)] as y)), p -> if((p.x & {PLACE}) <="
        f" (p.y & {PLACE}), xxhash64(shiftright(p.x, {PLACE_BITS}), shiftright(p.y, {PLACE_BITS})),"
        f" xxhash64(shiftright(p.y, {PLACE_BITS}), shiftright(p.x, {PLACE_BITS}))))[0]"
    )
    carried = []
    step(out, f"transform(_first, s -> int(shiftright({tuple_hash}, 32)))")
    return df


def likeness(a: str, b: str):
    """Share of equal entries of two fingerprints, 0 to 1."""
    return F.expr(f"size(filter(sequence(0, {SKETCHES - 1}), i -> {a}[i] = {b}[i])) / {float(SKETCHES)}D")


def as_text(fingerprint_column: str):
    return F.expr(f"array_join(transform({fingerprint_column}, x -> lpad(lower(hex(x & 4294967295L)), 8, '0')), '')")


def successors(rows: DataFrame) -> DataFrame:
    """Each row's next row by (place, key), the last one's being the first: columns plus next_place, next_key.

    Rows are ranged over partitions; windows run inside a partition, and only the first row of each meets the others."""
    ranged = cut(rows.repartitionByRange("place", "key").withColumn("part", F.spark_partition_id()))
    here = F.struct("place", "key")
    after = F.lead(here).over(Window.partitionBy("part").orderBy("place", "key"))
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    everything = Window.orderBy("part")
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition, so this table is bounded by their number.
    firsts = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(everything), F.first("first").over(whole)).alias("other"),
    )
    found = ranged.withColumn("after", after).join(F.broadcast(firsts), "part")
    following = F.coalesce("after", "other")
    return found.select(
        *rows.columns, following["place"].alias("next_place"), following["key"].alias("next_key")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text; further columns are ignored) and of its edited text.

    The edited text has its last quarter (floor of code points / 4) replaced by as much of the start of the next
    document. Null texts count as empty. Null ids come first; rows of one id follow by a hash of their text, and rows
    equal in both count as one document in that order but each give a row. A lone document follows itself. No rows give
    no rows. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, by id; the needed start of each text once more, at most a quarter of the next one's length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("place"), F.xxhash64(text).alias("key"), text.alias("text"))
    order = successors(base.select("place", "key", F.expr("char_length(text) div 4").alias("need")).distinct())
    prints = fingerprint(base, "text", "print")
    wanted = order.select(
        F.col("next_place").alias("place"),
        F.col("next_key").alias("key"),
        F.col("place").alias("for_place"),
        F.col("key").alias("for_key"),
        "need",
    )

    def same(other: DataFrame):
        return prints["place"].eqNullSafe(other["place"]) & (prints["key"] == other["key"])

    # Both joins read texts and fingerprints with equal columns by equal keys, so one shuffle serves both.
    starts = (
        prints.join(wanted, same(wanted))
        .groupBy(F.col("for_place").alias("place"), F.col("for_key").alias("key"))
        .agg(
            F.first(F.expr("substring(text, 1, need)")).alias("start"),
            F.first("print").alias("next_print"),
        )
    )
    joined = prints.join(starts, same(starts)).select(
        prints["place"].alias("doc_id"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.expr("concat(left(text, char_length(text) - char_length(text) div 4), start)").alias("edited"),
        "print",
        "next_print",
    )
    joined = joined.select("doc_id", "n_chars", "edited", "print", "next_print")
    both = fingerprint(joined, "edited", "edited_print")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("print").alias("fingerprint"),
        as_text("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
    )
