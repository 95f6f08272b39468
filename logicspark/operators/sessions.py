"""Capture sessions, their words, line-clock records and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logicspark.functions.scalar import BYTES_PER_PIXEL, ns_to_us
from logicspark.operators.ordered import (
    BUCKET,
    DEFAULT_WIDTH,
    asof_state,
    bucket_of,
    neighbours,
    order_key,
    running_sum,
)
from logicspark.operators.signal import edge_detect
from logicspark.schemas import CONTROL, LINE_RECORD_COLUMNS, WORDS, fields, require_columns

BY = ["capture_id"]
FILE = ["capture_id", "file_num"]


def session_asof(words: DataFrame, control: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Words while enabled, with ``enabled_at``, the enabling change they belong to; at equal times enabled holds."""
    require_columns(words, WORDS, "words")
    require_columns(control, CONTROL, "control")
    d = asof_state(
        words, control, BY, probe_time="t_ns", state_time="t_ns",
        values={"__state": "state", "enabled_at": "t_ns"}, ties=F.col("state"), width=width,
    )
    return d.filter("__state").drop("__state")


def session_numbers(sessions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Number the enabling changes that own a word 1, 2, 3... per capture."""
    d = sessions.withColumn("__order", order_key("enabled_at"))
    return running_sum(d, BY, "__order", {"file_num": F.lit(1)}, width=width).drop("__order")


def assign_sessions(words: DataFrame, control: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Words with ``file_num`` and ``byte_index``.

    A session may hold most of a capture, so its words are numbered per time bucket and
    the counts of earlier buckets are added: one small row per (session, bucket).
    """
    owned = session_asof(words, control, width)
    keyed = owned.withColumn("__order", order_key("t_ns")).withColumn(BUCKET, bucket_of("__order", width))
    counts = keyed.groupBy(*BY, "enabled_at", BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    numbers = session_numbers(counts.select(*BY, "enabled_at").distinct(), width)
    earlier = W.partitionBy(*BY, "enabled_at").orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *BY, "enabled_at", BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")
    ).join(numbers, [*BY, "enabled_at"])
    here = W.partitionBy(*BY, "enabled_at", BUCKET).orderBy("__order")
    return (
        keyed.withColumn("__row", F.row_number().over(here))
        .join(offsets, [*BY, "enabled_at", BUCKET])
        .select(
            *words.columns,
            "enabled_at",
            F.col("file_num").cast("bigint").alias("file_num"),
            (F.col("__offset") + F.col("__row") - 1).cast("bigint").alias("byte_index"),
        )
    )


def session_summary(session_words: DataFrame) -> DataFrame:
    """Words, first/last time and position of each session."""
    first, last = F.min("t_ns"), F.max("t_ns")
    return session_words.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("words"),
        ns_to_us(first).alias("start_time_us"),
        ns_to_us(last).alias("end_time_us"),
        (ns_to_us(last) - ns_to_us(first)).alias("duration_us"),
        first.alias("start_pos"),
        last.alias("end_pos"),
    )


def edge_words(edges: DataFrame, session_words: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``edges`` (capture_id, edge_t, rising) with ``file_before``, the session of the last word before each, and
    ``file_num``, ``byte_index``, ``clock_t`` of the first word at or after it; null where there is none."""
    none = F.lit(None).cast("bigint")
    both = edges.select(
        *BY, "edge_t", "rising",
        *[none.alias(c) for c in ("file_num", "byte_index", "clock_t")],
        order_key("edge_t", 0).alias("__order"),
    ).unionByName(
        session_words.select(
            *BY, none.alias("edge_t"), F.lit(None).cast("boolean").alias("rising"),
            "file_num", "byte_index", F.col("t_ns").alias("clock_t"),
            order_key("t_ns", 1).alias("__order"),
        )
    )
    found = neighbours(
        both, BY, "__order",
        back={"__file_before": F.col("file_num")},
        ahead={"__file": F.col("file_num"), "__byte": F.col("byte_index"), "__clock": F.col("clock_t")},
        width=width,
    )
    return found.filter(F.col("edge_t").isNotNull()).select(
        *BY, F.col("__file_before").alias("file_before"), F.col("__file").alias("file_num"), "edge_t", "rising",
        F.col("__byte").alias("byte_index"), F.col("__clock").alias("clock_t"),
    )


def line_edge_to_word(line_clock: DataFrame, session_words: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Line-clock edges inside a session, each with the first word at or after it.

    An edge is inside when the word before it and the word at or after it belong to the
    same session, that is first word < edge <= last word.
    """
    require_columns(session_words, fields(capture_id="string", file_num="bigint", byte_index="bigint", t_ns="bigint"))
    edges = edge_detect(line_clock, BY, width).filter(F.col("rising") | F.col("falling"))
    found = edge_words(edges.withColumnRenamed("start_time", "edge_t"), session_words, width)
    return found.filter(F.col("file_num") == F.col("file_before")).drop("file_before")


def line_records(session_edges: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """One record per rising edge, filled by the falling edge that follows it; else zeros."""
    d = session_edges.withColumn("__order", order_key("edge_t"))
    d = neighbours(
        d, FILE, "__order",
        ahead={
            "__rising": F.col("rising"), "__edge": F.col("edge_t"),
            "__byte": F.col("byte_index"), "__clock": F.col("clock_t"),
        },
        inclusive=False, width=width,
    )
    falls = F.coalesce(~F.col("__rising"), F.lit(False))

    def after(c: str):
        return F.when(falls, F.col(c)).otherwise(F.lit(0)).cast("bigint")

    values = [
        F.col("byte_index"), F.col("edge_t"), after("__byte"), after("__edge"),
        F.col("byte_index"), F.col("clock_t"), after("__byte"), after("__clock"),
    ]
    return d.filter("rising").select(
        *FILE, *[v.alias(name) for v, name in zip(values, LINE_RECORD_COLUMNS, strict=True)]
    )


def upper_median(values: DataFrame, by: list[str], value: str, name: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``sorted[n div 2]`` per key, from a histogram; no group is sorted whole."""
    histogram = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    totals = histogram.groupBy(*by).agg(F.sum("__n").alias("__total"))
    d = histogram.withColumn("__order", order_key(value))
    upto = running_sum(d, by, "__order", {"__upto": F.col("__n")}, width=width)
    return (
        upto.join(totals, by)
        .filter(F.col("__upto") > F.expr("__total div 2"))
        .groupBy(*by)
        .agg(F.min(value).alias(name))
    )


def _record_order(records: DataFrame) -> Column:
    """File order of records that were read (``seq``), else time."""
    return order_key("seq" if "seq" in records.columns else "rising_timestamp")


def line_width(records: DataFrame, by: list[str] | None = None, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Bytes per line: upper median of steps of the falling index, floored at 0."""
    by = list(by or FILE)
    d = records.select(*by, "falling_byte_index", _record_order(records).alias("__order"))
    d = neighbours(d, by, "__order", ahead={"__next": F.col("falling_byte_index")}, inclusive=False, width=width)
    steps = d.filter(F.col("__next").isNotNull()).select(
        *by, F.greatest(F.col("__next") - F.col("falling_byte_index"), F.lit(0)).alias("__step")
    )
    return upper_median(steps, by, "__step", "width", width)


def capture_index(session_words: DataFrame, records: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The index row of each session, as it goes into ``captures.csv``."""
    return (
        session_summary(session_words)
        .join(line_width(records, width=width), FILE, "left")
        .select(
            *FILE,
            F.format_string("capture_%04d.bin", "file_num").alias("filename"),
            F.col("words").alias("bytes"),
            F.coalesce("width", F.lit(0).cast("bigint")).alias("width"),
            "start_time_us", "end_time_us", "duration_us", "start_pos", "end_pos",
        )
    )


def line_offsets(
    records: DataFrame, by: list[str] | None = None, start_offset: int = 4, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Start byte of each image row; the last record only ends the row before it."""
    by = list(by or FILE)
    d = records.select(*by, "falling_byte_index", _record_order(records).alias("__order"))
    d = running_sum(d, by, "__order", {"__n": F.lit(1)}, width=width)
    last = d.groupBy(*by).agg(F.max("__n").alias("__last"))
    return d.join(last, by).filter(F.col("__n") < F.col("__last")).select(
        *by,
        (F.col("__n") - 1).cast("bigint").alias("row"),
        F.greatest(F.col("falling_byte_index") + start_offset, F.lit(0)).cast("bigint").alias("line_start"),
    )


def pixel_width(width_bytes: Column) -> Column:
    """Whole pixels of a line."""
    return F.floor(width_bytes / BYTES_PER_PIXEL)
