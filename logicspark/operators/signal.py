"""Packed blocks, runs and edges of one-bit lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logicspark.functions.scalar import bit_of
from logicspark.operators.ordered import DEFAULT_WIDTH, neighbours, order_key
from logicspark.schemas import BLOCKS, LEVELS, LINE_RUNS, RUNS, fields, require_columns

LINE = ["capture_id", "channel"]
BATCH_ROWS = 1 << 16  # rows that a task hands back at once, however large a block is


def _bits(data: bytes, count: int) -> np.ndarray:
    """``count`` samples of a packed block; samples past its bytes are 0."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:count]
    return bits if len(bits) == count else np.pad(bits, (0, count - len(bits)))


def first_bit(blocks: DataFrame) -> Column:
    """First bit of a block, from its own column where the table has one."""
    return blocks["first"] if "first" in blocks.columns else bit_of(blocks.data, F.lit(0).cast("bigint"))


def last_bit(blocks: DataFrame) -> Column:
    return blocks["last"] if "last" in blocks.columns else bit_of(blocks.data, blocks.num_samples - 1)


def project_channels(blocks: DataFrame, channels: Sequence[int], total_probes: int | None = None) -> DataFrame:
    """Keep the wanted channels; prunes partitions of a table laid out by channel."""
    if not 1 <= len(set(channels)) <= 16:
        raise ValueError(f"between 1 and 16 channels, got {len(set(channels))}")
    if min(channels) < 0 or max(channels) > 15:
        raise ValueError(f"channels are 0 to 15, got {sorted(set(channels))}")
    if total_probes is not None and total_probes <= max(channels):
        raise ValueError(f"capture has only {total_probes} channels, need at least {max(channels) + 1}")
    return blocks.filter(F.col("channel").isin(sorted(set(channels))))


def bound_blocks(blocks: DataFrame, max_samples: int | None) -> DataFrame:
    """Cap the samples per channel: drop whole blocks past the cap, cut the last one."""
    require_columns(blocks, BLOCKS, "bound_blocks")
    if max_samples is None:
        return blocks
    left = F.lit(max_samples) - F.col("start_position")
    # a stored last bit would no longer be that of the cut block
    return blocks.drop("last").filter(F.col("start_position") < max_samples).withColumn(
        "num_samples", F.least("num_samples", left)
    )


def block_bounds(blocks: DataFrame) -> DataFrame:
    """End position and start/end time of each block."""
    end = F.col("start_position") + F.col("num_samples")
    return blocks.withColumns(
        {
            "end_position": end,
            "start_ns": F.col("start_position") * F.col("timestamp_step"),
            "end_ns": end * F.col("timestamp_step"),
        }
    )


def unpack_bits(blocks: DataFrame) -> DataFrame:
    """One row per sample. Use only where every sample is wanted."""
    require_columns(blocks, BLOCKS, "unpack_bits")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bits = _bits(row["data"], row["num_samples"]).astype(bool)
                for begin in range(0, len(bits), BATCH_ROWS):
                    part = bits[begin : begin + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(row["capture_id"], len(part)),
                            pa.repeat(pa.scalar(row["channel"], pa.int32()), len(part)),
                            pa.array(np.arange(len(part), dtype=np.int64) + row["start_position"] + begin),
                            pa.array(part),
                        ],
                        names=LEVELS.names,
                    )

    return blocks.select("capture_id", "channel", "data", "start_position", "num_samples").mapInArrow(
        unpack, LEVELS
    )


def pack_levels(levels: DataFrame, samples_per_block: int, timestamp_step: int) -> DataFrame:
    """Sample rows to packed blocks, least significant bit first, all in SQL."""
    require_columns(levels, LEVELS, "pack_levels")
    if samples_per_block % 8:
        raise ValueError("samples_per_block must be a multiple of 8")
    position = F.col("position")
    bytes_ = (
        levels.withColumn("byte_no", F.expr("position div 8"))
        .groupBy(*LINE, "byte_no")
        .agg(
            F.bit_or(F.expr("shiftleft(cast(value as int), cast(position % 8 as int))")).alias("byte"),
            F.max(position).alias("last_position"),
        )
    )
    per_block = samples_per_block // 8
    block = F.col("block_num")
    return (
        bytes_.withColumn("block_num", F.expr(f"byte_no div {per_block}"))
        .groupBy(*LINE, "block_num")
        .agg(
            F.array_sort(F.collect_list(F.struct("byte_no", F.format_string("%02X", "byte").alias("x")))).alias("xs"),
            F.max("last_position").alias("last_position"),
        )
        .select(
            *LINE,
            "block_num",
            F.unhex(F.concat_ws("", F.col("xs.x"))).alias("data"),
            (block * samples_per_block).alias("start_position"),
            (F.col("last_position") + 1 - block * samples_per_block).alias("num_samples"),
            F.lit(timestamp_step).cast("bigint").alias("timestamp_step"),
        )
    )


def runs_from_levels(levels: DataFrame, timestamp_step: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Runs of a table of samples: keep a sample when it differs from the one before."""
    require_columns(levels, LEVELS, "runs_from_levels")
    d = levels.withColumn("__t", F.col("position") * timestamp_step).withColumn("__order", order_key("__t"))
    d = neighbours(d, LINE, "__order", back={"__before": F.col("value")}, inclusive=False, width=width)
    return d.filter(F.col("__before").isNull() | (F.col("__before") != F.col("value"))).select(
        *LINE, "value", F.col("__t").alias("start_time")
    )


def _interior_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Value changes inside each block, stamped with the changed sample."""
    for batch in batches:
        for row in batch.to_pylist():
            bits = _bits(row["data"], row["num_samples"])
            every = np.flatnonzero(bits[1:] != bits[:-1]) + 1
            for begin in range(0, len(every), BATCH_ROWS):
                at = every[begin : begin + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(row["capture_id"], len(at)),
                        pa.repeat(pa.scalar(row["channel"], pa.int32()), len(at)),
                        pa.array(bits[at].astype(bool)),
                        pa.array((at + row["start_position"]) * row["timestamp_step"]),
                    ],
                    names=RUNS.names,
                )


def edge_runs(blocks: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Blocks to runs of equal value, stamped with their start.

    Changes inside a block need no neighbour, so they never shuffle. Whether a block
    opens a run is decided on its first bit and the last bit of the block before,
    one small row per block joined on ``block_num - 1``. ``tails`` (capture_id,
    channel, block_num, last) gives last bits of blocks that came earlier.
    """
    require_columns(blocks, BLOCKS, "edge_runs")
    blocks = blocks.filter("num_samples > 0")
    interior = blocks.select(
        "capture_id", "channel", "data", "start_position", "num_samples", "timestamp_step"
    ).mapInArrow(_interior_edges, RUNS)
    return interior.unionByName(opening_runs(blocks, tails))


def last_bits(blocks: DataFrame) -> DataFrame:
    """(capture_id, channel, block_num, last) of every block."""
    return blocks.select(*LINE, "block_num", last_bit(blocks).alias("last"))


def opening_runs(blocks: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Runs that begin on the first sample of a block."""
    edges = blocks.select(
        *LINE, "block_num", first_bit(blocks).alias("first"),
        (F.col("start_position") * F.col("timestamp_step")).alias("start_time"),
    )
    ends = last_bits(blocks) if tails is None else last_bits(blocks).unionByName(tails)
    before = ends.select(*LINE, (F.col("block_num") + 1).alias("block_num"), F.col("last").alias("before"))
    return (
        edges.join(before, [*LINE, "block_num"], "left")
        .filter(F.col("before").isNull() | (F.col("before") != F.col("first")))
        .select(*LINE, (F.col("first") == 1).alias("value"), "start_time")
    )


def run_bounds(runs: DataFrame, by: Sequence[str] = LINE, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add ``next_start``, the end of each run; the last run has none."""
    require_columns(runs, LINE_RUNS, "run_bounds")
    d = runs.withColumn("__order", order_key("start_time"))
    d = neighbours(d, by, "__order", ahead={"next_start": F.col("start_time")}, inclusive=False, width=width)
    return d.drop("__order")


def edge_detect(runs: DataFrame, by: Sequence[str] = LINE, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add ``rising`` and ``falling``; the level before the first run is low."""
    require_columns(runs, LINE_RUNS, "edge_detect")
    d = runs.withColumn("__order", order_key("start_time"))
    d = neighbours(d, by, "__order", back={"__before": F.col("value")}, inclusive=False, width=width)
    before = F.coalesce("__before", F.lit(False))
    return d.withColumns(
        {"rising": ~before & F.col("value"), "falling": before & ~F.col("value")}
    ).drop("__order", "__before")


def asof_level(
    probe: DataFrame, runs: DataFrame, time: str, name: str = "level",
    by: Sequence[str] = ("capture_id",), width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Level of a line at each probe time; the last run reaches to infinity."""
    from logicspark.operators.ordered import asof_state

    return asof_state(
        probe, runs, by, probe_time=time, state_time="start_time", values={name: "value"}, width=width
    )


def probe_bits(blocks: DataFrame, header: DataFrame, keys: DataFrame) -> DataFrame:
    """Look up (capture_id, channel, position) keys; bad keys get a ``status``, not an error."""
    require_columns(keys, fields(capture_id="string", channel="int", position="bigint"), "probe_bits keys")
    facts = header.select("capture_id", "total_probes", "total_samples", "total_blocks", "samples_per_block")
    located = keys.join(facts, "capture_id", "left").withColumn(
        "block_num", F.expr("position div samples_per_block")
    )
    # Packed bytes meet only the keys' blocks, and only those few go on to the keys.
    asked = located.select(*LINE, "block_num").distinct()
    hit = blocks.select(*LINE, "block_num", "data").join(asked, [*LINE, "block_num"], "left_semi")
    inside = F.pmod(F.col("position"), F.col("samples_per_block"))
    status = (
        F.when(F.col("total_probes").isNull(), "unknown_capture")
        .when((F.col("channel") < 0) | (F.col("channel") >= F.col("total_probes")), "invalid_probe")
        .when((F.col("position") < 0) | (F.col("position") >= F.col("total_samples")), "out_of_bounds")
        .when(F.col("block_num") >= F.col("total_blocks"), "out_of_bounds")
        .when(F.col("data").isNull(), "invalid_block")
        .otherwise("ok")
    )
    return (
        located.join(hit, [*LINE, "block_num"], "left")
        .withColumn("status", status)
        .select(
            *keys.columns,
            "status",
            F.when(F.col("status") == "ok", bit_of(F.col("data"), inside)).alias("bit"),
        )
    )


def count_runs(runs: DataFrame, maximum: int | None = None) -> DataFrame:
    """Run rows per channel, counted up to ``maximum``."""
    counted = runs.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n_runs"))
    if maximum is None:
        return counted
    return counted.withColumn("n_runs", F.least("n_runs", F.lit(maximum).cast("bigint")))
