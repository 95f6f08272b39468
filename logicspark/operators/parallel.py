"""Parallel-bus words: strobe triggers, chip-select gate, data bits of one position.

Packed blocks of one block number are brought together in a single shuffle; bit work
is done on whole blocks with NumPy, so only triggered positions become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logicspark.functions.scalar import bit_of, ns_to_us
from logicspark.operators.ordered import DEFAULT_WIDTH, asof_state
from logicspark.operators.signal import BATCH_ROWS, _bits, first_bit, last_bit, last_bits
from logicspark.schemas import BLOCKS, CONTROL, CsPolarity, StrobeMode, fields, require_columns

_TRIGGERS = fields(capture_id="string", position="bigint", t_ns="bigint")
_WORDS = fields(capture_id="string", position="bigint", value="bigint", t_ns="bigint")
_PREVIOUS = -1  # pseudo channel holding the strobe level before the block


def _triggered(bits: np.ndarray, previous: np.ndarray, mode: StrobeMode) -> np.ndarray:
    if mode is StrobeMode.RISING:
        return (previous == 0) & (bits == 1)
    if mode is StrobeMode.FALLING:
        return (previous == 1) & (bits == 0)
    if mode is StrobeMode.ANY:
        return previous != bits
    return bits == (1 if mode is StrobeMode.HIGH else 0)


def strobe_triggers(blocks: DataFrame, strobe: int, mode: StrobeMode) -> DataFrame:
    """Positions at which the strobe line triggers; the level before the capture is low.

    Only the first sample of a block needs the block before, and that is decided on one
    small row per block, so packed data is never shuffled.
    """
    require_columns(blocks, BLOCKS, "strobe_triggers")
    line = blocks.filter((F.col("channel") == strobe) & (F.col("num_samples") > 0))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bits = _bits(row["data"], row["num_samples"])
                every = np.flatnonzero(_triggered(bits[1:], bits[:-1], mode)) + 1 + row["start_position"]
                for begin in range(0, len(every), BATCH_ROWS):
                    at = every[begin : begin + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(row["capture_id"], len(at)),
                            pa.array(at),
                            pa.array(at * row["timestamp_step"]),
                        ],
                        names=_TRIGGERS.names,
                    )

    edges = line.select(
        "capture_id", "block_num", first_bit(line).alias("first"), last_bit(line).alias("last"),
        F.col("start_position").alias("position"),
        (F.col("start_position") * F.col("timestamp_step")).alias("t_ns"),
    )
    before = edges.select("capture_id", (F.col("block_num") + 1).alias("block_num"), F.col("last").alias("previous"))
    first, previous = F.col("first"), F.coalesce("previous", F.lit(0))
    opening = {
        StrobeMode.RISING: (previous == 0) & (first == 1),
        StrobeMode.FALLING: (previous == 1) & (first == 0),
        StrobeMode.ANY: previous != first,
        StrobeMode.HIGH: first == 1,
        StrobeMode.LOW: first == 0,
    }[mode]
    at_start = edges.join(before, ["capture_id", "block_num"], "left").filter(opening).select(*_TRIGGERS.names)
    rest = line.select("capture_id", "data", "start_position", "num_samples", "timestamp_step").mapInArrow(
        inside, _TRIGGERS
    )
    return rest.unionByName(at_start)


def cs_inactive_gate(triggers: DataFrame, blocks: DataFrame, cs: int, polarity: CsPolarity) -> DataFrame:
    """Keep triggers at which chip-select is inactive (the bus side uses it inverted).

    Triggers meet the chip-select bytes of their block number in one task, where the bytes come first and once; no row
    carries them along. A trigger that no block covers goes.
    """
    if polarity is CsPolarity.DISABLED:
        return triggers
    idle = 1 if polarity is CsPolarity.ACTIVE_LOW else 0
    size = blocks.groupBy("capture_id").agg(F.max("num_samples").alias("__size"))
    trigger = F.struct(*[F.col(f"`{c}`") for c in triggers.columns])
    asked = triggers.filter(F.col("position").isNotNull()).join(size, "capture_id").select(
        "capture_id", F.expr("position div __size").alias("block_num"), "position", trigger.alias("trigger")
    )
    line = blocks.filter(F.col("channel") == cs).select("capture_id", "block_num", "data", "start_position", "num_samples")
    key = ["capture_id", "block_num"]
    met = asked.unionByName(line, allowMissingColumns=True).withColumn("__asks", F.col("data").isNull())
    dealt = met.repartition(*key).sortWithinPartitions(*key, "__asks").drop("__asks")

    def gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, start, bits = None, 0, np.zeros(0, np.uint8)
        for batch in batches:
            captures, numbers = batch.column("capture_id").to_pylist(), batch.column("block_num").to_pylist()
            positions = batch.column("position").fill_null(-1).to_numpy()
            keep = np.zeros(len(batch), bool)
            held = np.flatnonzero(positions < 0)
            for begin, end in zip(np.r_[0, held], np.r_[held, len(batch)], strict=True):
                begin = int(begin)
                if begin < end and positions[begin] < 0:
                    row = batch.slice(begin, 1).to_pylist()[0]
                    of, start = (row["capture_id"], row["block_num"]), row["start_position"]
                    bits = _bits(row["data"], row["num_samples"])
                    begin += 1
                here = np.array([x == of for x in zip(captures[begin:end], numbers[begin:end], strict=True)], bool)
                at = positions[begin:end] - start
                here &= (at >= 0) & (at < len(bits))
                here[here] = bits[at[here]] == idle
                keep[begin:end] = here
            yield pa.RecordBatch.from_arrays([batch.column("trigger").filter(pa.array(keep))], names=["trigger"])

    kept = dealt.select(*key, "position", "trigger", "data", "start_position", "num_samples")
    schema = T.StructType([T.StructField("trigger", kept.schema["trigger"].dataType)])
    return kept.mapInArrow(gate, schema).select("trigger.*")


def align_blocks(
    blocks: DataFrame, channels: Sequence[int], strobe: int | None = None, tails: DataFrame | None = None
) -> DataFrame:
    """One row per block number with the packed bytes of every wanted channel.

    A missing or misaligned channel fails the job. With ``strobe``, its level just
    before the block comes along under channel -1.
    """
    require_columns(blocks, BLOCKS, "align_blocks")
    wanted = sorted(set(channels))
    rows = blocks.filter(F.col("channel").isin(wanted)).select(
        "capture_id", "block_num", "channel", "data", "start_position", "num_samples", "timestamp_step"
    )
    if strobe is not None:
        line = last_bits(blocks.filter(F.col("channel") == strobe))
        if tails is not None:
            line = line.unionByName(tails.filter(F.col("channel") == strobe))
        none = F.lit(None).cast("bigint")
        rows = rows.unionByName(
            line.select(
                "capture_id",
                (F.col("block_num") + 1).alias("block_num"),
                F.lit(_PREVIOUS).alias("channel"),
                F.unhex(F.format_string("%02X", "last")).alias("data"),
                none.alias("start_position"),
                none.alias("num_samples"),
                none.alias("timestamp_step"),
            )
        )
    real = F.col("channel") >= 0
    grouped = (
        rows.groupBy("capture_id", "block_num")
        .agg(
            F.collect_list(F.struct("channel", "data")).alias("__parts"),
            F.count(F.when(real, 1)).alias("__n"),
            F.min("start_position").alias("start_position"),
            F.max("start_position").alias("__high"),
            F.max(F.when(F.col("channel") == (wanted[0] if strobe is None else strobe), F.col("num_samples"))).alias(
                "num_samples"
            ),
            F.max("timestamp_step").alias("timestamp_step"),
        )
        .filter(F.col("__n") > 0)
    )
    problem = F.concat(F.lit("misaligned or missing channel in block "), F.col("block_num").cast("string"))
    return grouped.select(
        "capture_id",
        "block_num",
        F.when(
            (F.col("__n") == len(wanted)) & (F.col("__high") == F.col("start_position")),
            F.map_from_entries("__parts"),
        )
        .otherwise(F.raise_error(problem).cast("map<int,binary>"))
        .alias("channels"),
        "start_position",
        "num_samples",
        "timestamp_step",
    )


def parallel_words(
    blocks: DataFrame,
    *,
    strobe: int,
    data: Sequence[int],
    cs: int | None = None,
    mode: StrobeMode = StrobeMode.RISING,
    polarity: CsPolarity = CsPolarity.DISABLED,
    control: DataFrame | None = None,
    tails: DataFrame | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Words on the bus: trigger, then chip-select, then data line i as bit i, then enable.

    64-bit values are two's complement. Without ``control`` the bus is always enabled.
    """
    _check_lines(data, cs, polarity)
    channels = [strobe, *data, *([] if polarity is CsPolarity.DISABLED else [cs])]
    aligned = align_blocks(blocks.filter("num_samples > 0"), channels, strobe, tails)
    words = _decode(aligned, strobe, data, cs, mode, polarity)
    return words if control is None else enable_gate(words, control, width=width)


def decode_aligned(
    aligned: DataFrame,
    *,
    strobe: int,
    data: Sequence[int],
    cs: int | None = None,
    mode: StrobeMode = StrobeMode.RISING,
    polarity: CsPolarity = CsPolarity.DISABLED,
    control: DataFrame | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """``parallel_words`` over blocks that are already aligned, as an archive scan gives them.

    An archive scan knows the levels before each block (column ``previous``), so nothing moves. For other tables they
    are joined by block number.
    """
    _check_lines(data, cs, polarity)
    if "previous" in aligned.columns:
        level = F.unhex(F.format_string("%02X", F.coalesce(F.element_at("previous", F.lit(strobe)), F.lit(0))))
        known = aligned.withColumn("channels", F.map_concat("channels", F.create_map(F.lit(_PREVIOUS), level)))
        words = _decode(known, strobe, data, cs, mode, polarity)
        return words if control is None else enable_gate(words, control, width=width)
    line = F.element_at("channels", F.lit(strobe))
    last = bit_of(line, F.col("num_samples") - 1)
    before = aligned.select(
        "capture_id", (F.col("block_num") + 1).alias("block_num"), F.unhex(F.format_string("%02X", last)).alias("__before")
    )
    joined = aligned.join(before, ["capture_id", "block_num"], "left").withColumn(
        "channels",
        F.when(
            F.col("__before").isNotNull(),
            F.map_concat("channels", F.create_map(F.lit(_PREVIOUS), F.col("__before"))),
        ).otherwise(F.col("channels")),
    )
    words = _decode(joined, strobe, data, cs, mode, polarity)
    return words if control is None else enable_gate(words, control, width=width)


def _check_lines(data: Sequence[int], cs: int | None, polarity: CsPolarity) -> None:
    if not 1 <= len(data) <= 64:
        raise ValueError(f"1 to 64 data lines, got {len(data)}")
    if polarity is not CsPolarity.DISABLED and cs is None:
        raise ValueError("a chip-select polarity needs a chip-select channel")


def _decode(
    aligned: DataFrame, strobe: int, data: Sequence[int], cs: int | None, mode: StrobeMode, polarity: CsPolarity
) -> DataFrame:
    gated = polarity is not CsPolarity.DISABLED
    idle = 1 if polarity is CsPolarity.ACTIVE_LOW else 0
    lines = list(data)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["num_samples"]
                packed = dict(row["channels"])
                bits = _bits(packed[strobe], n)
                before = packed.get(_PREVIOUS, b"\0")[0]
                hit = _triggered(bits, np.r_[np.uint8(before), bits[:-1]], mode)
                if gated:
                    hit &= _bits(packed[cs], n) == idle
                every = np.flatnonzero(hit)
                if not len(every):
                    continue
                values = np.zeros(len(every), np.uint64)
                for i, channel in enumerate(lines):  # one line unpacked at a time
                    values |= _bits(packed[channel], n)[every].astype(np.uint64) << np.uint64(i)
                for begin in range(0, len(every), BATCH_ROWS):
                    at, value = every[begin : begin + BATCH_ROWS], values[begin : begin + BATCH_ROWS]
                    position = at + row["start_position"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(row["capture_id"], len(at)),
                            pa.array(position),
                            pa.array(value.view(np.int64)),
                            pa.array(position * row["timestamp_step"]),
                        ],
                        names=_WORDS.names,
                    )

    words = aligned.select("capture_id", "channels", "start_position", "num_samples", "timestamp_step").mapInArrow(
        decode, _WORDS
    )
    return words.withColumn("timestamp_us", ns_to_us(F.col("t_ns")))


def enable_asof(rows: DataFrame, control: DataFrame, time: str = "t_ns", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add ``enabled``: control state at or before each row, false before the first; at equal times enabled holds."""
    require_columns(control, CONTROL, "control")
    out = asof_state(
        rows, control, ["capture_id"], probe_time=time, state_time="t_ns", values={"enabled": "state"},
        ties=F.col("state"), width=width,
    )
    return out.withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def enable_gate(rows: DataFrame, control: DataFrame, time: str = "t_ns", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Keep rows while the control state is enabled; an edge at the same ns applies."""
    return enable_asof(rows, control, time, width).filter("enabled").drop("enabled")
