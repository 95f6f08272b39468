"""Table contracts, option enums and the input check every operator uses."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SpiMode(Enum):
    """Clock polarity/phase pairs; modes 0 and 3 sample on the rising edge."""

    MODE0 = 0
    MODE1 = 1
    MODE2 = 2
    MODE3 = 3

    @property
    def samples_on_rising(self) -> bool:
        return self in (SpiMode.MODE0, SpiMode.MODE3)


class CsPolarity(Enum):
    ACTIVE_LOW = "active_low"
    ACTIVE_HIGH = "active_high"
    DISABLED = "disabled"


class StrobeMode(Enum):
    RISING = "rising"
    FALLING = "falling"
    ANY = "any"
    HIGH = "high"
    LOW = "low"

    @property
    def is_level(self) -> bool:
        return self in (StrobeMode.HIGH, StrobeMode.LOW)


class DisplayMode(Enum):
    GRAYSCALE = "grayscale"
    COLOR = "color"


_TYPES = {
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "strings": T.ArrayType(T.StringType()),
}


def fields(**columns: str | T.DataType) -> T.StructType:
    """StructType from ``name="bigint"`` pairs (DDL strings would need a running session)."""
    return T.StructType([T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in columns.items()])


HEADER = fields(
    capture_id="string", total_probes="int", samplerate="string", samplerate_hz="double",
    sample_period="double", total_samples="bigint", total_blocks="bigint",
    samples_per_block="bigint", probe_names="strings",
)
BLOCKS = fields(
    capture_id="string", channel="int", block_num="bigint", data="binary",
    start_position="bigint", num_samples="bigint", timestamp_step="bigint",
)
# Blocks as archives and stored tables hold them: with the bits at both ends.
STORED_BLOCKS = T.StructType([*BLOCKS.fields, *fields(first="int", last="int").fields])
LEVELS = fields(capture_id="string", channel="int", position="bigint", value="boolean")
RUNS = fields(capture_id="string", channel="int", value="boolean", start_time="bigint")
LINE_RUNS = fields(capture_id="string", value="boolean", start_time="bigint")
SPI_WORDS = fields(
    capture_id="string", window_id="bigint", word_no="bigint", mosi="bigint", miso="bigint",
    t_ns="bigint", timestamp_us="double",
)
WORDS = fields(capture_id="string", value="bigint", t_ns="bigint", timestamp_us="double")
CONTROL = fields(capture_id="string", state="boolean", t_ns="bigint")
COMMANDS = fields(log_id="string", seq="bigint", time_ns="double", mosi="bigint")
PIXELS = fields(image_id="string", row="bigint", col="bigint", g="int", b="int", r="int")

# Column names of the line-clock table, in file order.
LINE_RECORD_COLUMNS = [
    "rising_byte_index",
    "rising_timestamp",
    "falling_byte_index",
    "falling_timestamp",
    "first_clock_rising_byte_index",
    "first_clock_rising_timestamp",
    "first_clock_falling_byte_index",
    "first_clock_falling_timestamp",
]


class ContractError(ValueError):
    """An operator was given a table that lacks a required column or type."""


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def require_columns(df: DataFrame, schema: T.StructType, what: str = "input") -> DataFrame:
    """Check names and types while the plan is built; numeric widths may differ."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        found = have.get(field.name)
        if found is None:
            problems.append(f"missing column {field.name}")
        elif isinstance(found, _NUMERIC) and isinstance(field.dataType, _NUMERIC):
            continue
        elif found.simpleString() != field.dataType.simpleString():
            problems.append(
                f"column {field.name} is {found.simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise ContractError(f"{what}: " + "; ".join(problems))
    return df
