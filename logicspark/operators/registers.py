"""Register state, capture durations and readable descriptions of a command log.

The log is ordered by ``seq``. Registers are 7-bit, so at most 128 per log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logicspark.functions import scalar
from logicspark.functions.names import control_names, sequencer_names, special_names, timing_names
from logicspark.operators.control import DISABLE_COMMAND, ENABLE_COMMAND, command_match
from logicspark.operators.ordered import DEFAULT_WIDTH, asof_state, neighbours, order_key, running_sum
from logicspark.schemas import COMMANDS, require_columns

LOG = ["log_id"]
REGISTERS = 128


def decode_command(commands: DataFrame) -> DataFrame:
    """Add is_read, register and value fields of the 24-bit command."""
    mosi = F.col("mosi")
    return commands.withColumns(
        {
            "is_read": scalar.is_read(mosi),
            "register": scalar.register_of(mosi),
            "value": scalar.value_of(mosi),
        }
    )


def register_writes(
    commands: DataFrame, enable: int = ENABLE_COMMAND, disable: int = DISABLE_COMMAND
) -> DataFrame:
    """Writes only: bit 23 clear, and neither of the two control commands."""
    require_columns(commands, COMMANDS, "commands")
    return decode_command(
        commands.filter(~F.col("mosi").isin(enable, disable) & ~scalar.is_read(F.col("mosi")))
    ).drop("is_read")


def enables(
    commands: DataFrame, enable: int = ENABLE_COMMAND, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Enable commands numbered 1, 2, 3... per log."""
    require_columns(commands, COMMANDS, "commands")
    d = commands.filter(F.col("mosi") == enable).select(*LOG, "seq", "time_ns", order_key("seq").alias("__order"))
    d = running_sum(d, LOG, "__order", {"__n": F.lit(1)}, width=width)
    return d.select(*LOG, "seq", "time_ns", F.col("__n").cast("bigint").alias("enable_num"))


def register_state(writes: DataFrame) -> DataFrame:
    """Last value written to each register."""
    return writes.groupBy(*LOG, "register").agg(F.max_by("value", "seq").alias("value"))


#: Enables that one row hands on at a time.
SPAN = 1 << 12


def register_snapshots(
    writes: DataFrame, enabled: DataFrame, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Registers known just before each enable, long form.

    A write holds for the enables after it up to the next write of its register, which is a range of enable numbers:
    from the enables counted at the write to those counted at the next one. Only these rows are made, and a write that no
    enable sees makes none. Ranges are handed on in spans, so no row carries a long list.
    """
    counted = asof_state(
        writes.select(*LOG, "seq", "register", "value"), enabled, LOG, probe_time="seq", state_time="seq",
        values={"__before": "enable_num"}, include_equal=False, width=width,
    ).withColumn("__before", F.coalesce("__before", F.lit(0)))
    held = neighbours(
        counted.withColumn("__order", order_key("seq")), [*LOG, "register"], "__order",
        ahead={"__until": F.col("__before")}, inclusive=False, width=width,
    )
    last = enabled.groupBy(*LOG).agg(F.max("enable_num").alias("__last"))
    ranges = held.join(last, LOG).withColumn("__until", F.coalesce("__until", "__last")).filter("__until > __before")
    first = F.explode(F.sequence(F.col("__before") + 1, F.col("__until"), F.lit(SPAN)))
    spans = ranges.withColumn("__first", first)
    number = F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + (SPAN - 1), F.col("__until"))))
    seen = spans.select(*LOG, "register", "value", number.alias("enable_num"))
    return seen.join(enabled.select(*LOG, "enable_num", "time_ns"), [*LOG, "enable_num"]).select(
        *LOG, "enable_num", "time_ns", "register", "value"
    )


def snapshot_before(writes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Registers known just before one enable of each log (log_id, enable_num, time_ns, seq), without the other enables:
    the last write of each register before it. A choice that fails does so also when there are no writes."""
    limit = chosen.select(*LOG, "enable_num", "time_ns", F.col("seq").alias("__until"))
    found = (
        writes.drop("time_ns").join(limit, LOG)
        .filter(F.col("seq") < F.col("__until"))
        .groupBy(*LOG, "enable_num", "time_ns", "register")
        .agg(F.max_by("value", "seq").alias("value"))
    )
    # Never a row, but the choice is looked at whatever the join does.
    looked_at = chosen.agg(F.count(F.lit(1)).alias("n")).filter("n < 0")
    return found.union(looked_at.select(*_not_null(found)))


def _not_null(df: DataFrame) -> list[Column]:
    """A row of empty values; with nulls, joins would leave a branch out unseen."""
    return [(F.lit("") if kind == "string" else F.lit(0).cast(kind)).alias(name) for name, kind in df.dtypes]


def snapshot_maps(snapshots: DataFrame) -> DataFrame:
    """One ``MAP<INT, INT>`` per snapshot, keys in register order (at most 128)."""
    entries = F.array_sort(F.collect_list(F.struct("register", "value")))
    return snapshots.groupBy(*LOG, "enable_num", "time_ns").agg(F.map_from_entries(entries).alias("registers"))


def snapshot_sizes(writes: DataFrame, enabled: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Number of registers known at each enable: first writes that precede it."""
    first = writes.groupBy(*LOG, "register").agg(F.min("seq").alias("seq"))
    none = F.lit(None).cast("bigint")
    both = first.select(
        *LOG, "seq", none.alias("enable_num"), F.lit(None).cast("double").alias("time_ns"), F.lit(1).alias("__new")
    ).unionByName(
        enabled.select(*LOG, "seq", "enable_num", F.col("time_ns").cast("double").alias("time_ns"), F.lit(0).alias("__new"))
    )
    d = running_sum(
        both.withColumn("__order", order_key("seq")), LOG, "__order", {"registers": F.col("__new")}, width=width
    )
    return d.filter(F.col("enable_num").isNotNull()).select(*LOG, "enable_num", "time_ns", "registers")


def capture_durations(
    commands: DataFrame,
    enable: int = ENABLE_COMMAND,
    disable: int = DISABLE_COMMAND,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """A disable right after an enable closes it; the number is that enable's."""
    require_columns(commands, COMMANDS, "commands")
    d = commands.select(
        *LOG, "seq", "time_ns", command_match(F.col("mosi"), enable, disable).alias("__on"), order_key("seq").alias("__order")
    ).filter(F.col("__on").isNotNull())
    d = running_sum(d, LOG, "__order", {"enable_num": F.col("__on").cast("bigint")}, width=width)
    d = neighbours(
        d, LOG, "__order", back={"__was_on": F.col("__on"), "__since": F.col("time_ns")}, inclusive=False, width=width
    )
    return d.filter(~F.col("__on") & F.col("__was_on")).select(
        *LOG, F.col("enable_num").cast("bigint").alias("enable_num"),
        (F.col("time_ns") - F.col("__since")).alias("duration_ns"),
    )


def longest_capture(durations: DataFrame) -> DataFrame:
    """Longest capture of each log; the last one among equals."""
    best = F.max(F.struct("duration_ns", "enable_num"))
    return durations.groupBy(*LOG).agg(best.alias("b")).select(*LOG, "b.enable_num", "b.duration_ns")


def snapshot_pick(
    snapshots: DataFrame, durations: DataFrame | None = None, capture_num: int | None = None,
    enabled: DataFrame | None = None,
) -> DataFrame:
    """Rows of the chosen capture, or of the longest one; the query fails when there is none.

    ``snapshots`` is anything with log_id and enable_num. Given the enables themselves it picks one of each log, before
    any snapshot is made (``snapshot_before``). ``enabled`` lets a capture without any known register count as found.
    """
    if (durations is None) == (capture_num is None):
        raise ValueError("give either durations or capture_num")
    if capture_num is not None:
        source = snapshots if enabled is None else enabled
        chosen = source.filter(F.col("enable_num") == capture_num).select(*LOG, "enable_num").distinct()
        missing = f"Capture #{capture_num} not found"
    else:
        chosen = longest_capture(durations).select(*LOG, "enable_num")
        missing = "No enable/disable pairs found"
    # No row, or an error when nothing was chosen.
    none = F.when(F.count(F.lit(1)) == 0, F.raise_error(missing).cast("boolean")).otherwise(F.lit(False))
    guard = chosen.agg(none.alias("__none")).filter("__none").select(*_not_null(snapshots))
    return snapshots.join(chosen, [*LOG, "enable_num"]).select(*snapshots.columns).union(guard)


def ordered_registers(snapshot: DataFrame) -> DataFrame:
    return snapshot.orderBy(*LOG, "enable_num", "register")


def register_names(commands: DataFrame, register: str = "register") -> DataFrame:
    """Add ``register_name`` from the timing table, then the control table, else REG_xx."""
    spark = commands.sparkSession
    return (
        commands.join(F.broadcast(timing_names(spark)), F.col(register) == F.col("timing_register"), "left")
        .join(F.broadcast(control_names(spark)), F.col(register) == F.col("control_register"), "left")
        .withColumn(
            "register_name",
            F.coalesce("timing_name", "control_name", F.format_string("REG_%02X", F.col(register))),
        )
        .drop("timing_register", "control_register", "timing_name", "control_name")
    )


def special_commands(commands: DataFrame) -> DataFrame:
    """Add ``special``: text of a fully known command, else NULL."""
    return commands.join(
        F.broadcast(special_names(commands.sparkSession)), F.col("mosi") == F.col("special_mosi"), "left"
    ).drop("special_mosi")


def decode_gain(register: Column, value: Column, read: Column) -> Column:
    """Text for the three colour gain registers, NULL for others."""
    colour = F.when(register == 0x78, "RED").when(register == 0x79, "GREEN").when(register == 0x7A, "BLUE")
    return F.when(
        colour.isNotNull(),
        F.format_string(
            "%s %s gain=0x%02X offset=0x%02X",
            F.when(read, "read").otherwise("write"), colour, scalar.high_byte(value), scalar.low_byte(value),
        ),
    )


def describe_commands(commands: DataFrame, name: str = "description") -> DataFrame:
    """Add a readable description of ``mosi``; NULL where ``mosi`` is NULL.

    Order: known command, colour gain, sequencer, timing config, verify, clear, generic.
    """
    fields_ = ["is_read", "register", "value"]
    d = special_commands(register_names(decode_command(commands)))
    d = d.join(
        F.broadcast(sequencer_names(commands.sparkSession)), F.col("value") == F.col("sequencer_value"), "left"
    )
    reg, value, read = F.col("register"), F.col("value"), F.col("is_read")
    rw, label = F.when(read, "READ").otherwise("WRITE"), F.col("register_name")
    timing = reg <= 0x3F
    text = (
        F.when(F.col("mosi").isNull(), None)
        .when(F.col("special").isNotNull(), F.col("special"))
        .when(reg.between(0x78, 0x7A), decode_gain(reg, value, read))
        .when(
            reg == 0x62,
            F.concat(rw, F.lit(" RGB_SEQUENCER "), F.coalesce("sequencer", F.format_string("cmd=0x%04X", value))),
        )
        .when(
            timing & ~read & (value.bitwiseAND(F.lit(0xC000)) != 0) & (value != 0xFFFF),
            F.format_string("%s %s config=0x%04X", rw, label, value),
        )
        .when(timing & (value == 0xFFFF), F.concat(rw, F.lit(" "), label, F.lit(" verify=0xFFFF")))
        .when(timing & (value == 0) & ~read, F.concat(rw, F.lit(" "), label, F.lit(" = 0x0000 (clear)")))
        .otherwise(F.format_string("%s %s = 0x%04X", rw, label, value))
    )
    return d.withColumn(name, text).drop(*fields_, "register_name", "special", "sequencer", "sequencer_value")


def describe_text(rows: DataFrame, text: str, name: str = "description") -> DataFrame:
    """Describe a hex text column: ``???`` when unparsable, empty when the field is missing."""
    raw = F.trim(F.col(text))
    d = rows.withColumn("mosi", F.when(scalar.is_hex(raw), scalar.parse_hex(raw)))
    d = describe_commands(d, name)
    return d.withColumn(
        name, F.when(F.col(text).isNull(), F.lit("")).otherwise(F.coalesce(name, F.lit("???")))
    ).drop("mosi")
