"""Enable/disable state driven by decoded serial commands, and the two monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logicspark.operators.ordered import DEFAULT_WIDTH, neighbours, order_key
from logicspark.schemas import fields, require_columns

# The commands that start and stop the pixel stream.
ENABLE_COMMAND = 0x600081
DISABLE_COMMAND = 0x600000


def command_match(mosi: Column, enable: int = ENABLE_COMMAND, disable: int = DISABLE_COMMAND) -> Column:
    """True for enable, false for disable, NULL for any other command."""
    return F.when(mosi == enable, True).when(mosi == disable, False)


def initial_state(commands: DataFrame) -> DataFrame:
    """(false, 0) for every capture."""
    return commands.select("capture_id").distinct().select(
        "capture_id", F.lit(False).alias("state"), F.lit(0).cast("bigint").alias("t_ns")
    )


def state_changes(
    commands: DataFrame, enable: int = ENABLE_COMMAND, disable: int = DISABLE_COMMAND, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """(capture_id, state, t_ns) of each command that changes the state; it starts false."""
    require_columns(commands, fields(capture_id="string", t_ns="bigint", mosi="bigint"), "commands")
    d = commands.select("capture_id", command_match(F.col("mosi"), enable, disable).alias("state"), "t_ns")
    d = d.filter(F.col("state").isNotNull()).withColumn("__order", order_key("t_ns"))
    d = neighbours(d, ["capture_id"], "__order", back={"__before": F.col("state")}, inclusive=False, width=width)
    return d.filter(F.col("state") != F.coalesce("__before", F.lit(False))).select("capture_id", "state", "t_ns")


def control_state(
    commands: DataFrame, enable: int = ENABLE_COMMAND, disable: int = DISABLE_COMMAND, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Initial (false, 0) row and every change after it."""
    return initial_state(commands).unionByName(state_changes(commands, enable, disable, width))


def state_monitor(control: DataFrame) -> DataFrame:
    """ENABLED / DISABLED per state row; works on batch and streaming tables."""
    return control.withColumn("report", F.when(F.col("state"), "ENABLED").otherwise("DISABLED"))


def command_monitor(
    commands: DataFrame, enable: int = ENABLE_COMMAND, disable: int = DISABLE_COMMAND
) -> DataFrame:
    """Only the two watched commands; works on batch and streaming tables."""
    return commands.filter(F.col("mosi").isin(enable, disable)).withColumn(
        "report",
        F.format_string("SPI Command: 0x%06X at t=%.6fs", F.col("mosi"), F.col("t_ns") / F.lit(1e9)),
    )
