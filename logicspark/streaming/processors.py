"""Streams with a small keyed state: block stitching and the control state.

Heavy work (bit unpacking, command filtering) happens before the keyed step, so one
capture sends one row per block or per control command through its state, not its data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logicspark.operators.control import DISABLE_COMMAND, ENABLE_COMMAND, command_match
from logicspark.operators.signal import LINE, _interior_edges, first_bit, last_bit
from logicspark.schemas import BLOCKS, RUNS, fields

# Fixed value: Spark class name of the state store that keeps per-key state variables.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state variables need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_blocks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Blocks written as Parquet files, replayed or followed as a stream."""
    reader = spark.readStream.schema(BLOCKS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class _Stitch(StatefulProcessor):
    """Whether a block opens a run, once the block before it is known, in any order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # last bit of blocks whose successor is unknown, first bit of blocks that wait
        self._last = handle.getMapState("last", "block_num BIGINT", "bit INT")
        self._waiting = handle.getMapState("waiting", "block_num BIGINT", "first INT, start_time BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []

        def decide(first: int, start: int, before: int | None) -> None:
            if before is None or before != first:
                out.append((key[0], key[1], bool(first), start))

        for batch in rows:
            for n, first, last, start in zip(
                batch["block_num"].tolist(), batch["first"].tolist(), batch["last"].tolist(), batch["start_time"].tolist(),
                strict=True,
            ):
                if n == 0:
                    decide(first, start, None)
                elif self._last.containsKey((n - 1,)):
                    decide(first, start, self._last.getValue((n - 1,))[0])
                    self._last.removeKey((n - 1,))
                else:
                    self._waiting.updateValue((n,), (first, start))
                if self._waiting.containsKey((n + 1,)):
                    waiting = self._waiting.getValue((n + 1,))
                    decide(waiting[0], waiting[1], last)
                    self._waiting.removeKey((n + 1,))
                else:
                    self._last.updateValue((n,), (last,))
        yield pd.DataFrame(out, columns=RUNS.names)

    def close(self) -> None:
        pass


def stream_edges(blocks: DataFrame) -> DataFrame:
    """Runs of a block stream; each is emitted at its start, so nothing waits for the end."""
    blocks = blocks.filter("num_samples > 0")
    interior = blocks.select(
        *LINE, "data", "start_position", "num_samples", "timestamp_step"
    ).mapInArrow(_interior_edges, RUNS)
    borders = blocks.select(
        *LINE, "block_num", first_bit(blocks).alias("first"), last_bit(blocks).alias("last"),
        (F.col("start_position") * F.col("timestamp_step")).alias("start_time"),
    )
    opening = borders.groupBy(*LINE).transformWithStateInPandas(
        statefulProcessor=_Stitch(), outputStructType=RUNS, outputMode="Append", timeMode="None"
    )
    return interior.unionByName(opening)


CONTROL_EVENTS = fields(capture_id="string", state="boolean", t_ns="bigint", late="boolean")


class _Control(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "on BOOLEAN, seen BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("t_ns", kind="stable")
        out = []
        if self._state.exists():
            on, seen = self._state.get()
        else:
            on, seen = False, -1
            out.append((key[0], False, 0, False))
        for state, t in zip(batch["state"].tolist(), batch["t_ns"].tolist(), strict=True):
            if t < seen:
                out.append((key[0], state, t, True))
                continue
            seen = t
            if state is not None and state != on:
                on = state
                out.append((key[0], on, t, False))
        self._state.update((on, seen))
        yield pd.DataFrame(out, columns=CONTROL_EVENTS.names)

    def close(self) -> None:
        pass


def stream_control(words: DataFrame, enable: int = ENABLE_COMMAND, disable: int = DISABLE_COMMAND) -> DataFrame:
    """State changes of a word stream; a command behind what was seen comes out as ``late``.

    Other commands are dropped before the keyed step. The initial (false, 0) comes out
    with the first control command of a capture.
    """
    kept = words.select("capture_id", command_match(F.col("mosi"), enable, disable).alias("state"), "t_ns").filter(
        F.col("state").isNotNull()
    )
    return kept.groupBy("capture_id").transformWithStateInPandas(
        statefulProcessor=_Control(), outputStructType=CONTROL_EVENTS, outputMode="Append", timeMode="None"
    )


def stream_limit(words: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of a stream; 0 = no limit."""
    return words.limit(n) if n > 0 else words
