"""Streams whose batches are decoded by the batch operators, spread over all tasks.

Each micro-batch runs the set-based operator on the data that is complete on every
line, starting from a few rows per capture that earlier batches left behind. State and
results are tables under one shared folder, one sub-folder per batch id, so a batch that
is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logicspark.operators import sessions, signal, spi
from logicspark.operators.ordered import DEFAULT_WIDTH
from logicspark.operators.parallel import parallel_words
from logicspark.schemas import (
    BLOCKS,
    CONTROL,
    LINE_RECORD_COLUMNS,
    LINE_RUNS,
    WORDS,
    CsPolarity,
    SpiMode,
    StrobeMode,
    fields,
)

BY = ["capture_id"]
BLOCK_KEY = ["capture_id", "channel", "block_num"]
TAILS = fields(capture_id="string", channel="int", block_num="bigint", last="int")


@dataclass
class BatchTables:
    """Versioned tables of one stream: ``<folder>/<name>/batch=<id>``."""

    spark: SparkSession
    folder: str

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def read(self, name: str, batch: int, schema: T.StructType) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, batch))

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, batch))
        return self.spark.read.schema(df.schema).parquet(self._path(name, batch))

    def result(self, name: str, schema: T.StructType) -> DataFrame:
        """All batches written so far."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*schema.names)


@dataclass
class _BlockStep:
    """Splits a batch into blocks complete on every line and blocks held for later.

    What is decided by capture is decided on keys alone; packed bytes meet it by capture, channel and block number."""

    tables: BatchTables
    channels: Sequence[int]
    ready: DataFrame = field(init=False)
    tails: DataFrame = field(init=False)

    def run(self, batch: DataFrame, batch_id: int, reach: DataFrame | None = None) -> None:
        """With ``reach`` (capture_id, t_ns) blocks that go on beyond that time are held too."""
        wanted = sorted(set(self.channels))
        held = self.tables.read("held", batch_id - 1, BLOCKS)
        self.tails = self.tables.read("tails", batch_id - 1, TAILS)
        seen = self.tails.groupBy(*BY).agg((F.max("block_num") + 1).alias("__next"))
        blocks = (
            batch.filter(F.col("channel").isin(wanted))
            .select(*BLOCKS.names)
            .unionByName(held)
            .dropDuplicates(BLOCK_KEY)
        )
        blocks = self.tables.write(blocks, "pool", batch_id)
        first = F.coalesce("__next", F.lit(0))
        end = (F.col("start_position") + F.greatest("num_samples", F.lit(1)) - 1) * F.col("timestamp_step")
        keys = blocks.select(*BLOCK_KEY, end.alias("__end")).join(seen, BY, "left").filter(F.col("block_num") >= first)
        # blocks waiting on one line, a few per batch, without their bytes
        place = F.row_number().over(W.partitionBy(*BY, "channel").orderBy("block_num"))
        runs = (
            keys.withColumn("__place", place)
            .filter(F.col("block_num") == first + F.col("__place") - 1)
            .groupBy(*BY, "channel")
            .agg(F.max("block_num").alias("__upto"))
            .groupBy(*BY)
            .agg(F.count(F.lit(1)).alias("__lines"), F.min("__upto").alias("__upto"))
            .filter(F.col("__lines") == len(wanted))
            .select(*BY, "__upto")
        )
        done = F.col("block_num") <= F.col("__upto")
        known = keys.join(runs, BY, "left")
        if reach is not None:
            known = known.join(reach.select(*BY, F.col("t_ns").alias("__reach")), BY, "left")
            done = done & (F.col("__end") <= F.col("__reach"))
        decided = self.tables.write(
            known.select(*BLOCK_KEY, F.coalesce(done, F.lit(False)).alias("done")), "decided", batch_id
        )
        pool = blocks.join(decided, BLOCK_KEY)
        self.tables.write(pool.filter("not done").select(*BLOCKS.names), "held", batch_id)
        self.ready = pool.filter("done").select(*BLOCKS.names)
        ends = signal.last_bits(self.ready).select(*TAILS.names)
        latest = F.max_by(F.struct("block_num", "last"), "block_num")
        self.tables.write(
            self.tails.unionByName(ends)
            .groupBy(*BY, "channel")
            .agg(latest.alias("x"))
            .select(*BY, "channel", "x.block_num", "x.last"),
            "tails",
            batch_id,
        )


def _start(stream: DataFrame, step, folder: str, trigger: Mapping[str, object] | None) -> StreamingQuery:
    """``trigger`` is that of ``DataStreamWriter.trigger``, such as ``{"processingTime": "5 seconds"}`` for a live feed;
    without one the query works off what is there and ends."""
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_spi(
    blocks: DataFrame,
    folder: str,
    *,
    cs: int,
    clk: int,
    mosi: int | None = None,
    miso: int | None = None,
    bits_per_word: int = 8,
    mode: SpiMode = SpiMode.MODE0,
    polarity: CsPolarity = CsPolarity.ACTIVE_LOW,
    width: int = DEFAULT_WIDTH,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Serial words of a block stream, written to ``<folder>/words`` when a window closes.

    Kept between batches: blocks some line has not reached yet, one state row per
    capture, and the folded words of windows that are still open.
    """
    lines = {"cs": cs, "clk": clk, "mosi": mosi, "miso": miso}
    channels = [c for c in lines.values() if c is not None]
    tables = BatchTables(blocks.sparkSession, folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        feed = _BlockStep(tables, channels)
        feed.run(batch, batch_id)
        packed = tables.write(
            spi.packed_lines(feed.ready, lines, feed.tails, polarity=polarity, width=width), "packed", batch_id
        )
        parts, prefix = spi.spi_parts(
            packed, tables.read("prefix", batch_id - 1, spi.PREFIX), bits_per_word=bits_per_word, mode=mode
        )
        prefix = tables.write(prefix, "prefix", batch_id)
        both = tables.read("open", batch_id - 1, spi.PARTS).unionByName(parts)
        edge = prefix.select(*BY, F.col("cs.t").alias("__cs"))
        folded = tables.write(spi.fold_parts(both).join(edge, BY, "left"), "folded", batch_id)
        closed = F.coalesce(F.col("window_id") < F.col("__cs"), F.lit(False))
        tables.write(folded.filter(~closed).select(*spi.PARTS.names), "open", batch_id)
        tables.write(spi.finish_words(folded.filter(closed), bits_per_word), "words", batch_id)

    return _start(blocks, step, folder, trigger)


BUS_EVENTS = T.StructType([*BLOCKS.fields, *fields(state="boolean", t_ns="bigint").fields])
_TIME = fields(capture_id="string", t_ns="bigint")


def bus_events(blocks: DataFrame, control: DataFrame) -> DataFrame:
    """Blocks and control rows as one stream; control rows have no channel."""
    return blocks.select(*BLOCKS.names).unionByName(control.select(*CONTROL.names), allowMissingColumns=True)


@dataclass
class _BusStep:
    """Bus words of one micro-batch; with a live control stream, of the blocks that its rows have passed."""

    tables: BatchTables
    channels: Sequence[int]
    options: Mapping[str, object]
    control: DataFrame | None
    live: bool

    def run(self, batch: DataFrame, batch_id: int, to_the_end: bool = False) -> None:
        feed = _BlockStep(self.tables, self.channels)
        if not self.live:
            feed.run(batch, batch_id)
            self.words(feed, self.control, batch_id)
            return
        read = self.tables.read
        batch = self.tables.write(batch.select(*BUS_EVENTS.names), "arrived", batch_id)
        passed = read("passed", batch_id - 1, _TIME)
        known = batch.filter("channel is null").join(passed.withColumnRenamed("t_ns", "__passed"), BY, "left")
        late = F.coalesce(F.col("t_ns") <= F.col("__passed"), F.lit(False))
        self.tables.write(known.filter(late & F.col("state").isNotNull()).select(*CONTROL.names), "late", batch_id)
        fresh = known.filter(~late).select(*CONTROL.names)
        reach = self.tables.write(
            read("reach", batch_id - 1, _TIME).unionByName(fresh.select(*_TIME.names)).groupBy(*BY).agg(F.max("t_ns").alias("t_ns")),
            "reach", batch_id,
        )
        control = self.tables.write(
            read("control", batch_id - 1, CONTROL).unionByName(fresh.filter("state is not null")), "control_pool", batch_id
        )
        feed.run(batch.filter("channel is not null"), batch_id, None if to_the_end else reach)
        self.words(feed, control, batch_id)
        end = (F.col("start_position") + F.col("num_samples") - 1) * F.col("timestamp_step")
        passed = self.tables.write(
            passed.unionByName(feed.ready.select(*BY, end.alias("t_ns"))).groupBy(*BY).agg(F.max("t_ns").alias("t_ns")),
            "passed", batch_id,
        )
        # What later blocks can need: the control rows to come, and the last one before them.
        at = control.join(passed.withColumnRenamed("t_ns", "__passed"), BY, "left")
        over = F.coalesce(F.col("t_ns") <= F.col("__passed"), F.lit(False))
        last = at.filter(over).groupBy(*BY).agg(F.max(F.struct("t_ns", "state")).alias("x")).select(*BY, "x.state", "x.t_ns")
        self.tables.write(at.filter(~over).select(*CONTROL.names).unionByName(last), "control", batch_id)

    def words(self, feed: _BlockStep, control: DataFrame | None, batch_id: int) -> None:
        self.tables.write(parallel_words(feed.ready, control=control, tails=feed.tails, **self.options), "words", batch_id)


def _bus_step(spark: SparkSession, folder: str, control: DataFrame | None, live: bool, options: Mapping) -> _BusStep:
    gated = options["polarity"] is not CsPolarity.DISABLED and options["cs"] is not None
    channels = [options["strobe"], *options["data"], *([options["cs"]] if gated else [])]
    return _BusStep(BatchTables(spark, folder), channels, options, control, live)


def stream_parallel(
    blocks: DataFrame,
    folder: str,
    *,
    strobe: int,
    data: Sequence[int],
    cs: int | None = None,
    mode: StrobeMode = StrobeMode.RISING,
    polarity: CsPolarity = CsPolarity.DISABLED,
    control: DataFrame | None = None,
    width: int = DEFAULT_WIDTH,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Bus words of a block stream, written to ``<folder>/words``.

    Blocks wait until every channel has the block number. ``control`` is a table whose rows are complete for the blocks
    that arrive, or a stream of its own: then blocks also wait until a control row at or after their last sample has come
    (one with a null state only says how far the control is), and ``flush_parallel`` works off the last ones. Control rows
    that come for blocks worked off already go to ``<folder>/late``.
    """
    options = dict(strobe=strobe, data=data, cs=cs, mode=mode, polarity=polarity, width=width)
    live = control is not None and control.isStreaming
    step = _bus_step(blocks.sparkSession, folder, control, live, options)
    return _start(bus_events(blocks, control) if live else blocks, step.run, folder, trigger)


def flush_parallel(
    spark: SparkSession,
    folder: str,
    *,
    strobe: int,
    data: Sequence[int],
    cs: int | None = None,
    mode: StrobeMode = StrobeMode.RISING,
    polarity: CsPolarity = CsPolarity.DISABLED,
    width: int = DEFAULT_WIDTH,
) -> None:
    """Work off the blocks that a stopped ``stream_parallel`` with a live control holds, as if no control row came any
    more. The result stands under the number of the next batch, so a stream that goes on overwrites it."""
    options = dict(strobe=strobe, data=data, cs=cs, mode=mode, polarity=polarity, width=width)
    step = _bus_step(spark, folder, None, True, options)
    step.run(spark.createDataFrame([], BUS_EVENTS), _last_batch(spark, f"{folder}/reach") + 1, to_the_end=True)


def _last_batch(spark: SparkSession, folder: str) -> int:
    # By file names, as tables without rows have no partition value.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.select(F.max(F.regexp_extract("path", r"/batch=([0-9]+)/", 1).cast("int"))).first()[0]


SESSION_EVENTS = fields(
    capture_id="string", kind="string", t_ns="bigint", value="bigint", state="boolean"
)
_SESSION_STATE = fields(
    capture_id="string", state="boolean", t_ns="bigint", last_file="bigint", file_at="bigint", words="bigint",
    word_at="bigint",
)


def session_events(words: DataFrame, control: DataFrame, line_clock: DataFrame | None = None) -> DataFrame:
    """Words, control rows and runs of the line clock as one stream (``kind`` word, control or line)."""
    none = F.lit(None).cast("bigint").alias("value")
    out = words.select(
        *BY, F.lit("word").alias("kind"), "t_ns", "value", F.lit(None).cast("boolean").alias("state")
    ).unionByName(control.select(*BY, F.lit("control").alias("kind"), "t_ns", none, "state"))
    if line_clock is None:
        return out
    runs = line_clock.select(
        *BY, F.lit("line").alias("kind"), F.col("start_time").alias("t_ns"), none, F.col("value").alias("state")
    )
    return out.unionByName(runs)


SESSION_WORDS = fields(
    capture_id="string", value="bigint", t_ns="bigint", file_num="bigint", byte_index="bigint"
)


_REACH = fields(capture_id="string", kind="string", t_ns="bigint")


def stream_sessions(
    events: DataFrame,
    folder: str,
    width: int = DEFAULT_WIDTH,
    trigger: Mapping[str, object] | None = None,
    *,
    line_clock: bool = False,
    delay: int = 0,
) -> StreamingQuery:
    """Sessions of a stream of words and control rows, to ``<folder>/session_words``.

    A batch is worked off up to the time all kinds have reached, less ``delay`` nanoseconds, by which rows of a kind may
    come out of order; later rows are held until then, or until ``flush_sessions``. Rows that come behind a time worked
    off already go to ``<folder>/late``. Kept per capture: control state, last session number, its enable time, its word
    count and last word.

    With ``line_clock`` runs of the line clock come along and line records go to ``<folder>/records``. Kept per capture
    then: the level of the line, edges of the open session that no word has followed yet, and the record that its last
    rising edge has opened. The next edge fills or closes it, the end of the session closes it.
    """
    tables = BatchTables(events.sparkSession, folder)
    step = _SessionStep(tables, width, line_clock, delay)
    return _start(events, step.run, folder, trigger)


def flush_sessions(
    spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH, *, line_clock: bool = False
) -> None:
    """Work off the rows that a stopped ``stream_sessions`` still holds, as if all kinds went on for ever.

    The result stands under the number of the next batch, so a stream that is started again overwrites it with what it
    then knows."""
    step = _SessionStep(BatchTables(spark, folder), width, line_clock, 0)
    step.run(spark.createDataFrame([], SESSION_EVENTS), _last_batch(spark, f"{folder}/state") + 1, to_the_end=True)


def session_index(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Index row of every session that ``stream_sessions`` has written so far."""
    tables = BatchTables(spark, folder)
    records = tables.result("records", RECORDS)
    return sessions.capture_index(tables.result("session_words", SESSION_WORDS), records, width)


RECORDS = T.StructType(
    [*fields(capture_id="string", file_num="bigint").fields, *fields(**{c: "bigint" for c in LINE_RECORD_COLUMNS}).fields]
)
_EDGES = fields(capture_id="string", edge_t="bigint", rising="boolean")
_SESSION_EDGES = fields(
    capture_id="string", file_num="bigint", edge_t="bigint", rising="boolean", byte_index="bigint", clock_t="bigint"
)


@dataclass
class _SessionStep:
    tables: BatchTables
    width: int
    line_clock: bool
    delay: int

    def run(self, batch: DataFrame, batch_id: int, to_the_end: bool = False) -> None:
        ready, before, after, words = _session_step(
            self.tables, batch, batch_id, self.width, 3 if self.line_clock else 2, self.delay, to_the_end
        )
        if self.line_clock:
            self.lines(ready.filter("kind = 'line'"), before, after, words, batch_id, to_the_end)

    def lines(
        self, ready: DataFrame, before: DataFrame, after: DataFrame, words: DataFrame, batch_id: int, to_the_end: bool
    ) -> None:
        tables, width = self.tables, self.width
        runs = ready.select(*BY, F.col("state").alias("value"), F.col("t_ns").alias("start_time"))
        levels = runs.withColumn("new", F.lit(True)).unionByName(
            tables.read("level", batch_id - 1, LINE_RUNS).withColumn("new", F.lit(False))
        )
        levels = tables.write(levels, "levels", batch_id)
        last = F.max_by(F.struct("value", "start_time"), "start_time").alias("x")
        tables.write(levels.groupBy(*BY).agg(last).select(*BY, "x.value", "x.start_time"), "level", batch_id)
        edges = signal.edge_detect(levels, BY, width).filter(F.col("new") & (F.col("rising") | F.col("falling")))
        edges = edges.select(*BY, F.col("start_time").alias("edge_t"), "rising")
        # The last word of earlier batches is the one before the edges up to the first word of this one.
        earlier = before.filter("last_file > 0").select(
            *BY, F.col("last_file").alias("file_num"), (F.col("words") - 1).alias("byte_index"), F.col("word_at").alias("t_ns")
        )
        found = tables.write(
            sessions.edge_words(
                edges.unionByName(tables.read("edges", batch_id - 1, _EDGES)),
                words.select(*earlier.columns).unionByName(earlier), width,
            ),
            "edges_found", batch_id,
        )
        # The session goes on if the last control row opened it and it has words; then edges wait for its next word.
        going = after.filter(F.col("state") & (F.col("file_at") == F.col("t_ns"))).select(
            *BY, F.col("last_file").alias("__going")
        )
        if to_the_end:
            going = going.filter("false")
        waiting = found.filter(F.col("file_num").isNull()).join(going, BY, "left_semi")
        tables.write(waiting.select(*_EDGES.names), "edges", batch_id)
        inside = found.filter(F.col("file_num") == F.col("file_before")).select(*_SESSION_EDGES.names)
        known = tables.write(
            inside.unionByName(tables.read("open_record", batch_id - 1, _SESSION_EDGES)), "session_edges", batch_id
        )
        last = F.max_by(F.struct(*_SESSION_EDGES.names[2:]), "edge_t").alias("x")
        held = (
            known.groupBy(*sessions.FILE).agg(last).filter("x.rising")
            .join(going.withColumnRenamed("__going", "file_num"), sessions.FILE, "left_semi")
            .select(*sessions.FILE, "x.*")
        )
        held = tables.write(held.select(*_SESSION_EDGES.names), "open_record", batch_id)
        still_open = held.select(*sessions.FILE, F.col("edge_t").alias("rising_timestamp"))
        records = sessions.line_records(known, width).join(still_open, [*sessions.FILE, "rising_timestamp"], "left_anti")
        tables.write(records.select(*RECORDS.names), "records", batch_id)


def _frontier(reach: DataFrame, kinds: int, delay: int) -> DataFrame:
    """(capture_id, __upto): the time all kinds have reached, less the delay."""
    both = reach.groupBy(*BY).agg(F.count(F.lit(1)).alias("__kinds"), (F.min("t_ns") - delay).alias("__upto"))
    return both.filter(F.col("__kinds") == kinds).drop("__kinds")


def _session_step(
    tables: BatchTables, batch: DataFrame, batch_id: int, width: int, kinds: int, delay: int, to_the_end: bool
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Works off one batch; its ready events, the states before and after it, and its session words."""
    held = tables.read("held", batch_id - 1, SESSION_EVENTS)
    state = tables.read("state", batch_id - 1, _SESSION_STATE)
    seen = tables.read("reach", batch_id - 1, _REACH)
    passed = _frontier(seen, kinds, delay).withColumnRenamed("__upto", "__passed")
    arrived = tables.write(
        batch.select(*SESSION_EVENTS.names)
        .join(passed, BY, "left")
        .withColumn("late", F.coalesce(F.col("t_ns") <= F.col("__passed"), F.lit(False)))
        .drop("__passed"),
        "arrived", batch_id,
    )
    tables.write(arrived.filter("late").drop("late"), "late", batch_id)
    pool = tables.write(arrived.filter("not late").drop("late").unionByName(held), "pool", batch_id)
    reach = tables.write(
        seen.unionByName(pool.select(*BY, "kind", "t_ns")).groupBy(*BY, "kind").agg(F.max("t_ns").alias("t_ns")),
        "reach", batch_id,
    )
    known = pool.join(_frontier(reach, kinds, delay), BY, "left")
    done = F.lit(True) if to_the_end else F.coalesce(F.col("t_ns") <= F.col("__upto"), F.lit(False))
    tables.write(known.filter(~done).select(*SESSION_EVENTS.names), "held", batch_id)
    ready = known.filter(done)
    words = ready.filter("kind = 'word'").select(*BY, "value", "t_ns", (F.col("t_ns") / 1000).alias("timestamp_us"))
    control = ready.filter("kind = 'control'").select(*CONTROL.names)
    both = control.unionByName(state.select(*CONTROL.names))
    numbered = sessions.assign_sessions(words.select(*WORDS.names), both, width).join(
        state.select(*BY, "last_file", "file_at", F.col("words").alias("__before")), BY, "left"
    )
    numbered = tables.write(numbered, "numbered", batch_id)
    # the first session of a batch may go on from the batch before
    opening = numbered.filter("file_num = 1").groupBy(*BY).agg(
        F.coalesce(F.max(F.col("enabled_at") == F.col("file_at")), F.lit(False)).alias("__goes_on")
    )
    last = F.coalesce("last_file", F.lit(0))
    goes_on = F.col("__goes_on")
    before = F.when(goes_on & (F.col("file_num") == 1), F.col("__before")).otherwise(F.lit(0))
    out = numbered.join(opening, BY).select(
        *BY, "value", "t_ns",
        (F.col("file_num") + last - goes_on.cast("bigint")).alias("file_num"),
        (F.col("byte_index") + before).alias("byte_index"),
        "enabled_at",
    )
    out = tables.write(out, "session_words", batch_id)
    newest = out.groupBy(*BY).agg(
        F.max("file_num").alias("n_file"),
        F.max_by("enabled_at", "t_ns").alias("n_at"),
        (F.max_by("byte_index", "t_ns") + 1).alias("n_words"),
        F.max("t_ns").alias("n_word_at"),
    )
    switch = both.groupBy(*BY).agg(F.max(F.struct("t_ns", "state")).alias("c"))
    previous = state.select(*BY, "last_file", "file_at", "words", "word_at")
    after = tables.write(
        switch.join(newest, BY, "left").join(previous, BY, "left").select(
            *BY, "c.state", "c.t_ns",
            F.coalesce("n_file", "last_file", F.lit(0)).cast("bigint").alias("last_file"),
            F.coalesce("n_at", "file_at").alias("file_at"),
            F.coalesce("n_words", "words", F.lit(0)).cast("bigint").alias("words"),
            F.coalesce("n_word_at", "word_at").alias("word_at"),
        ),
        "state", batch_id,
    )
    return ready, state, after, out
