"""Registered queries of streams that run to the end of what is there, and of files written and read back, with their SQL.

A stream's input is written from the driver tables to the shared folder first; its SQL is that of the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logicspark import StrobeMode
from logicspark.operators import parallel, signal
from logicspark.plans import jobs
from logicspark.plans.progress import observe_progress
from logicspark.schemas import BLOCKS, CONTROL, SPI_WORDS, fields
from logicspark.sources import capture, sinks, tables
from logicspark.streaming import incremental, processors
from workload import fixtures as fx
from workload import queries as q
from workload.oracle_text import (
    BLOCKY_CONTROL,
    CONTROL as CONTROL_SQL,
    DESCRIBED,
    FRAMED_CONTROL,
    LINES,
    ORACLES,
    SCALED,
    WORDS,
    _shift,
    lines,
    sessions,
)

BUS = dict(strobe=q.STROBE, data=q.DATA, mode=StrobeMode.ANY)


def stored(df: DataFrame, name: str, files: int = 3) -> str:
    """``df`` as some Parquet files of the shared folder, which a file stream takes one by one."""
    path = fx.shared_path(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return path


def finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def to_the_end(stream: DataFrame, name: str) -> DataFrame:
    """Rows of a stream that ends with what is there."""
    spark, out = stream.sparkSession, fx.shared_path(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-at")
    finished(writer.trigger(availableNow=True).start(out))
    return spark.read.schema(stream.schema).parquet(out)


def block_stream(spark: SparkSession, packed: DataFrame) -> DataFrame:
    return processors.stream_blocks(spark, stored(packed.select(*BLOCKS.names), "blocks"), 1)


@q.query
def stream_blocks(spark, sf):
    """Archives followed by the stream reader."""
    opened = capture.stream_capture(spark, q._archives(spark, sf) + "/*/*.zip", blocks_per_partition=4)
    return to_the_end(opened, "followed").select(
        "capture_id", "channel", "block_num", F.hex("data").alias("data_hex"), "start_position", "num_samples", "timestamp_step", "first", "last"
    )


@q.query
def stream_edges(spark, sf):
    processors.use_state_store(spark)
    runs = processors.stream_edges(block_stream(spark, q.blocks(spark, sf)))
    return to_the_end(runs, "runs").select("channel", "start_time", *q.as_int("value"))


@q.query
def stream_spi(spark, sf):
    out = fx.shared_path(spark, "stream-spi")
    live = block_stream(spark, fx.waveform_blocks(spark, sf))
    finished(incremental.stream_spi(live, out, cs=0, clk=1, mosi=2, bits_per_word=24, width=q.T))
    words = incremental.BatchTables(spark, out).result("words", SPI_WORDS)
    return words.select("window_id", "word_no", "mosi", "miso", "t_ns")


@q.query
def stream_control(spark, sf):
    processors.use_state_store(spark)
    words = q.capture_commands(spark, sf)
    live = spark.readStream.schema(words.schema).parquet(stored(words, "commands"))
    out = to_the_end(processors.stream_control(live), "control")
    return out.filter("not late").select("t_ns", *q.as_int("state"))


@q.query
def stream_parallel(spark, sf):
    """Blocks and the control rows that gate them, both as streams."""
    out = fx.shared_path(spark, "stream-parallel")
    control = spark.readStream.schema(CONTROL).parquet(stored(q.control_rows(spark, sf).select(*CONTROL.names), "control", 1))
    live = block_stream(spark, q.blocks(spark, sf, 1000))
    finished(incremental.stream_parallel(live, out, control=control, width=q.T, **BUS))
    incremental.flush_parallel(spark, out, width=q.T, **BUS)
    words = incremental.BatchTables(spark, out).result("words", fields(capture_id="string", value="bigint", t_ns="bigint"))
    return words.select("t_ns", "value")


def live_sessions(spark: SparkSession, sf: str) -> str:
    """Words, control rows and line clock of the noisy bus as one stream of time slices; the folder of its tables."""
    job_control = q.control.control_state(fx.blocky_commands(spark, sf), width=q.T)
    words = parallel.parallel_words(q.blocks(spark, sf, 1000), **BUS)
    events = incremental.session_events(words, job_control, fx.line_clock(spark, sf))
    path, out = fx.shared_path(spark, "events"), fx.shared_path(spark, "stream-sessions")
    events.repartitionByRange(3, "t_ns").write.parquet(path)
    live = spark.readStream.schema(incremental.SESSION_EVENTS).parquet(path)
    finished(incremental.stream_sessions(live, out, q.T, line_clock=True))
    incremental.flush_sessions(spark, out, q.T, line_clock=True)
    return out


@q.query
def stream_sessions(spark, sf):
    out = incremental.BatchTables(spark, live_sessions(spark, sf)).result("session_words", incremental.SESSION_WORDS)
    return out.select("file_num", "byte_index", "t_ns")


@q.query
def stream_line_records(spark, sf):
    out = incremental.BatchTables(spark, live_sessions(spark, sf)).result("records", incremental.RECORDS)
    return out.drop("capture_id")


@q.query
def stream_session_index(spark, sf):
    return incremental.session_index(spark, live_sessions(spark, sf), q.T).drop("capture_id")


@q.query
def stream_limit(spark, sf):
    words = q.capture_commands(spark, sf)
    live = spark.readStream.schema(words.schema).parquet(stored(words, "commands"))
    return to_the_end(processors.stream_limit(live, 50), "limited").agg(F.count(F.lit(1)).alias("n"))


@q.query
def progress_metrics(spark, sf):
    """What a job's output was, observed while it was written."""
    observed, seen = observe_progress(q.bus_words(spark, sf), "bus words")
    observed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "rows bigint, first_ns bigint, last_ns bigint")


# --- files ----------------------------------------------------------------------


def session_number(name: str) -> F.Column:
    return F.regexp_extract(name, "capture_([0-9]+)", 1).cast("bigint")


def session_files(spark: SparkSession, sf: str) -> str:
    """Folder with bodies and line tables of the noisy bus's sessions."""
    job, out = q.capture_job(spark, sf), fx.shared_path(spark, "sessions")
    sinks.write_bodies(job.words, out, chunk_bytes=64)
    sinks.write_line_tables(job.records, out, width=q.T)
    return out


def line_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all line tables below a folder, which is listed as one path."""
    columns = ", ".join(f"{c} string" for c in sinks.LINE_RECORD_COLUMNS)
    return spark.read.schema(columns).csv(folder, header=True, recursiveFileLookup=True, pathGlobFilter="*_tgck.csv")


@q.query
def line_record_sink(spark, sf):
    """Line tables as text, all eight columns, one file for each session that has records."""
    back = line_tables(spark, session_files(spark, sf))
    file = session_number("_metadata.file_name")
    return back.select(file.alias("file_num"), *[F.col(c).cast("bigint").alias(c) for c in back.columns])


@q.query
def line_record_scan(spark, sf):
    got = tables.read_line_records(spark, session_files(spark, sf) + "/*/*_tgck.csv")
    place = F.row_number().over(W.partitionBy("image_id").orderBy("seq"))
    return got.select(session_number("image_id").alias("file_num"), place.alias("place"), "falling_byte_index")


@q.query
def companion_path(spark, sf):
    """Bodies, and the names of the tables that belong to them."""
    bodies = spark.read.format("binaryFile").load(session_files(spark, sf) + "/*/*.bin").select("path")
    table = F.element_at(F.split(tables.companion_path(F.col("path")), "/"), -1)
    return bodies.select(session_number("path").alias("file_num"), table.alias("table_name"))


@q.query
def command_dir_scan(spark, sf):
    """A folder of logs with annotated and register tables between them, which are passed over."""
    out = fx.shared_path(spark, "log-folder")
    text = F.format_string("%d,%d.00,%06X", "seq", "time_ns", "mosi")
    line = F.array_sort(F.collect_list(F.struct("seq", text.alias("line"))))
    logs = fx.commands(spark, sf).groupBy(F.expr("seq div 1000").alias("file_num")).agg(line.alias("x"))
    body = F.concat(F.lit("Id,Time[ns],1:SPI: MOSI data\n"), F.array_join("x.line", "\n"), F.lit("\n"))
    chunks = logs.select(
        F.lit("logs").alias("capture_id"), "file_num", F.lit(0).cast("bigint").alias("chunk_no"), body.cast("binary").alias("data")
    )
    for suffix in (".csv", "_annotated.csv", "_spi.csv"):
        sinks._write_files(chunks, out, 1 << 23, False, suffix)
    got = tables.read_log_folder(spark, f"{out}/logs")
    return got.select(session_number("log_id").alias("log"), F.col("id").cast("bigint").alias("seq"), "time_text", "mosi_text")


@q.query
def controlled_capture_files(spark, sf):
    """The whole job from one block table to bodies and line tables; the bodies read back."""
    job = jobs.capture_job(
        q.whole_blocks(spark, sf), cs=fx.SERIAL_CS, clk=fx.SERIAL_CLK, mosi=fx.SERIAL_MOSI, line_clock=fx.LINE_CLOCK,
        strobe=q.STROBE, data=q.DATA, width=q.T,
    )
    out = fx.shared_path(spark, "job")
    sinks.write_bodies(job.words, out, chunk_bytes=128)
    sinks.write_line_tables(job.records, out, width=q.T)
    chunks = tables.read_body_chunks(spark, out + "/*/*.bin", 100)
    records = line_tables(spark, out)
    lines_of = records.groupBy(session_number("_metadata.file_name").alias("file_num")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("falling_timestamp").cast("bigint")).alias("falls")
    )
    bodies = chunks.select(session_number("image_id").alias("file_num"), "chunk_no", F.hex("data").alias("data_hex"))
    return bodies.join(lines_of, "file_num", "left").fillna(0, ["lines", "falls"])


@q.query
def scan_image_files(spark, sf):
    """Two scans of different line width, written as bodies and line tables, opened as a folder."""
    pixels = fx.pixels(spark, sf)
    words, records = None, None
    for number, columns in ((1, 22), (2, 11)):
        width = columns * 6
        file = [F.lit("scan").alias("capture_id"), F.lit(number).cast("bigint").alias("file_num")]
        values = F.array(*[F.expr(f"cast(shiftright({p}, {s}) & 255 as bigint)") for p in "gbr" for s in (0, 8)])
        own = pixels.filter(F.col("col") < columns).select(*file, "row", "col", F.posexplode(values).alias("k", "value"))
        own = own.select("capture_id", "file_num", (4 + F.col("row") * width + F.col("col") * 6 + F.col("k")).alias("byte_index"), "value")
        lead = spark.range(4).select(*file, F.col("id").alias("byte_index"), F.lit(0).cast("bigint").alias("value"))
        rows = pixels.filter("col = 0").select("row")
        rows = rows.union(rows.select(F.max("row") + 1))
        at = F.col("row") * width
        table = rows.select(
            *file, *[(at if "index" in c else F.col("row") * 1000).cast("bigint").alias(c) for c in sinks.LINE_RECORD_COLUMNS]
        )
        words = own.unionByName(lead) if words is None else words.unionByName(own).unionByName(lead)
        records = table if records is None else records.unionByName(table)
    out = fx.shared_path(spark, "scans")
    sinks.write_bodies(words, out, chunk_bytes=4096)
    sinks.write_line_tables(records, out, width=q.S)
    frame = jobs.scan_image_files(spark, out, chunk_bytes=1000, width=q.T, bg_delta=1, gr_delta=2, gain=q.GAIN)
    return frame.select(session_number("image_id").alias("file_num"), "row", "col", "rgb")


_SCAN = "(r << 16) + (g << 8) + b as rgb from shifted"
ORACLES.update(
    {
        "stream_blocks": ORACLES["archive_blocks"],
        "stream_edges": ORACLES["edge_runs"],
        "stream_spi": ORACLES["spi_word_blocks"],
        "stream_control": ORACLES["control_state"],
        "stream_parallel": f"with {WORDS}, {CONTROL_SQL} select w.t as t_ns, value from words w"
        " asof join (select t, max(s) as s from control group by t) c on w.t >= c.t where c.s = 1",
        "stream_sessions": ORACLES["byte_index"],
        "stream_line_records": ORACLES["line_records"],
        "stream_session_index": ORACLES["capture_index"],
        "stream_limit": "select least(count(*), 50) as n from events",
        "progress_metrics": f"with {WORDS} select count(*) as rows, min(t) as first_ns, max(t) as last_ns from words",
        "line_record_sink": ORACLES["line_records"],
        "line_record_scan": f"""with {LINES}, n as (select file_num, count(*) as n from records group by file_num)
select file_num, row_number() over (partition by file_num order by rising_timestamp) as place, falling_byte_index
from records join n using (file_num) where n >= 2""",
        "companion_path": f"""with {sessions(control=BLOCKY_CONTROL)}
select distinct file_num, printf('capture_%04d_tgck.csv', file_num) as table_name from sw""",
        "command_dir_scan": f"""{DESCRIBED.split(', src as', 1)[0]} select seq // 1000 as log, seq,
  printf('%d.00', time_ns) as time_text, printf('%06X', mosi) as mosi_text from commands""",
        "controlled_capture_files": f"""with {lines(control=FRAMED_CONTROL)}, r as (
  select file_num, count(*) as lines, cast(sum(falling_timestamp) as bigint) as falls from records group by file_num),
b as (
  select file_num, byte_index // 100 as chunk_no,
    string_agg(printf('%02X', value & 255), '' order by byte_index) as data_hex from sw group by file_num, byte_index // 100)
select b.*, coalesce(lines, 0) as lines, coalesce(falls, 0) as falls from b left join r using (file_num)""",
        "scan_image_files": f"""with {SCALED}, {_shift('sc', '- 1', '+ 2')}
select 1 as file_num, row, col, {_SCAN} union all select 2, row, col, {_SCAN} where col < 11""",
    }
)
