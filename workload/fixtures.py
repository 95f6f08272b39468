"""Capture tables derived from the driver tables, for queries, tests and the bench.

Everything is integer arithmetic over whole tables; the oracle side holds the same
rules as SQL (``workload.oracle_text``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logicspark.operators import signal
from logicspark.schemas import BLOCKS

CAPTURE = "c0"
STEP_NS = 10
SAMPLES_PER_BLOCK = 1024
CHANNELS = 12
ENABLE = 0x600081
DISABLE = 0x600000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def frames(spark: SparkSession, sf_dir: str, source: str = "customer") -> DataFrame:
    """(base, word): one 24-bit command per row of the source table, 1000 ns apart."""
    if source == "customer":
        key, other = "c_custkey", "c_nationkey"
    else:
        key, other = "o_orderkey", "o_custkey"
    return table(spark, sf_dir, source).select(
        (F.col(key) * 1000).alias("base"),
        F.expr(f"({key} % 256) * 65536 + ({other} * 251 + {key} * 7) % 65536").alias("word"),
    )


def waveform(spark: SparkSession, sf_dir: str, source: str = "customer") -> dict[str, DataFrame]:
    """Serial lines cs, clk, mosi (B1), mode 0, chip-select active low, as runs."""
    f = frames(spark, sf_dir, source)
    bits = f.select("base", "word", _rows(0, 23).alias("b"))
    start = spark.range(0, 1, 1, 1).select(F.lit(0).cast("bigint").alias("t"))

    def line(initial: int, *parts: DataFrame) -> DataFrame:
        out = start.select("t", F.lit(bool(initial)).alias("v"))
        for p in parts:
            out = out.unionByName(p)
        return out.select(
            F.lit(CAPTURE).alias("capture_id"), F.col("v").alias("value"), F.col("t").alias("start_time")
        )

    cs = line(
        1,
        f.select((F.col("base") + 100).alias("t"), F.lit(False).alias("v")),
        f.select((F.col("base") + 700).alias("t"), F.lit(True).alias("v")),
    )
    clk = line(
        0,
        bits.select((F.col("base") + 120 + 20 * F.col("b")).alias("t"), F.lit(True).alias("v")),
        bits.select((F.col("base") + 130 + 20 * F.col("b")).alias("t"), F.lit(False).alias("v")),
    )
    # a data run starts where the bit differs from the one before; the first bit of a
    # frame may repeat the last level, which a level lookup does not notice
    bit = F.expr("(shiftright(word, 23 - b) & 1) = 1")
    before = F.expr("b > 0 and ((shiftright(word, 24 - b) & 1) = 1) = ((shiftright(word, 23 - b) & 1) = 1)")
    mosi = line(
        0, bits.filter(~before).select((F.col("base") + 110 + 20 * F.col("b")).alias("t"), bit.alias("v"))
    )
    return {"cs": cs, "clk": clk, "mosi": mosi}


FRAMES_PER_BLOCK = 64
BLOCKS_PER_GROUP = 32


def waveform_blocks(spark: SparkSession, sf_dir: str, source: str = "orders") -> DataFrame:
    """The same serial lines (cs 0, clk 1, mosi 2) as packed blocks, 100 samples a frame."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n, total = FRAMES_PER_BLOCK, FRAMES_PER_BLOCK * BLOCKS_PER_GROUP
        f = rows.column("base").to_numpy() // 1000 - key[0].as_py() * total
        bits = [np.full((total, 100), 1 if c == 0 else 0, np.uint8) for c in range(3)]
        bits[0][f, 10:70] = 0
        bits[1][f, 12:60:2] = 1
        sent = (rows.column("word").to_numpy()[:, None] >> np.arange(23, -1, -1)) & 1
        bits[2][f, 11:59] = np.repeat(sent, 2, axis=1)
        packed = [np.packbits(b.reshape(BLOCKS_PER_GROUP, n * 100), axis=1, bitorder="little") for b in bits]
        return pa.Table.from_pylist(
            [
                {"capture_id": CAPTURE, "channel": c, "block_num": block, "data": d[k].tobytes(),
                 "start_position": block * n * 100, "num_samples": n * 100, "timestamp_step": STEP_NS}
                for k in np.unique(f // n).tolist()
                for block in (key[0].as_py() * BLOCKS_PER_GROUP + k,)
                for c, d in enumerate(packed)
            ],
            schema=to_arrow_schema(BLOCKS),
        )

    group = F.expr(f"base div {1000 * FRAMES_PER_BLOCK * BLOCKS_PER_GROUP}").alias("group")
    return frames(spark, sf_dir, source).select(group, "base", "word").groupBy("group").applyInArrow(build, BLOCKS)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve noisy channels, one sample per event (B2)."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", _rows(0, CHANNELS - 1).alias("k")
    ).select(
        F.lit(CAPTURE).alias("capture_id"),
        F.col("k").alias("channel"),
        F.col("event_id").alias("position"),
        F.expr("(shiftright(event_id * (2 * k + 3) + user_id * (k + 1), k % 5) & 1) = 1").alias("value"),
    )


SERIAL_CS, SERIAL_CLK, SERIAL_MOSI, LINE_CLOCK = 12, 13, 14, 15


def whole_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture with everything: the noisy channels, a serial frame in each 100 events, a line clock.

    Frame f sends enable if f % 4 is 1, disable if it is 3, else a write; the clock has half periods of 5 events."""
    frame, o = "event_id div 100", "cast(event_id % 100 as int)"
    word = (
        f"case when {frame} % 4 = 1 then {ENABLE} when {frame} % 4 = 3 then {DISABLE}"
        f" else ({frame} % 128) * 65536 + {frame} * 7 % 65536 end"
    )
    bit = f"cast(shiftright({word}, 23 - least(({o} - 11) div 2, 23)) & 1 as int)"
    lines = {
        SERIAL_CS: f"not ({o} >= 10 and {o} < 70)",
        SERIAL_CLK: f"{o} >= 12 and {o} < 60 and {o} % 2 = 0",
        SERIAL_MOSI: f"{o} >= 11 and {o} < 59 and {bit} = 1",
        LINE_CLOCK: "(event_id div 5) % 2 = 1",
    }
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.expr(v).alias("value")) for c, v in lines.items()]))
    more = (
        table(spark, sf_dir, "events")
        .select(F.lit(CAPTURE).alias("capture_id"), F.col("event_id").alias("position"), pair.alias("x"))
        .select("capture_id", "x.channel", "position", "x.value")
    )
    return levels(spark, sf_dir).unionByName(more)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log (B3): signup enables, error disables, click reads, others write."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.lit("log0").alias("log_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 1000).alias("time_ns"),
        F.when(kind == "signup", F.lit(ENABLE))
        .when(kind == "error", F.lit(DISABLE))
        .otherwise(
            F.when(kind == "click", F.lit(0x800000)).otherwise(F.lit(0))
            + F.expr("(user_id % 128) * 65536 + event_id % 65536")
        )
        .cast("bigint")
        .alias("mosi"),
    )


def blocky_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log with sessions of some 64 events, long enough for several lines."""
    kind, turn = F.col("event_type"), F.expr("event_id div 64 % 2")
    return table(spark, sf_dir, "events").select(
        F.lit(CAPTURE).alias("capture_id"),
        (F.col("event_id") * 1000).alias("t_ns"),
        F.when((kind == "signup") & (turn == 0), F.lit(ENABLE))
        .when((kind == "error") & (turn == 1), F.lit(DISABLE))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("mosi"),
    )


def line_clock(spark: SparkSession, sf_dir: str, samples: int = 5) -> DataFrame:
    """Square wave (B4) as runs of ``samples`` events."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.expr(f"event_id div {samples}").alias("k"))
        .agg((F.min("event_id") * 1000).alias("start_time"))
        .select(F.lit(CAPTURE).alias("capture_id"), (F.col("k") % 2 == 1).alias("value"), "start_time")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """22 x n image from all elements of the embeddings (B5), planes G, B, R as 16-bit values; missing ones are 0."""

    def plane(p: int) -> Column:
        value = F.floor((F.get("embedding", F.col("col") * 3 + p).cast("double") + 1) * 20000).cast("int")
        return F.coalesce(value, F.lit(0))

    return (
        table(spark, sf_dir, "embeddings")
        .select(F.concat(F.lit("img"), F.col("vec_id") * 0).alias("image_id"), F.col("vec_id").alias("row"), "embedding", _rows(0, 21).alias("col"))
        .select("image_id", "row", F.col("col").cast("bigint").alias("col"), plane(0).alias("g"), plane(1).alias("b"), plane(2).alias("r"))
    )


BODY_CHUNK = 1000
LINE_STRIDE = 137  # 132 bytes of pixels and a gap


def body(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pixel image as body chunks (image_id, chunk_no, data) and line starts.

    Line r starts at r * 137 + r % 3; bytes between lines are 0xEE.
    """
    px = pixels(spark, sf_dir)
    start = F.expr(f"row * {LINE_STRIDE} + row % 3")
    plane = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(p).alias("v")) for i, p in enumerate("gbr")]))
    values = px.select("image_id", (start + F.col("col") * 6).alias("at"), plane.alias("p")).select(
        "image_id", (F.col("at") + F.col("p.i") * 2).alias("at"), F.col("p.v").alias("v")
    )
    pair = F.explode(F.array(F.struct(F.col("at").alias("at"), F.expr("v % 256").alias("x")),
                             F.struct((F.col("at") + 1).alias("at"), F.expr("v div 256").alias("x"))))
    data = values.select("image_id", pair.alias("b")).select("image_id", "b.at", "b.x")
    gaps = px.filter("col = 0").select(
        "image_id", F.explode(F.sequence(start + 132, start + LINE_STRIDE)).alias("at"), F.lit(238).cast("bigint").alias("x")
    )
    # the byte after a gap may belong to the next line, whose data wins; bytes before line 0 do not exist
    bytes_ = gaps.withColumn("o", F.lit(1)).unionByName(data.withColumn("o", F.lit(0)).withColumn("x", F.col("x").cast("bigint")))
    bytes_ = bytes_.groupBy("image_id", "at").agg(F.min_by("x", "o").alias("x"))
    chunks = (
        bytes_.groupBy("image_id", F.expr(f"at div {BODY_CHUNK}").alias("chunk_no"))
        .agg(F.array_sort(F.collect_list(F.struct("at", F.format_string("%02X", "x").alias("h")))).alias("xs"))
        .select("image_id", "chunk_no", F.unhex(F.concat_ws("", F.col("xs.h"))).alias("data"))
    )
    lines = px.filter("col = 0").select("image_id", "row", start.alias("line_start"))
    return chunks, lines


def shared_path(spark: SparkSession, name: str) -> str:
    """New folder name below the shared folder, as a plain path where that is a mounted one."""
    import re
    import uuid

    from logicspark.plans.jobs import shared_folder

    return re.sub(r"^file:/+", "/", f"{shared_folder(spark)}/logicspark/{name}-{uuid.uuid4().hex}")


RUN_SAMPLES = 4096


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the noisy channels in captures ``c{r % 3}/run{r}`` of 4,096 samples, at 100 and 50 MHz in turn."""
    run = F.expr(f"position div {RUN_SAMPLES}")
    cut = levels(spark, sf_dir).withColumns(
        {"capture_id": F.format_string("c%d/run%d", run % 3, run), "position": F.col("position") % RUN_SAMPLES}
    )
    packed = signal.pack_levels(cut, SAMPLES_PER_BLOCK, STEP_NS)
    slow = F.regexp_extract("capture_id", "run([0-9]+)$", 1).cast("bigint") % 2 == 1
    return packed.withColumn("timestamp_step", F.when(slow, 2 * STEP_NS).otherwise(STEP_NS).cast("bigint"))


def write_archives(blocks: DataFrame, folder: str) -> None:
    """One archive ``<folder>/<capture_id>.zip`` for each capture of a block table, its rate from the time step.

    Sorted blocks stream through the tasks into the open archive; the header goes in last, when its totals are known."""
    import os
    import zipfile

    def finish(archive: zipfile.ZipFile, totals: dict[str, int]) -> None:
        header = [f"total probes = {totals['probes']}", f"samplerate = {1000 // totals['step']} MHz"]
        header += [f"total samples = {totals['samples']}", f"total blocks = {totals['blocks']}"]
        names = [f"probe{c} = line {c}" for c in range(totals["probes"])]
        archive.writestr("header", "\n".join(["[version]", *header, *names]))
        archive.close()
        os.replace(archive.filename, archive.filename.removesuffix(".part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, archive, totals = None, None, {}
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["capture_id"] != of:
                    if archive is not None:
                        finish(archive, totals)
                    of, totals = row["capture_id"], dict.fromkeys(("probes", "samples", "blocks"), 0)
                    os.makedirs(os.path.dirname(f"{folder}/{of}"), exist_ok=True)
                    archive = zipfile.ZipFile(f"{folder}/{of}.zip.part", "w", zipfile.ZIP_DEFLATED)
                archive.writestr(f"L-{row['channel']}/{row['block_num']}", row["data"])
                totals["step"] = row["timestamp_step"]
                seen = (row["channel"] + 1, row["start_position"] + row["num_samples"], row["block_num"] + 1)
                for name, value in zip(("probes", "samples", "blocks"), seen, strict=True):
                    totals[name] = max(totals[name], value)
        if archive is not None:
            finish(archive, totals)
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    order = ["capture_id", "channel", "block_num"]
    dealt = blocks.select(*BLOCKS.names).repartition("capture_id").sortWithinPartitions(*order)
    dealt.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()
