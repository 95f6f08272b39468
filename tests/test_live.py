"""Live streams end to end: line records of sessions, and bus words under a control stream."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from logicspark import CsPolarity, StrobeMode
from logicspark.operators import parallel, sessions, signal
from logicspark.schemas import BLOCKS, CONTROL, fields
from logicspark.sources import capture
from logicspark.streaming import incremental
from tests.conftest import SF, rows
from workload import fixtures as fx


def feed(spark, folder, schema, parts):
    """A file stream that gets one more file before every run of ``start``; each run goes on from the one before."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        yield spark.readStream.schema(schema).parquet(folder)


def finish(query):
    query.awaitTermination(600)
    assert query.exception() is None


def live_capture(seed):
    """Words, control rows and line-clock runs of two captures, with ties between all three."""
    rng = random.Random(seed)
    words, control, line = [], [], []
    for c in ("a", "b"):
        words += [(c, rng.randrange(256), t, t / 1000) for t in sorted(rng.sample(range(3000), 260))]
        times = [0, *sorted(rng.sample(range(1, 3000), 17))]
        control += [(c, bool(i % 2), t) for i, t in enumerate(times)]
        level, at = rng.random() < 0.5, 0
        while at < 3000:
            line.append((c, level, at))
            level, at = not level, at + rng.choice((2, 3, 15, 40, 90))
    return words, control, line


def as_events(words, control, line):
    out = [(c, "word", t, v, None) for c, v, t, _ in words]
    out += [(c, "control", t, None, s) for c, s, t in control]
    return out + [(c, "line", t, None, v) for c, v, t in line]


@pytest.mark.parametrize("pieces,jitter", [(3, 150), (7, 150)])
def test_line_records_equal_batch(spark, tmp_path, pieces, jitter):
    words, control, line = live_capture(pieces)
    w = spark.createDataFrame(words, "capture_id string, value long, t_ns long, timestamp_us double")
    s = spark.createDataFrame(control, CONTROL)
    clock = spark.createDataFrame(line, "capture_id string, value boolean, start_time long")
    want = sessions.assign_sessions(w, s, width=100).cache()
    edges = sessions.line_edge_to_word(clock, want, width=100)
    records = sessions.line_records(edges, width=100).select(*incremental.RECORDS.names).cache()
    index = sessions.capture_index(want, records, width=100)
    rng = random.Random(pieces)
    events = sorted(as_events(words, control, line), key=lambda r: r[2] + rng.randrange(jitter + 1))
    size = -(-len(events) // pieces)
    parts = [rng.sample(p, len(p)) for p in (events[i * size : (i + 1) * size] for i in range(pieces))]
    out = str(tmp_path / "out")
    for live in feed(spark, str(tmp_path / "in"), incremental.SESSION_EVENTS, parts):
        finish(incremental.stream_sessions(live, out, width=100, line_clock=True, delay=jitter))
    stored = incremental.BatchTables(spark, out)
    assert stored.result("late", incremental.SESSION_EVENTS).count() == 0
    assert 0 < stored.result("records", incremental.RECORDS).count() < records.count()
    incremental.flush_sessions(spark, out, width=100, line_clock=True)
    assert rows(stored.result("session_words", incremental.SESSION_WORDS)) == rows(
        want.select(*incremental.SESSION_WORDS.names)
    )
    assert rows(stored.result("records", incremental.RECORDS)) == rows(records)
    assert rows(incremental.session_index(spark, out, width=100)) == rows(index)
    assert records.filter("falling_timestamp = 0").count() and records.filter("falling_timestamp > 0").count()
    assert index.filter("width > 0").count()


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks"))
    levels = fx.levels(spark, SF)
    two = levels.unionByName(levels.withColumn("capture_id", F.lit("c1")).withColumn("value", ~F.col("value")))
    signal.pack_levels(two, 64, 1000).write.mode("overwrite").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


BUS = dict(strobe=10, data=list(range(8)), cs=8, mode=StrobeMode.ANY, polarity=CsPolarity.ACTIVE_LOW)
BUS_WORDS = fields(capture_id="string", position="bigint", value="bigint", t_ns="bigint")


@pytest.mark.parametrize("order", ["control first", "control later", "mixed"])
def test_control_may_come_after_its_blocks(spark, blocks, tmp_path, order):
    times = [0, 100_000, 163_000, 420_000, 700_000]
    gate = [(c, bool(i % 2), t) for c in ("c0", "c1") for i, t in enumerate(times)]
    want = parallel.parallel_words(blocks, control=spark.createDataFrame(gate, CONTROL), **BUS)
    packed = blocks.toPandas().sample(frac=1, random_state=3)
    block_parts = [packed.iloc[i::3].itertuples(index=False, name=None) for i in range(3)]
    control_parts = [gate[i::3] for i in range(3)] if order == "mixed" else [gate, [], []]
    if order == "control later":
        control_parts = [[], [], gate]
    if order == "mixed":
        control_parts = [[r for r in gate if lo <= r[2] < hi] for lo, hi in ((0, 150_000), (150_000, 500_000), (500_000, 1 << 60))]
    out = str(tmp_path / "out")
    for k, (some, rest) in enumerate(zip(block_parts, control_parts, strict=True)):
        spark.createDataFrame(list(some), BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "blocks"))
        spark.createDataFrame(rest, CONTROL).coalesce(1).write.mode("append").parquet(str(tmp_path / "control"))
        live = spark.readStream.schema(BLOCKS).parquet(str(tmp_path / "blocks"))
        control = spark.readStream.schema(CONTROL).parquet(str(tmp_path / "control"))
        finish(incremental.stream_parallel(live, out, control=control, **BUS))
    stored = incremental.BatchTables(spark, out)
    before = stored.result("words", BUS_WORDS).count()
    incremental.flush_parallel(spark, out, **BUS)
    assert rows(stored.result("words", BUS_WORDS)) == rows(want.select(*BUS_WORDS.names))
    assert 0 < before < want.count() and stored.result("late", CONTROL).count() == 0


def test_control_behind_its_blocks_is_late(spark, blocks, tmp_path):
    one = blocks.filter("capture_id = 'c0' and block_num = 0").toPandas()
    out = str(tmp_path / "out")
    for control in ([("c0", True, 0), ("c0", None, 10_000_000)], [("c0", False, 40_000), ("c0", False, 20_000_000)]):
        spark.createDataFrame(list(one.itertuples(index=False, name=None)), BLOCKS).write.mode("append").parquet(str(tmp_path / "b"))
        spark.createDataFrame(control, CONTROL).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        live = spark.readStream.schema(BLOCKS).parquet(str(tmp_path / "b"))
        finish(incremental.stream_parallel(live, out, control=spark.readStream.schema(CONTROL).parquet(str(tmp_path / "c")), **BUS))
    stored = incremental.BatchTables(spark, out)
    assert rows(stored.result("late", CONTROL)) == [("c0", False, 40_000)]
    want = parallel.parallel_words(blocks.filter("capture_id = 'c0' and block_num = 0"), **BUS)
    assert rows(stored.result("words", BUS_WORDS)) == rows(want.select(*BUS_WORDS.names))


def write_archive(path, data, blocks, samples_per_block, samples):
    """An archive that says ``samples`` samples and holds ``blocks`` (channel -> number of blocks) so far."""
    total = -(-samples // samples_per_block)
    header = f"total probes = {len(data)}\nsamplerate = 100 MHz\ntotal samples = {samples}\ntotal blocks = {total}\n"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("header", header)
        for channel, held in blocks.items():
            for block in held:
                part = data[channel][block * samples_per_block : (block + 1) * samples_per_block]
                archive.writestr(f"L-{channel}/{block}", np.packbits(part, bitorder="little").tobytes())


def test_growing_archives(spark, tmp_path):
    """Two archives that grow over four looks, one of them added late, one with a gap for a while."""
    rng = np.random.default_rng(2)
    data = {name: rng.integers(0, 2, (3, 1000), dtype=np.uint8) for name in ("x", "y")}
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    looks = [
        {"x": {0: range(1), 1: range(1)}},
        {"x": {0: range(3), 1: [0, 2], 2: range(2)}, "y": {0: range(2), 1: range(2), 2: range(2)}},
        {"x": {0: range(3), 1: range(3), 2: range(3)}, "y": {0: range(2), 1: range(2), 2: range(2)}},
        {n: {c: range(4) for c in range(3)} for n in ("x", "y")},
    ]
    counts = []
    for look in looks:
        for name, held in look.items():
            write_archive(folder / f"{name}.zip", data[name], held, 256, 1000)
        (folder / "still-written.zip").write_bytes(b"PK")
        live = capture.stream_capture(spark, str(folder), blocks_per_partition=2)
        query = live.writeStream.format("parquet").option("checkpointLocation", f"{out}-at")
        finish(query.trigger(availableNow=True).start(out))
        counts.append(spark.read.parquet(out).count())
    (folder / "still-written.zip").unlink()
    assert counts == [2, 12, 15, 24]
    assert rows(spark.read.parquet(out)) == rows(capture.read_capture(spark, str(folder)).blocks)
    finish(query.trigger(availableNow=True).start(out))
    assert spark.read.parquet(out).count() == 24


def test_following_some_channels(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 2, (3, 700), dtype=np.uint8)
    write_archive(tmp_path / "x.zip", data, {c: range(3) for c in range(3)}, 256, 700)
    live = capture.stream_capture(spark, str(tmp_path / "*.zip"), channels=[2])
    finish(live.writeStream.format("memory").queryName("some_channels").trigger(availableNow=True).start())
    want = capture.read_capture(spark, str(tmp_path / "*.zip"), channels=[2]).blocks
    assert rows(spark.table("some_channels")) == rows(want) and want.count() == 3
    with pytest.raises(Exception, match="only the blocks"):
        header = spark.readStream.format("logic_capture").option("table", "header").load(str(tmp_path))
        finish(header.writeStream.format("noop").trigger(availableNow=True).start())


def test_small_archives_share_a_task(tmp_path):
    data = np.random.default_rng(4).integers(0, 2, (3, 700), dtype=np.uint8)
    for k in range(40):
        write_archive(tmp_path / f"x{k:02d}.zip", data, {c: range(3) for c in range(3)}, 256, 700)
    reader = capture._BlockStream({"path": str(tmp_path / "*.zip"), "blocks_per_partition": "2"})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == 1 and reader.partitions(end, end) == []
    read = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    places = [(r["capture_id"], r["channel"], r["block_num"]) for r in read]
    assert places == [(f"x{k:02d}", c, b) for k in range(40) for c in range(3) for b in range(3)]
