import random

import pytest
from pyspark.sql import functions as F

from logicspark import CsPolarity, SpiMode, StrobeMode
from logicspark.operators import control, parallel, sessions, signal, spi
from logicspark.schemas import BLOCKS, SPI_WORDS, fields
from logicspark.streaming import incremental, processors
from tests.conftest import SF, rows
from workload import fixtures as fx


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks"))
    levels = fx.levels(spark, SF)
    two = levels.unionByName(levels.withColumn("capture_id", F.lit("c1")).withColumn("value", ~F.col("value")))
    signal.pack_levels(two, 64, 1000).write.mode("overwrite").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


def split_files(spark, blocks, folder, pieces):
    """The blocks in shuffled order, one file per micro-batch."""
    pdf = blocks.toPandas().sample(frac=1, random_state=pieces)
    for i in range(pieces):
        part = pdf.iloc[i::pieces]
        spark.createDataFrame(part, BLOCKS).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run_to_memory(df, name, folder):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.mark.parametrize("pieces", [1, 3])
def test_edges_equal_batch(spark, blocks, tmp_path, pieces):
    src = split_files(spark, blocks, str(tmp_path / "in"), pieces)
    live = processors.stream_edges(processors.stream_blocks(spark, src, 1))
    got = run_to_memory(live, f"edges_{pieces}", str(tmp_path / "cp"))
    assert rows(got) == rows(signal.edge_runs(blocks))


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_spi_equals_batch(spark, blocks, tmp_path, pieces):
    runs = signal.edge_runs(blocks)
    line = lambda c: runs.filter(F.col("channel") == c)
    want = spi.spi_words(
        line(7), line(8), line(6), line(5), bits_per_word=1, mode=SpiMode.MODE1, polarity=CsPolarity.ACTIVE_LOW
    )
    src = split_files(spark, blocks, str(tmp_path / "in"), pieces)
    out = str(tmp_path / "out")
    q = incremental.stream_spi(
        processors.stream_blocks(spark, src, 1), out, cs=8, clk=7, mosi=6, miso=5,
        bits_per_word=1, mode=SpiMode.MODE1, width=1 << 14,
    )
    q.awaitTermination(600)
    assert q.exception() is None
    got = incremental.BatchTables(spark, out).result("words", SPI_WORDS)
    assert rows(got) == rows(want.select(*SPI_WORDS.names))
    assert want.count() > 50


def test_parallel_equals_batch(spark, blocks, tmp_path):
    options = dict(strobe=10, data=list(range(8)), cs=8, mode=StrobeMode.ANY, polarity=CsPolarity.ACTIVE_LOW)
    gate = spark.createDataFrame(
        [(c, s, t) for c in ("c0", "c1") for s, t in ((False, 0), (True, 100_000), (False, 700_000))],
        "capture_id string, state boolean, t_ns long",
    )
    want = parallel.parallel_words(blocks, control=gate, **options)
    src = split_files(spark, blocks, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    q = incremental.stream_parallel(processors.stream_blocks(spark, src, 1), out, control=gate, **options)
    q.awaitTermination(600)
    assert q.exception() is None
    schema = fields(capture_id="string", position="bigint", value="bigint", t_ns="bigint")
    assert rows(incremental.BatchTables(spark, out).result("words", schema)) == rows(want.select(*schema.names))


def commands(seed):
    rng = random.Random(seed)
    return [
        (c, 10 * i + 10, rng.choice([0x600081, 0x600000, 0x123456]))
        for c in ("a", "b") for i in range(40)
    ]


@pytest.mark.parametrize("pieces", [1, 3])
def test_control_equals_batch(spark, tmp_path, pieces):
    data = commands(pieces)
    schema = "capture_id string, t_ns long, mosi long"
    src = str(tmp_path / "in")
    data.sort(key=lambda r: r[1])
    size = -(-len(data) // pieces)
    import time

    for i in range(pieces):
        spark.createDataFrame(data[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the file source orders by modification time
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_to_memory(processors.stream_control(live), f"control_{pieces}", str(tmp_path / "cp"))
    want = control.control_state(spark.createDataFrame(data, schema))
    assert rows(got.filter(~F.col("late")).select("capture_id", "state", "t_ns")) == rows(want)
    assert got.filter("late").count() == 0


def test_limit(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(20).repartition(4).write.parquet(src)
    live = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    assert run_to_memory(processors.stream_limit(live, 7), "limited", str(tmp_path / "cp")).count() == 7


@pytest.mark.parametrize("pieces", [1, 4])
def test_sessions_equal_batch(spark, tmp_path, pieces):
    rng = random.Random(4)
    words = [(c, rng.randrange(256), t, t / 1000) for c in ("a", "b") for t in sorted(rng.sample(range(2000), 150))]
    states = [
        (c, bool(i % 2), t)
        for c in ("a", "b") for i, t in enumerate([0, *sorted(rng.sample(range(1, 2000), 21))])
    ]
    # words go on after the last control row, so the tail is held until the flush
    words += [(c, 1, 5000 + k, 5.0) for c in ("a", "b") for k in range(3)]
    states = [r for r in states if r[2] < 1990] + [(c, True, 1995) for c in ("a", "b")]
    w = spark.createDataFrame(words, "capture_id string, value long, t_ns long, timestamp_us double")
    s = spark.createDataFrame(states, "capture_id string, state boolean, t_ns long")
    want = sessions.assign_sessions(w, s, width=100).select(*incremental.SESSION_WORDS.names)
    src = str(tmp_path / "in")
    events = incremental.session_events(w, s).toPandas().sort_values("t_ns", kind="stable")
    import time

    size = -(-len(events) // pieces)
    for i in range(pieces):
        part = spark.createDataFrame(
            [tuple(None if x != x else x for x in r) for r in events.iloc[i * size : (i + 1) * size].astype(object).values.tolist()],
            "capture_id string, kind string, t_ns long, value double, state boolean",
        ).withColumn("value", F.col("value").cast("bigint"))
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    live = spark.readStream.schema(incremental.SESSION_EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    q = incremental.stream_sessions(live, out, width=100)
    q.awaitTermination(600)
    assert q.exception() is None
    stored = incremental.BatchTables(spark, out)
    before = stored.result("session_words", incremental.SESSION_WORDS)
    assert before.count() < want.count()
    incremental.flush_sessions(spark, out, width=100)
    assert rows(stored.result("session_words", incremental.SESSION_WORDS)) == rows(want)
    assert stored.result("late", incremental.SESSION_EVENTS).count() == 0
    incremental.flush_sessions(spark, out, width=100)
    assert rows(stored.result("session_words", incremental.SESSION_WORDS)) == rows(want)
    assert want.select("file_num").distinct().count() >= 10


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = "capture_id string, kind string, t_ns long, value long, state boolean"
    first = [("a", "control", 0, None, True), ("a", "word", 100, 1, None), ("a", "control", 100, None, True)]
    second = [("a", "word", 50, 9, None), ("a", "word", 150, 2, None), ("a", "control", 160, None, False)]
    for part in (first, second):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(src)
        live = spark.readStream.schema(incremental.SESSION_EVENTS).parquet(src)
        q = incremental.stream_sessions(live, out, width=100)
        q.awaitTermination(600)
        assert q.exception() is None
    stored = incremental.BatchTables(spark, out)
    assert [(r.t_ns, r.value) for r in stored.result("late", incremental.SESSION_EVENTS).collect()] == [(50, 9)]
    incremental.flush_sessions(spark, out, width=100)
    got = stored.result("session_words", incremental.SESSION_WORDS)
    assert rows(got.select("t_ns", "file_num", "byte_index")) == [(100, 1, 0), (150, 1, 1)]
