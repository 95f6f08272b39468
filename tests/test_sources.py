import os
import zipfile

import pytest
from pyspark.sql import functions as F

from logicspark import SpiMode, StrobeMode
from logicspark.operators import parallel, registers, sessions, signal, spi
from logicspark.plans import jobs, progress
from logicspark.sources import capture, sinks, tables
from tests.conftest import SF, rows
from workload import fixtures as fx

SAMPLES = 2148
HEADER = "\n".join(
    ["[version]", "total probes = 3", "samplerate = 100 MHz", f"total samples = {SAMPLES}", "total blocks = 3",
     "probe0 = CLK", "probe2 = D0", "extra = 1"]
)


@pytest.fixture(scope="module")
def wanted(spark):
    """Three channels by three blocks, the last one short, as packed blocks."""
    levels = fx.levels(spark, SF).filter("channel < 3")
    longer = levels.unionByName(levels.withColumn("position", F.col("position") + 1000)).unionByName(
        levels.withColumn("position", F.col("position") + 2000)
    ).filter(F.col("position") < SAMPLES)
    return signal.pack_levels(longer.withColumn("capture_id", F.lit("one")), 1024, 10).cache()


def write_archive(path, blocks, header=HEADER, skip=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if header is not None:
            z.writestr("header", header)
        for r in blocks:
            name = f"L-{r.channel}/{r.block_num}"
            if name not in skip:
                z.writestr(name, bytes(r.data))


@pytest.fixture(scope="module")
def archive(tmp_path_factory, wanted):
    path = str(tmp_path_factory.mktemp("archive") / "one.zip")
    write_archive(path, wanted.collect())
    return path


def plain(df):
    return rows(df.select("capture_id", "channel", "block_num", F.hex("data"), "start_position", "num_samples", "timestamp_step"))


def test_header(spark, archive):
    h = capture.read_capture(spark, archive).header.collect()[0]
    assert (h.capture_id, h.total_probes, h.samplerate, h.samplerate_hz) == ("one", 3, "100 MHz", 1e8)
    assert (h.total_samples, h.total_blocks, h.samples_per_block) == (SAMPLES, 3, 1024)
    assert h.probe_names == ["CLK", "Probe1", "D0"]
    assert h.sample_period == 1e-8
    stats = capture.capture_stats(capture.read_capture(spark, archive).header).collect()[0]
    assert stats.duration_s == pytest.approx(SAMPLES * 1e-8)


@pytest.mark.parametrize("slices", [1, 2, 3, 7])
def test_blocks(spark, archive, wanted, slices):
    got = capture.read_capture(spark, archive, bytes_per_partition=-(-os.path.getsize(archive) // slices)).blocks
    assert plain(got) == plain(wanted)
    ends = signal.last_bits(wanted.drop("first", "last"))
    assert rows(got.select(*signal.LINE, "block_num", "last")) == rows(ends)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_file_names_stay_apart(spark, tmp_path, wanted):
    blocks = wanted.collect()
    for folder, rate in (("x", "100 MHz"), ("y", "50 MHz")):
        (tmp_path / folder).mkdir()
        write_archive(str(tmp_path / folder / "run1.zip"), blocks, HEADER.replace("100 MHz", rate))
    opened = capture.read_capture(spark, str(tmp_path / "*" / "run1.zip"))
    steps = opened.blocks.groupBy("capture_id").agg(F.count("*").alias("n"), F.max("timestamp_step").alias("step"))
    assert rows(steps) == [("x/run1", 9, 10), ("y/run1", 9, 20)]
    assert rows(opened.header.select("capture_id")) == [("x/run1",), ("y/run1",)]


def test_bounded_and_projected(spark, archive, wanted):
    got = capture.read_capture(spark, archive, channels=[0, 2], max_samples=1500).blocks
    want = signal.bound_blocks(wanted.filter("channel <> 1"), 1500)
    assert rows(signal.unpack_bits(got)) == rows(signal.unpack_bits(want))
    assert got.count() == 4
    for bad in ([3], list(range(17))):
        with pytest.raises(Exception, match="channels"):
            capture.read_capture(spark, archive, channels=bad).blocks.collect()


def test_channel_filter_prunes_partitions(spark, archive):
    capture.register(spark)
    third = -(-os.path.getsize(archive) // 3)
    reader = spark.read.format("logic_capture").option("bytes_per_partition", third)
    assert reader.load(archive).rdd.getNumPartitions() == 3
    for cond, n in (("channel = 1", 3), ("channel in (0, 1)", 6)):
        kept = reader.option("prune", "true").load(archive).filter(cond)
        assert kept.rdd.getNumPartitions() == n
        assert kept.count() == n


def test_one_table_filtered_in_several_ways(spark, archive):
    """Every branch sees its own channel, whatever the scan pushes down."""
    capture.register(spark)
    raw = spark.read.format("logic_capture").load(archive)
    parts = [raw.filter(f"channel = {c}").groupBy("channel").count() for c in (2, 0, 1)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(both) == [(0, 3), (1, 3), (2, 3)]


def test_missing_block_ends_the_channel(spark, tmp_path, wanted):
    path = str(tmp_path / "gap.zip")
    write_archive(path, wanted.collect(), skip=("L-1/1",))
    got = capture.read_capture(spark, path, bytes_per_partition=500).blocks
    assert rows(got.select("channel", "block_num")) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert [r.block_num for r in capture.read_aligned(spark, path, [0, 1]).collect()] == [0]


def test_bad_headers(spark, tmp_path, wanted):
    cases = {
        "nohead": (None, "cannot find header"),
        "nofield": (HEADER.replace("total samples", "other"), "missing field total samples"),
        "badnum": (HEADER.replace("total blocks = 3", "total blocks = x"), "missing field total blocks"),
        "norate": (HEADER.replace("samplerate", "rate"), "missing field samplerate"),
        "badrate": (HEADER.replace("100 MHz", "100 mhz"), "invalid sample rate"),
    }
    blocks = wanted.collect()
    for name, (header, message) in cases.items():
        path = str(tmp_path / f"{name}.zip")
        write_archive(path, blocks, header)
        with pytest.raises(Exception, match=message):
            capture.read_capture(spark, path).header.collect()
    path = str(tmp_path / "noblock.zip")
    write_archive(path, blocks, skip=("L-0/0",))
    with pytest.raises(Exception, match="could not read first block"):
        capture.read_capture(spark, path).header.collect()


def test_aligned_scan(spark, archive, wanted):
    got = capture.read_aligned(spark, archive, [0, 2], bytes_per_partition=-(-os.path.getsize(archive) // 2))
    want = parallel.align_blocks(wanted, [0, 2])
    cols = ["capture_id", "block_num", F.hex(F.element_at("channels", F.lit(0))), F.hex(F.element_at("channels", F.lit(2))),
            "start_position", "num_samples"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    words = parallel.decode_aligned(got, strobe=0, data=[2], mode=StrobeMode.ANY)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    assert rows(words.select("position", "value")) == rows(
        parallel.parallel_words(wanted, strobe=0, data=[2], mode=StrobeMode.ANY).select("position", "value")
    )


def test_save_and_prune(spark, tmp_path, wanted):
    path = str(tmp_path / "blocks")
    capture.save_blocks(wanted, path)
    back = capture.load_blocks(spark, path)
    assert plain(back) == plain(wanted)
    plan = signal.project_channels(back, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan or "PartitionFilters: [(channel" in plan


def test_spi_job_from_archive(spark, archive, wanted):
    options = dict(cs=2, clk=0, mosi=1, miso=0, bits_per_word=1, mode=SpiMode.MODE1)
    runs = signal.edge_runs(wanted)
    line = {c: runs.filter(F.col("channel") == c) for c in range(3)}
    want = rows(spi.spi_words(line[0], line[2], line[1], line[0], bits_per_word=1, mode=SpiMode.MODE1))
    assert len(want) > 10
    assert rows(jobs.spi_decode(capture.read_capture(spark, archive).blocks, width=777, **options)) == want
    opened = jobs.spi_decode(lambda cs: capture.read_capture(spark, archive, channels=cs).blocks, **options)
    assert rows(opened) == want


LOG = "Id,Time[ns],1:SPI: MOSI data\n1,10.50,600081\n2,20,00C0FF\nshort,3\n3,30.00, 600000 \n"


def test_command_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LOG)
    (tmp_path / "a_annotated.csv").write_text(LOG)
    (tmp_path / "b_spi.csv").write_text(LOG)
    got = tables.read_commands(spark, str(tmp_path / "a.csv"))
    assert rows(got.drop("seq")) == [("a", 10.5, 0x600081), ("a", 20.0, 0x00C0FF), ("a", 30.0, 0x600000)]
    assert [r.time_ns for r in got.orderBy("seq").collect()] == [10.5, 20.0, 30.0]
    folder = tables.read_log_folder(spark, str(tmp_path))
    assert {r.log_id for r in folder.collect()} == {"a"}
    (tmp_path / "bad.csv").write_text("Id,Time[ns],x\n1,10,zz\n")
    with pytest.raises(Exception, match="bad value in command log"):
        tables.read_commands(spark, str(tmp_path / "bad.csv")).collect()
    sinks.write_annotated_csv(folder, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out" / "file=a_annotated"), header=True)
    got = {r["Id"]: r["Description"] for r in back.collect()}
    assert got == {"1": "START pixel stream from CCD", "2": "WRITE CCD_CLK_PHASE_00 config=0xC0FF", "short": None, "3": "STOP pixel stream"}


def test_log_order_and_columns(spark, tmp_path):
    """File order counts, whatever the ids say, also over several splits; further columns and headings stay."""
    (tmp_path / "c0").mkdir()
    (tmp_path / "c1").mkdir()
    head = "Nr,Zeit [ns],MOSI,note\n"
    (tmp_path / "c0" / "log.csv").write_text(head + ",10,010005,first\nx,20,010006,\n7,30,600081,\"a, b\"\n")
    many = "".join(f"{9 - k % 10},{k},{k % 128:02X}{k % 65536:04X},n{k}\n" for k in range(5000))
    (tmp_path / "c1" / "log.csv").write_text(head + many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tables.read_commands(spark, str(tmp_path / "*" / "log.csv"))
        assert {r.log_id for r in got.select("log_id").distinct().collect()} == {"c0/log", "c1/log"}
        in_order = [r.time_ns for r in got.filter("log_id = 'c1/log'").orderBy("seq").collect()]
        assert in_order == [float(k) for k in range(5000)]
        state = registers.register_state(registers.register_writes(got.filter("log_id = 'c0/log'")))
        assert [(r.register, r.value) for r in state.collect()] == [(1, 6)]
        sinks.write_annotated_csv(tables.read_log_rows(spark, str(tmp_path / "*" / "log.csv")), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["Nr", "Zeit [ns]", "MOSI", "note", "Description", "file"]
    notes = {r["Zeit [ns]"]: r.note for r in back.filter("file = 'c0/log_annotated'").collect()}
    assert notes == {"10": "first", "20": None, "30": "a, b"} and back.count() == 5003


def test_first_words_of_each_capture(spark):
    words = spark.range(60).select(
        (F.col("id") % 3).cast("string").alias("capture_id"), F.col("id").alias("mosi"), F.lit(0).cast("bigint").alias("miso"),
        (F.col("id") * 10).alias("t_ns"), F.lit(0.0).alias("timestamp_us"),
    )
    each = sinks.first_words_each(words, 4).groupBy("capture_id").agg(F.count("*").alias("n"), F.max("t_ns").alias("last"))
    assert rows(each) == [("0", 4, 90), ("1", 4, 100), ("2", 4, 110)]
    assert sinks.first_words_each(words, 0).count() == 60


def test_line_records(spark, tmp_path):
    head = "a,b,c,d,e,f,g,h\n"
    (tmp_path / "capture_0001_tgck.csv").write_text(head + "1,10, 5 ,1,1,1,1,1\nx,y,z\n2,bad,77,1,1,1,1,1\n")
    (tmp_path / "capture_0002_tgck.csv").write_text(head + "1,10,5,1,1,1,1,1\n")
    got = tables.read_line_records(spark, str(tmp_path))
    assert rows(got.drop("seq")) == [("capture_0001", 10, 5), ("capture_0001", None, 77)]
    offsets = sessions.line_offsets(got, ["image_id"], start_offset=-9)
    assert rows(offsets) == [("capture_0001", 0, 0)]
    assert [r.width for r in sessions.line_width(got, ["image_id"]).collect()] == [72]
    d = spark.createDataFrame([("/x/capture_0001.bin",), ("/x.y/cap",)], "p string")
    assert [r[0] for r in d.select(tables.companion_path(F.col("p"))).collect()] == ["/x/capture_0001_tgck.csv", "/x.y/cap_tgck.csv"]


@pytest.mark.parametrize("parts", [False, True])
def test_bodies(spark, tmp_path, parts):
    words = spark.range(1000).select(
        F.lit("c").alias("capture_id"), (F.col("id") % 3 + 1).alias("file_num"),
        F.expr("id div 3").alias("byte_index"), (F.col("id") * 7).alias("value"),
    )
    out = str(tmp_path / "bodies")
    sinks.write_bodies(words, out, chunk_bytes=100, parts=parts)
    want = {n: bytes((i * 7) & 255 for i in range(1000) if i % 3 + 1 == n) for n in (1, 2, 3)}
    folder = os.path.join(out, "c")
    if not parts:
        for n, body in want.items():
            with open(os.path.join(folder, f"capture_{n:04d}.bin"), "rb") as f:
                assert f.read() == body
    chunks = tables.read_body_chunks(spark, folder, 100)
    read = {}
    for r in tables.body_bytes(chunks, 100).orderBy("image_id", "byte_index").collect():
        read.setdefault(r.image_id, bytearray()).append(r.byte)
    assert {k: bytes(v) for k, v in read.items()} == {f"capture_{n:04d}": b for n, b in want.items()}
    for size in (7, 64, 5000):
        again = {}
        for r in tables.read_body_chunks(spark, out + "/*/*", size).orderBy("image_id", "chunk_no").collect():
            assert r.chunk_no * size == len(again.setdefault(r.image_id, bytearray()))
            again[r.image_id] += r.data
        assert {k: bytes(v) for k, v in again.items()} == {f"c/capture_{n:04d}": b for n, b in want.items()}
    sinks.write_bodies(words.filter("byte_index < 5"), out, chunk_bytes=100, parts=parts)
    short = tables.read_body_chunks(spark, out + "/*/*", 1000).collect()
    assert {(r.image_id, bytes(r.data)) for r in short} == {(f"c/capture_{n:04d}", b[:5]) for n, b in want.items()}
    assert sorted(os.listdir(out)) == ["c"]


def test_csv_sinks(spark, tmp_path):
    words = spark.createDataFrame([("c", 0xAB, 0, 50, 0.05), ("c", 0x12, 0, 20, 0.02)], "capture_id string, mosi long, miso long, t_ns long, timestamp_us double")
    sinks.write_spi_csv(words, str(tmp_path / "w"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "w" / "capture_id=c").glob("part-*.csv")))
    assert text.splitlines() == ["Id,Time[ns],1:SPI: MOSI data", "1,20.00,000012", "2,50.00,0000AB"]
    assert sinks.spi_csv_rows(words, 1).count() == 1
    shown = sinks.spi_show_rows(words, 1).collect()
    assert shown[0].text == "MOSI=0x000012 MISO=0x000000 at t=0.000000s (pos=20)"
    snap = spark.createDataFrame([("log", 2, 5e8, 9, 10), ("log", 2, 5e8, 1, 65535)], "log_id string, enable_num long, time_ns double, register int, value int")
    sinks.write_register_csv(snap, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r" / "file=log_spi").glob("part-*"))
    assert text.splitlines() == [
        "# Register snapshot before enable #2 at t=0.500000s (2 registers)", "register,value_hex,value_dec", "0x01,0xFFFF,65535", "0x09,0x000A,10",
    ]
    index = spark.createDataFrame([("c", 1, "capture_0001.bin", 3, 0, 1.0, 2.5, 1.5, 10, 20)], "capture_id string, file_num long, filename string, bytes long, width long, start_time_us double, end_time_us double, duration_us double, start_pos long, end_pos long")
    sinks.write_capture_index(index, str(tmp_path / "i"))
    text = "".join(p.read_text() for p in (tmp_path / "i" / "capture_id=c").glob("part-*"))
    assert text.splitlines() == [
        "file_num,filename,bytes,width,start_time_us,end_time_us,duration_us,start_pos,end_pos",
        "1,capture_0001.bin,3,0,1.000000,2.500000,1.500000,10,20",
    ]


def test_line_record_sink(spark, tmp_path):
    names = tables.LINE_RECORD_COLUMNS
    schema = "capture_id string, file_num long, " + ", ".join(f"{n} long" for n in names)
    data = [("c", 1, 9, 200, 10, 210, 9, 201, 10, 211), ("c", 1, 3, 100, 4, 110, 3, 101, 4, 111), ("c", 2, 0, 5, 0, 0, 0, 6, 0, 0)]
    sinks.write_line_records(spark.createDataFrame(data, schema), str(tmp_path / "t"))
    folder = tmp_path / "t" / "capture_id=c" / "file_num=1"
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text.splitlines()[0] == ",".join(names)
    assert [x for x in text.splitlines() if x[0].isdigit()] == ["3,100,4,110,3,101,4,111", "9,200,10,210,9,201,10,211"]


def test_progress(spark, archive):
    runs = signal.edge_runs(capture.read_capture(spark, archive).blocks)
    watched, seen = progress.observe_progress(runs, "runs")
    n = watched.count()
    assert seen.get["rows"] == n
    assert seen.get["first_ns"] == 0


def test_many_small_bodies_share_a_listing_and_a_task(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyarrow import fs

    out, bodies = str(tmp_path / "out"), {n: bytes([n, n + 1, n + 2]) for n in range(1, 61)}
    batch = pa.RecordBatch.from_pylist(
        [{"capture_id": "c", "file_num": n, "chunk_no": 0, "data": data} for n, data in bodies.items()]
    )
    listed, selector = [], fs.FileSelector
    monkeypatch.setattr(fs, "FileSelector", lambda *a, **b: listed.append(a) or selector(*a, **b))
    for _ in range(2):  # the second time the bodies are replaced
        writer = sinks.BodyWriter({"path": out}, False)
        writer.commit([writer.write(iter([batch]))])
    assert len(listed) == 2
    assert len(tables._BodyReader({"path": out + "/*/*.bin", "chunk_bytes": "2"}).partitions()) == 1
    found = tables.read_body_chunks(spark, out + "/*/*.bin", 2).collect()
    want = {(f"c/capture_{n:04d}", k): data[2 * k : 2 * k + 2] for n, data in bodies.items() for k in range(2)}
    assert {(r["image_id"], r["chunk_no"]): bytes(r["data"]) for r in found} == want
    assert len(found) == len(want)
