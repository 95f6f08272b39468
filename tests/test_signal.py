import random

import pytest
from pyspark.sql import functions as F

from logicspark.functions import scalar
from logicspark.operators import signal
from logicspark.schemas import BLOCKS, ContractError, require_columns
from tests.conftest import rows


@pytest.fixture(scope="module")
def bits():
    rng = random.Random(9)
    return {(c, ch): [rng.random() < 0.3 for _ in range(100)] for c in ("x", "y") for ch in range(3)}


@pytest.fixture(scope="module")
def blocks(spark, bits):
    data = [(c, ch, i, v) for (c, ch), line in bits.items() for i, v in enumerate(line)]
    levels = spark.createDataFrame(data, "capture_id string, channel int, position long, value boolean")
    return signal.pack_levels(levels, 32, 10)


def test_pack_unpack(blocks, bits):
    got = signal.unpack_bits(blocks)
    assert rows(got) == sorted(((c, ch, i, v) for (c, ch), line in bits.items() for i, v in enumerate(line)), key=repr)
    assert {r.num_samples for r in blocks.collect()} == {32, 4}


def expected_runs(bits):
    out = []
    for (c, ch), line in bits.items():
        for i, v in enumerate(line):
            if i == 0 or line[i - 1] != v:
                out.append((c, ch, v, i * 10))
    return sorted(out, key=repr)


def test_edge_runs_stitch_blocks(blocks, bits):
    assert rows(signal.edge_runs(blocks)) == expected_runs(bits)
    assert rows(signal.runs_from_levels(signal.unpack_bits(blocks), 10, width=70)) == expected_runs(bits)


def test_constant_line_is_one_run(spark):
    data = [("c", 0, i, True) for i in range(64)]
    levels = spark.createDataFrame(data, "capture_id string, channel int, position long, value boolean")
    assert rows(signal.edge_runs(signal.pack_levels(levels, 8, 5))) == [("c", 0, True, 0)]


def test_bounds_and_edges(blocks, bits):
    runs = signal.edge_runs(blocks)
    want, want_edges = [], []
    for (c, ch), line in bits.items():
        mine = [(v, t) for cc, cch, v, t in expected_runs({(c, ch): line})]
        mine.sort(key=lambda x: x[1])
        for i, (v, t) in enumerate(mine):
            want.append((c, ch, t, mine[i + 1][1] if i + 1 < len(mine) else None))
            before = mine[i - 1][0] if i else False
            want_edges.append((c, ch, t, v and not before, before and not v))
    got = signal.run_bounds(runs, width=100)
    assert rows(got.select("capture_id", "channel", "start_time", "next_start")) == sorted(want, key=repr)
    got = signal.edge_detect(runs, width=100)
    assert rows(got.select("capture_id", "channel", "start_time", "rising", "falling")) == sorted(want_edges, key=repr)


def test_bounded_scan(blocks):
    capped = signal.bound_blocks(blocks, 40)
    per_channel = capped.groupBy("capture_id", "channel").agg(F.sum("num_samples").alias("n"), F.count("*").alias("b"))
    assert {(r.n, r.b) for r in per_channel.collect()} == {(40, 2)}
    assert signal.bound_blocks(blocks, 32).count() == 6


def test_channel_projection_checks(blocks):
    assert signal.project_channels(blocks, [1]).select("channel").distinct().count() == 1
    for wanted, probes in ([], 3), (list(range(17)), 20), ([3], 3), ([-1], 3):
        with pytest.raises(ValueError):
            signal.project_channels(blocks, wanted, probes)


def test_bit_lookup(spark):
    d = spark.createDataFrame([(bytes([0xAA, 0xCC]), i) for i in (0, 1, 2, 3, 7, 8, 9, 10, 11, 16, 100)], "data binary, i long")
    got = {r.i: r.bit for r in d.select("i", scalar.bit_of(F.col("data"), F.col("i")).alias("bit")).collect()}
    assert {i for i, b in got.items() if b} == {1, 3, 7, 10, 11}


def test_probe_status(spark, blocks, bits):
    header = spark.createDataFrame(
        [("x", 3, 100, 4, 32), ("y", 4, 200, 3, 32)],
        "capture_id string, total_probes int, total_samples long, total_blocks long, samples_per_block long",
    )
    keys = [("x", 1, 50), ("x", 3, 0), ("x", 0, 100), ("y", 0, 96), ("y", 3, 5), ("z", 0, 0), ("y", 2, 95), ("x", 0, -1)]
    got = rows(signal.probe_bits(blocks, header, spark.createDataFrame(keys, "capture_id string, channel int, position long")))
    assert got == sorted(
        [
            ("x", 1, 50, "ok", int(bits["x", 1][50])), ("x", 3, 0, "invalid_probe", None),
            ("x", 0, 100, "out_of_bounds", None), ("y", 0, 96, "out_of_bounds", None),
            ("y", 3, 5, "invalid_block", None), ("z", 0, 0, "unknown_capture", None),
            ("y", 2, 95, "ok", int(bits["y", 2][95])), ("x", 0, -1, "out_of_bounds", None),
        ],
        key=repr,
    )


def test_sample_rates(spark):
    cases = {
        "50 MHz": 5e7, "1 GHz": 1e9, "100 kHz": 1e5, "100 KHz": 1e5, "1000 Hz": 1e3, "2.5 MHz": 2.5e6,
        "  5   MHz x": 5e6, "invalid": None, "50": None, "MHz 50": None, "50 mhz": None, "": None, "abc MHz": None,
        "50f MHz": None, "1e3 Hz": 1e3,
    }
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.hz for r in d.select("s", scalar.parse_sample_rate(F.col("s")).alias("hz")).collect()}
    assert got == cases


def test_timestamp_step(spark):
    d = spark.createDataFrame([(3e8,), (1e9,)], "hz double")
    assert [r[0] for r in d.select(scalar.timestamp_step(F.col("hz"))).collect()] == [3, 1]
    with pytest.raises(Exception, match="sample rate too high"):
        spark.createDataFrame([(2e9,)], "hz double").select(scalar.timestamp_step(F.col("hz"))).collect()


def test_contract_errors(spark):
    with pytest.raises(ContractError, match="missing column data"):
        require_columns(spark.range(1), BLOCKS, "x")
    with pytest.raises(ContractError, match="is string"):
        require_columns(spark.range(1).select(F.lit("a").alias("channel")), BLOCKS)


def test_hex(spark):
    cases = {"0x600081": 0x600081, "0X1f": 31, "ff": 255, "zz": None, "": None, "0x": None, "FFFFFFFFFFFFFFFF": -1, "0" * 20 + "1": 1}
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in d.select("s", scalar.parse_hex(F.col("s")).alias("n")).collect()} == cases
