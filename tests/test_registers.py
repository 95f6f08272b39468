import random

import pytest
from pyspark.sql import functions as F

from logicspark.operators import registers
from logicspark.plans import jobs
from tests.conftest import rows

ON, OFF = 0x600081, 0x600000


def make(spark, logs):
    data = [(k, i, float(t), m) for k, log in logs.items() for i, (t, m) in enumerate(log)]
    return spark.createDataFrame(data, "log_id string, seq long, time_ns double, mosi long")


def writes_before(log, end):
    """Last write to each register among the first ``end`` commands."""
    return dict((m >> 16 & 127, m & 0xFFFF) for _, m in log[:end] if m not in (ON, OFF) and m < 1 << 23)


def looked_up(log):
    """Registers at the end, registers before each enable, and lengths of neighbouring enable and disable pairs."""
    starts = [i for i, (_, m) in enumerate(log) if m == ON]
    snapshots = [(n, log[i][0], writes_before(log, i)) for n, i in enumerate(starts, 1)]
    switches = [(t, m, sum(x == ON for _, x in log[: i + 1])) for i, (t, m) in enumerate(log) if m in (ON, OFF)]
    pairs = zip(switches, switches[1:])
    lengths = [(n, float(t1 - t0)) for (t0, a, n), (t1, b, _) in pairs if (a, b) == (ON, OFF)]
    return writes_before(log, len(log)), snapshots, lengths


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(2)
    out = {}
    for i in range(20):
        log, t = [], 0
        for _ in range(80):
            t += rng.randrange(1, 4)
            log.append((t, rng.choice([ON, OFF, rng.randrange(4) << 16 | rng.randrange(65536), 1 << 23 | rng.randrange(1 << 20)])))
        out[f"l{i}"] = log
    return out


@pytest.mark.parametrize("width", [1, 9, 1000])
def test_state_machine(spark, logs, width):
    c = make(spark, logs)
    writes, enabled = registers.register_writes(c), registers.enables(c, width=width)
    snapshots = registers.register_snapshots(writes, enabled, width)
    durations = registers.capture_durations(c, width=width)
    folded = {k: looked_up(v) for k, v in logs.items()}
    assert rows(registers.register_state(writes)) == sorted(
        ((k, r, v) for k, (regs, _, _) in folded.items() for r, v in regs.items()), key=repr
    )
    assert rows(snapshots) == sorted(
        ((k, n, float(t), r, v) for k, (_, s, _) in folded.items() for n, t, regs in s for r, v in regs.items()), key=repr
    )
    assert rows(registers.snapshot_sizes(writes, enabled, width)) == sorted(
        ((k, n, float(t), len(regs)) for k, (_, s, _) in folded.items() for n, t, regs in s), key=repr
    )
    assert rows(durations) == sorted(((k, *d) for k, (_, _, ds) in folded.items() for d in ds), key=repr)
    best = {k: max(ds, key=lambda d: (d[1], d[0])) for k, (_, _, ds) in folded.items() if ds}
    assert rows(registers.longest_capture(durations)) == sorted(((k, *b) for k, b in best.items()), key=repr)
    picked = registers.snapshot_pick(snapshots, durations)
    assert {(r.log_id, r.enable_num) for r in picked.collect()} <= {(k, b[0]) for k, b in best.items()}


def test_ties_take_the_last_and_missing_fails(spark):
    log = {"l": [(0, 5 << 16 | 7), (1, ON), (3, OFF), (4, 6 << 16 | 8), (5, ON), (7, OFF)]}
    c = make(spark, log)
    durations = registers.capture_durations(c)
    assert rows(registers.longest_capture(durations)) == [("l", 2, 2.0)]
    dump = jobs.register_dump(c)
    assert [tuple(r)[1:] for r in dump.collect()] == [("0x05", "0x0007", 7), ("0x06", "0x0008", 8)]
    assert [tuple(r)[1:] for r in jobs.register_dump(c, capture_num=1).collect()] == [("0x05", "0x0007", 7)]
    with pytest.raises(Exception, match="Capture #9 not found"):
        jobs.register_dump(c, capture_num=9).collect()
    with pytest.raises(Exception, match="No enable/disable pairs found"):
        jobs.register_dump(make(spark, {"l": [(0, ON)]})).collect()
    with pytest.raises(Exception, match="Capture #9 not found"):
        registers.snapshot_pick(registers.enables(c), capture_num=9).collect()


def test_long_ranges_go_in_spans(spark, monkeypatch):
    monkeypatch.setattr(registers, "SPAN", 3)
    log = [(0, 5 << 16 | 7)] + [(k, ON) for k in range(1, 12)] + [(12, 5 << 16 | 8), (13, 6 << 16 | 1), (14, 5 << 16 | 9), (15, ON)]
    c = make(spark, {"l": log})
    got = registers.register_snapshots(registers.register_writes(c), registers.enables(c, width=2), width=2)
    want = [(k, 5, 7) for k in range(1, 12)] + [(12, 5, 9), (12, 6, 1)]
    assert rows(got.select("enable_num", "register", "value")) == sorted(want, key=repr)


def test_snapshot_map(spark):
    c = make(spark, {"l": [(0, 9 << 16 | 1), (1, 2 << 16 | 2), (2, ON)]})
    d = registers.register_snapshots(registers.register_writes(c), registers.enables(c))
    got = registers.snapshot_maps(d).select(F.map_keys("registers"), F.map_values("registers")).collect()
    assert [tuple(r) for r in got] == [([2, 9], [2, 1])]


def test_descriptions(spark):
    cases = {
        0x600081: "START pixel stream from CCD",
        0x6A0000: "Scan line reset/prepare",
        0x78AB12: "write RED gain=0xAB offset=0x12",
        0xFA0001: "read BLUE gain=0x00 offset=0x01",
        0x62020E: "WRITE RGB_SEQUENCER setup",
        0xE21234: "READ RGB_SEQUENCER cmd=0x1234",
        0x00C0FF: "WRITE CCD_CLK_PHASE_00 config=0xC0FF",
        0x16FFFF: "WRITE CCD_CLK_TRANS_A verify=0xFFFF",
        0x96FFFF: "READ CCD_CLK_TRANS_A verify=0xFFFF",
        0x3F0000: "WRITE CHANNEL_CFG_3F = 0x0000 (clear)",
        0xBF0000: "READ CHANNEL_CFG_3F = 0x0000",
        0xB0C000: "READ CDS_GAIN_30 = 0xC000",
        0x400001: "WRITE REG_40 = 0x0001",
        0x450001: "WRITE EXT_CFG_45 = 0x0001",
        0x520010: "WRITE LED_EXPOSURE = 0x0010",
    }
    d = spark.createDataFrame([(m,) for m in cases], "mosi long")
    got = {r.mosi: r.description for r in registers.describe_commands(d).collect()}
    assert got == cases
    text = spark.createDataFrame([("600081",), ("0x6A0000",), ("xyz",), (None,), (" 600000 ",)], "f string")
    got = {r.f: r.description for r in registers.describe_text(text, "f").collect()}
    assert got == {
        "600081": "START pixel stream from CCD", "0x6A0000": "Scan line reset/prepare", "xyz": "???", None: "",
        " 600000 ": "STOP pixel stream",
    }
