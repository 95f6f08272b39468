import random

import pytest
from pyspark.sql import functions as F

from logicspark import CsPolarity, StrobeMode
from logicspark.operators import control, parallel, sessions, signal
from logicspark.plans import jobs
from tests.conftest import rows
from tests.traces import line_frame, random_runs

STEP = 10


@pytest.fixture(scope="module")
def bits():
    rng = random.Random(11)
    return {ch: [rng.random() < 0.4 for _ in range(200)] for ch in range(5)}


@pytest.fixture(scope="module")
def blocks(spark, bits):
    data = [("c", ch, i, v) for ch, line in bits.items() for i, v in enumerate(line)]
    levels = spark.createDataFrame(data, "capture_id string, channel int, position long, value boolean")
    return signal.pack_levels(levels, 64, STEP)


def triggers(line, mode):
    out, before = [], False
    for i, v in enumerate(line):
        hit = {
            StrobeMode.RISING: v and not before, StrobeMode.FALLING: before and not v,
            StrobeMode.ANY: v != before, StrobeMode.HIGH: v, StrobeMode.LOW: not v,
        }[mode]
        if hit:
            out.append(i)
        before = v
    return out


@pytest.mark.parametrize("mode", list(StrobeMode))
def test_triggers_and_words(spark, blocks, bits, mode):
    polarity = CsPolarity.ACTIVE_LOW if mode.is_level else CsPolarity.ACTIVE_HIGH
    idle = polarity is CsPolarity.ACTIVE_LOW
    at = triggers(bits[0], mode)
    assert [r[0] for r in rows(parallel.strobe_triggers(blocks, 0, mode).select("position"))] == sorted(at, key=repr) or {
        r.position for r in parallel.strobe_triggers(blocks, 0, mode).collect()
    } == set(at)
    gate = [(False, 0), (True, 330), (False, 900), (True, 1200)]
    state = spark.createDataFrame([("c", s, t) for s, t in gate], "capture_id string, state boolean, t_ns long")
    got = parallel.parallel_words(
        blocks, strobe=0, data=[1, 2, 3], cs=4, mode=mode, polarity=polarity, control=state, width=70
    )

    def enabled(t):
        return [s for s, g in gate if g <= t][-1]

    want = [
        (i, sum(bits[c][i] << k for k, c in enumerate((1, 2, 3))))
        for i in at
        if bits[4][i] == idle and enabled(i * STEP)
    ]
    assert rows(got.select("position", "value")) == sorted(want, key=repr)
    assert {r.timestamp_us for r in got.collect()} == {i * STEP / 1000 for i, _ in want}


def test_sixty_four_lines(spark):
    data = [("c", 0, 0, True)] + [("c", ch, 0, ch in (1, 64)) for ch in range(1, 65)]
    levels = spark.createDataFrame(data, "capture_id string, channel int, position long, value boolean")
    b = signal.pack_levels(levels, 8, STEP)
    got = parallel.parallel_words(b, strobe=0, data=list(range(1, 65)), mode=StrobeMode.HIGH).collect()
    assert [r.value for r in got] == [1 - (1 << 63)]


def test_missing_channel_fails(blocks):
    cut = blocks.filter("not (channel = 2 and block_num = 1)")
    with pytest.raises(Exception, match="misaligned or missing channel"):
        parallel.parallel_words(cut, strobe=0, data=[1, 2], mode=StrobeMode.ANY).collect()
    for n in ([], list(range(65))):
        with pytest.raises(ValueError):
            parallel.parallel_words(blocks, strobe=0, data=n)


def test_control_state_edge_cases(spark):
    on, off = control.ENABLE_COMMAND, control.DISABLE_COMMAND
    data = [
        ("twice", 10, on), ("twice", 20, on), ("twice", 30, off),
        ("off_first", 5, off), ("off_first", 9, on), ("other", 7, 0x123456),
    ]
    c = spark.createDataFrame(data, "capture_id string, t_ns long, mosi long")
    assert rows(control.control_state(c, width=4)) == sorted(
        [
            ("twice", False, 0), ("twice", True, 10), ("twice", False, 30),
            ("off_first", False, 0), ("off_first", True, 9), ("other", False, 0),
        ],
        key=repr,
    )
    assert [r.report for r in control.command_monitor(c).orderBy("t_ns").limit(1).collect()] == [
        "SPI Command: 0x600000 at t=0.000000s"
    ]


def sequential_sessions(words, states, edges):
    """Word by word: file numbers, byte indexes and line records of one capture."""
    out, recs, file_num, n, open_ = [], {}, 0, 0, False
    events = sorted(
        [(t, 0, "c", s) for s, t in states] + [(t, 1, "e", v) for t, v in edges] + [(t, 2, "w", v) for v, t in words]
    )
    on, waiting, current = False, [], None
    for t, _, kind, x in events:
        if kind == "c":
            if x != on:
                on = x
                if not on:
                    open_, waiting, current = False, [], None
        elif kind == "e":
            waiting.append((t, x))
        elif on:
            if not open_:
                file_num, n, open_ = file_num + 1, 0, True
                waiting = []
                recs[file_num] = []
            for et, rising in waiting:
                if rising:
                    current = [n, et, 0, 0, n, t, 0, 0]
                    recs[file_num].append(current)
                elif current is not None:
                    current[2], current[3], current[6], current[7] = n, et, n, t
                    current = None
            waiting = []
            out.append((file_num, n, x, t))
            n += 1
    return out, recs


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_sessions_and_records_match_sequential(spark, width):
    rng = random.Random(width)
    words, states, edges = {}, {}, {}
    for i in range(25):
        c = f"c{i}"
        words[c] = [(rng.randrange(256), t) for t in sorted(rng.sample(range(400), 60))]
        times = sorted(rng.sample(range(1, 400), 7))
        states[c] = [(False, 0)] + [(k % 2 == 0, t) for k, t in enumerate(times)]
        edges[c] = random_runs(rng, 60, 1, 9, first=0)
    w = spark.createDataFrame(
        [(c, v, t, t / 1000) for c, x in words.items() for v, t in x],
        "capture_id string, value long, t_ns long, timestamp_us double",
    )
    s = spark.createDataFrame(
        [(c, v, t) for c, x in states.items() for v, t in x], "capture_id string, state boolean, t_ns long"
    )
    got_words = jobs.stage(sessions.assign_sessions(w, s, width), "t")
    got_edges = jobs.stage(sessions.line_edge_to_word(line_frame(spark, edges), got_words, width), "t")
    got_records = sessions.line_records(got_edges, width)
    want_words, want_records = [], []
    for c in words:
        # only edges after the first and up to the last word of a session count
        o, r = sequential_sessions(words[c], states[c], [(t, v) for t, v in edges[c][1:]])
        want_words += [(c, *x) for x in o]
        want_records += [(c, f, *x) for f, recs in r.items() for x in recs]
    assert rows(got_words.select("capture_id", "file_num", "byte_index", "value", "t_ns")) == sorted(want_words, key=repr)
    assert rows(got_records) == sorted(want_records, key=repr)
    widths = {(r.capture_id, r.file_num): r.width for r in sessions.line_width(got_records, width=width).collect()}
    by_file = {}
    for c, f, *x in want_records:
        by_file.setdefault((c, f), []).append(x)
    want_widths = {}
    for k, recs in by_file.items():
        recs.sort(key=lambda x: x[1])
        diffs = sorted(max(b[2] - a[2], 0) for a, b in zip(recs, recs[1:]))
        if diffs:
            want_widths[k] = diffs[len(diffs) // 2]
    assert widths == want_widths
    index = sessions.capture_index(got_words, got_records, width)
    assert {(r.capture_id, r.file_num): r.width for r in index.collect()} == {
        (c, f): want_widths.get((c, f), 0) for c, f, *_ in want_words
    }


def test_hot_session_is_numbered_across_buckets(spark):
    """One session holds every word; its numbers still run through."""
    w = spark.range(5000).select(
        F.lit("c").alias("capture_id"), F.col("id").alias("value"), (F.col("id") * 3).alias("t_ns"),
        F.lit(0.0).alias("timestamp_us"),
    )
    s = spark.createDataFrame([("c", False, 0), ("c", True, 0)], "capture_id string, state boolean, t_ns long").filter("state")
    got = sessions.assign_sessions(w, s, width=100)
    assert got.filter("byte_index = value and file_num = 1").count() == 5000


def test_enable_at_the_time_of_the_initial_state(spark):
    commands = spark.createDataFrame([("c", 0, 0x600081), ("c", 20, 0x600000), ("c", 40, 0x600081)], "capture_id string, t_ns long, mosi long")
    state = control.control_state(commands)
    words = spark.createDataFrame(
        [("c", t, 7, t / 1000) for t in (0, 10, 20, 30, 40)], "capture_id string, t_ns long, value long, timestamp_us double"
    )
    for order in (F.col("state"), ~F.col("state")):
        dealt = state.coalesce(1).sortWithinPartitions("t_ns", order)
        assert rows(parallel.enable_gate(words, dealt).select("t_ns")) == [(0,), (10,), (40,)]
        found = sessions.assign_sessions(words, dealt).select("t_ns", "file_num", "enabled_at", "byte_index")
        assert rows(found) == [(0, 1, 0, 0), (10, 1, 0, 1), (40, 2, 40, 0)]
