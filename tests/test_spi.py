import random

import pytest

from logicspark import CsPolarity, SpiMode
from logicspark.operators import spi
from tests.conftest import rows
from tests.traces import line_frame, random_runs, read_serial


def make_traces(seed, count):
    rng = random.Random(seed)
    lines = {name: {} for name in ("cs", "clk", "mosi", "miso")}
    for i in range(count):
        c = f"c{i}"
        lines["cs"][c] = random_runs(rng, rng.randint(1, 9), 1, 60)
        lines["clk"][c] = random_runs(rng, rng.randint(1, 60), 1, 9)
        lines["mosi"][c] = random_runs(rng, rng.randint(1, 40), 1, 12)
        lines["miso"][c] = random_runs(rng, rng.randint(1, 40), 1, 12)
    return lines


@pytest.mark.parametrize(
    "mode,polarity,n,width,initial",
    [
        (SpiMode.MODE0, CsPolarity.ACTIVE_LOW, 3, 7, False),
        (SpiMode.MODE1, CsPolarity.ACTIVE_HIGH, 2, 1, False),
        (SpiMode.MODE2, CsPolarity.ACTIVE_LOW, 1, 64, True),
        (SpiMode.MODE3, CsPolarity.ACTIVE_HIGH, 4, 10_000, False),
        (SpiMode.MODE3, CsPolarity.ACTIVE_LOW, 2, 3, True),
    ],
)
def test_words_match_sequential_reading(spark, mode, polarity, n, width, initial):
    lines = make_traces(n * 100 + width, 60)
    frames = {k: line_frame(spark, v) for k, v in lines.items()}
    got = spi.spi_words(
        frames["clk"], frames["cs"], frames["mosi"], frames["miso"],
        bits_per_word=n, mode=mode, polarity=polarity, initial_clock=initial, width=width,
    ).select("capture_id", "window_id", "word_no", "mosi", "miso", "t_ns")
    want = [
        (c, *w)
        for c in lines["cs"]
        for w in read_serial(
            lines["cs"][c], lines["clk"][c], lines["mosi"][c], lines["miso"][c], n,
            mode.samples_on_rising, polarity is CsPolarity.ACTIVE_HIGH, initial,
        )
    ]
    assert rows(got) == sorted(want, key=repr)
    assert want


def one(spark, **lines):
    return {k: line_frame(spark, {"c": v}) for k, v in lines.items()}


def square(start, period, count):
    out = [(0, False)]
    for i in range(count):
        out += [(start + i * period, True), (start + i * period + period // 2, False)]
    return out


def decode(f, n, mode=SpiMode.MODE0, **kw):
    d = spi.spi_words(f["clk"], f["cs"], f.get("mosi"), f.get("miso"), bits_per_word=n, mode=mode, width=16, **kw)
    return rows(d.select("window_id", "word_no", "mosi", "miso", "t_ns"))


def test_unclosed_window_and_partial_word(spark):
    f = one(spark, cs=[(0, True), (10, False), (95, True), (200, False)], clk=square(20, 10, 30), mosi=[(0, True)])
    # eight edges in the closed window: two words of three bits, two bits dropped; nothing after 200
    assert decode(f, 3) == [(10, 0, 7, 0, 20), (10, 1, 7, 0, 50)]


def test_absent_lines_read_zero(spark):
    f = one(spark, cs=[(0, True), (10, False), (95, True)], clk=square(20, 10, 30))
    assert decode(f, 8) == [(10, 0, 0, 0, 20)]


def test_idle_high_clock_gives_an_extra_edge(spark):
    clk = [(0, True), (50, False), (60, True), (70, False), (80, True)]
    f = one(spark, cs=[(0, True), (10, False), (90, True)], clk=clk, mosi=[(0, True)])
    assert decode(f, 1, SpiMode.MODE3) == [(10, 0, 1, 0, 0), (10, 1, 1, 0, 60), (10, 2, 1, 0, 80)]
    assert decode(f, 1, SpiMode.MODE3, initial_clock=True) == [(10, 0, 1, 0, 60), (10, 1, 1, 0, 80)]


def test_arguments_are_checked(spark):
    f = one(spark, cs=[(0, True)], clk=[(0, True)])
    with pytest.raises(ValueError):
        spi.spi_words(f["clk"], f["cs"], polarity=CsPolarity.DISABLED)
    for n in (0, 64):
        with pytest.raises(ValueError):
            spi.spi_words(f["clk"], f["cs"], bits_per_word=n)


def test_window_clock_matches_overlap_rule(spark):
    lines = make_traces(5, 40)
    got = spi.cs_window_clock(line_frame(spark, lines["clk"]), line_frame(spark, lines["cs"]), width=5)
    want = []
    for c, cs in lines["cs"].items():
        clk, pb, previous = lines["clk"][c], 0, False
        for i, (a, level) in enumerate(cs[:-1]):
            if level:
                continue
            b = cs[i + 1][0]
            for j, (s, v) in enumerate(clk):
                e = clk[j + 1][0] if j + 1 < len(clk) else float("inf")
                if s < b and e > a and s >= pb:
                    want.append((c, a, b, s, v, previous))
                    previous = v
            pb = b
    assert rows(got.select("capture_id", "a", "b", "t", "value", "previous")) == sorted(want, key=repr)
