"""Random line traces and plain sequential readings of the rules, for comparison."""

from __future__ import annotations

import random


def random_runs(rng: random.Random, n: int, low: int, high: int, first: int | None = None) -> list[tuple[int, bool]]:
    """(start, level) runs from time 0 with gaps of low..high."""
    level = bool(rng.randrange(2) if first is None else first)
    out, t = [], 0
    for _ in range(n):
        out.append((t, level))
        t += rng.randint(low, high)
        level = not level
    return out


def level_at(runs: list[tuple[int, bool]], t: int) -> bool:
    found = False
    for start, level in runs:
        if start <= t:
            found = level
    return found


def read_serial(cs, clk, mosi, miso, n, rising, active_level, initial=False):
    """Words window by window; each clock run is used by at most one window."""
    words, used, previous = [], 0, initial
    ends = [start for start, _ in clk[1:]] + [float("inf")]
    for i, (a, level) in enumerate(cs[:-1]):
        if level != active_level:
            continue
        b = cs[i + 1][0]
        while used < len(clk) and ends[used] <= a:
            used += 1
        bits = []
        while used < len(clk) and clk[used][0] < b:
            t, value = clk[used]
            hit = (not previous and value) if rising else (previous and not value)
            previous = value
            used += 1
            if hit:
                at = max(t - 1, 0)
                bits.append((t, level_at(mosi, at), level_at(miso, at)))
        for w in range(len(bits) // n):
            part = bits[w * n : (w + 1) * n]
            word = [sum(x[k] << (n - 1 - j) for j, x in enumerate(part)) for k in (1, 2)]
            words.append((a, w, word[0], word[1], part[0][0]))
    return words


def line_frame(spark, traces: dict[str, list[tuple[int, bool]]]):
    data = [(c, level, t) for c, runs in traces.items() for t, level in runs]
    return spark.createDataFrame(data, "capture_id string, value boolean, start_time long")
