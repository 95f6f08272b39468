import random

import pytest
from pyspark.sql import functions as F

from logicspark.operators.ordered import MAX_BUCKETS, asof_state, bucket_width, neighbours, order_key, running_sum
from tests.conftest import rows

WIDTHS = [1, 7, 100_000]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    probe = [(f"k{rng.randrange(3)}", rng.randrange(300), i) for i in range(200)]
    state = [(k, t, rng.randrange(100)) for k in ("k0", "k1", "k3") for t in rng.sample(range(300), 25)]
    return (
        probe, state,
        spark.createDataFrame(probe, "k string, t long, id long"),
        spark.createDataFrame(state, "k string, at long, v long"),
    )


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("forward,equal", [(False, True), (False, False), (True, True), (True, False)])
def test_asof(tables, width, forward, equal):
    probe, state, p, s = tables
    got = asof_state(
        p, s, ["k"], probe_time="t", state_time="at", values={"v": "v"},
        include_equal=equal, forward=forward, width=width,
    ).select("id", "v")
    want = []
    for k, t, i in probe:
        if forward:
            ok = [(at, v) for kk, at, v in state if kk == k and (at > t or (equal and at == t))]
            want.append((i, min(ok)[1] if ok else None))
        else:
            ok = [(at, v) for kk, at, v in state if kk == k and (at < t or (equal and at == t))]
            want.append((i, max(ok)[1] if ok else None))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("width", WIDTHS)
def test_lag_lead_and_running_sum(tables, width):
    _, state, _, s = tables
    d = s.withColumn("o", order_key("at"))
    d = neighbours(d, ["k"], "o", back={"p": F.col("v")}, ahead={"n": F.col("v")}, inclusive=False, width=width)
    d = running_sum(d, ["k"], "o", {"total": F.col("v")}, width=width)
    want = []
    for k in {x[0] for x in state}:
        mine = sorted((t, v) for kk, t, v in state if kk == k)
        total = 0
        for i, (t, v) in enumerate(mine):
            total += v
            want.append((k, t, mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None, total))
    assert rows(d.select("k", "at", "p", "n", "total")) == sorted(want, key=repr)


def test_bucket_width_bounds_the_bucket_count():
    assert bucket_width(10) == 1 << 20
    long = 10**18
    assert long / bucket_width(long) <= MAX_BUCKETS
