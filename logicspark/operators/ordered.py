"""Order-dependent columns without one task per capture.

A capture can hold a third of all rows, so nothing here sorts a whole capture in
one window. Each stream is cut into buckets of its order key; windows run inside
(key, bucket), and what one bucket hands to the next is worked out on one row per
bucket. ``bucket_width`` keeps that at ``MAX_BUCKETS`` rows per key however long the
capture is, and a bucket holds at most ``width / step`` rows of a line, because two
rows of one line never share a sample.

Order keys are BIGINT. ``order_key(t, rank)`` folds a tie rank (0..7) into the
time, which keeps sorts and ``max_by`` on one primitive column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKS = 8
DEFAULT_WIDTH = 1 << 20  # nanoseconds, or rows for sequence numbers
MAX_BUCKETS = 1 << 20

BUCKET = "__bucket"


def bucket_width(duration: int, least: int = DEFAULT_WIDTH) -> int:
    """Bucket width for streams up to ``duration`` long: at most MAX_BUCKETS buckets."""
    return max(least, -(-int(duration) // MAX_BUCKETS))


def order_key(time: Column | str, rank: Column | int = 0) -> Column:
    """BIGINT sort key: time first, then the tie rank."""
    t = F.col(time) if isinstance(time, str) else time
    r = F.lit(rank) if isinstance(rank, int) else rank
    return t.cast("bigint") * RANKS + r.cast("bigint")


def bucket_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width) * RANKS}L")


def _in(name: str) -> str:
    return f"__in_{name}"


def bucket_carry(
    summary: DataFrame,
    by: Sequence[str],
    back: Sequence[str] = (),
    ahead: Sequence[str] = (),
    total: Sequence[str] = (),
) -> DataFrame:
    """What enters each bucket: last earlier value, first later value, earlier sum.

    ``summary`` has one row per (by, bucket), so a key has at most MAX_BUCKETS rows.
    """
    up = W.partitionBy(*by).orderBy(F.col(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*by).orderBy(F.col(BUCKET).desc()).rowsBetween(W.unboundedPreceding, -1)
    return summary.select(
        *by, BUCKET,
        *[F.last(c, True).over(up).alias(_in(c)) for c in back],
        *[F.last(c, True).over(down).alias(_in(c)) for c in ahead],
        *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(_in(c)) for c in total],
    )


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    back: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    *,
    inclusive: bool = True,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Add the nearest non-null value of each state at or before / after every row.

    A state is a primitive column expression that is null on rows that say nothing
    about it. ``inclusive=False`` leaves the row itself out (``lag`` / ``lead``).
    ``width`` is in units of the order key's time.
    """
    back, ahead = dict(back or {}), dict(ahead or {})
    d = df.withColumns({**back, **ahead}).withColumn(BUCKET, bucket_of(order, width))
    summary = d.groupBy(*by, BUCKET).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in back],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ahead],
    )
    carry = bucket_carry(summary, by, list(back), list(ahead))
    end = 0 if inclusive else -1
    up = W.partitionBy(*by, BUCKET).orderBy(F.col(order)).rowsBetween(W.unboundedPreceding, end)
    down = W.partitionBy(*by, BUCKET).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, end)
    local = d.withColumns(
        {f"__at_{c}": F.last(c, True).over(up) for c in back}
        | {f"__at_{c}": F.last(c, True).over(down) for c in ahead}
    )
    keep = [c for c in df.columns if c not in back and c not in ahead]
    return local.join(carry, [*by, BUCKET]).select(
        *keep, *[F.coalesce(f"__at_{c}", _in(c)).alias(c) for c in (*back, *ahead)]
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    *,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Add inclusive running sums in order; ``F.lit(1)`` gives a 1-based row number."""
    d = df.withColumns(dict(sums)).withColumn(BUCKET, bucket_of(order, width))
    names = list(sums)
    summary = d.groupBy(*by, BUCKET).agg(*[F.sum(c).alias(c) for c in names])
    carry = bucket_carry(summary, by, total=names)
    w = W.partitionBy(*by, BUCKET).orderBy(F.col(order)).rowsBetween(W.unboundedPreceding, 0)
    local = d.withColumns({f"__at_{c}": F.sum(c).over(w) for c in names})
    keep = [c for c in df.columns if c not in names]
    return local.join(carry, [*by, BUCKET]).select(
        *keep, *[(F.col(f"__at_{c}") + F.col(_in(c))).alias(c) for c in names]
    )


def asof_state(
    probe: DataFrame,
    state: DataFrame,
    by: Sequence[str],
    *,
    probe_time: str,
    state_time: str,
    values: Mapping[str, str],
    include_equal: bool = True,
    forward: bool = False,
    ties: Column | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Nearest ``state`` row in time for each ``probe`` row (no match gives null).

    ``values`` maps output names to state columns of primitive type. Backward takes
    the latest state with time <= probe (``<`` when ``include_equal`` is false),
    forward the earliest with time >= probe (or ``>``). ``ties`` (0..5) orders states
    of one time; without it such states must not differ.
    """
    state_first = include_equal != forward
    state_rank, probe_rank = (0, RANKS - 1) if state_first else (1, 0)
    state_rank = F.lit(state_rank) + (F.lit(0) if ties is None else ties.cast("int"))
    marker, order = "__probe", "__order"
    left = probe.withColumn(marker, F.lit(True)).withColumn(order, order_key(probe_time, probe_rank))
    right = state.select(
        *by,
        *[F.col(source).alias(name) for name, source in values.items()],
        F.lit(False).alias(marker),
        order_key(state_time, state_rank).alias(order),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    states = {name: F.when(~F.col(marker), F.col(name)) for name in values}
    filled = neighbours(
        both, by, order, ahead=states if forward else None, back=None if forward else states, width=width
    )
    return filled.filter(marker).drop(marker, order)
