"""Serial words from chip-select, clock and data runs.

A chip-select window is an active run that is followed by an inactive one. Each
clock run belongs to at most one window. In the window it starts in, its edge is
the run itself; the last clock run that began in the idle gap before a window is
also read there, and its edge is judged against the clock level at the end of the
window before. Both cases only look back in time, so one merged, bucketed pass over
clock and chip-select rows finds every sampling edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logicspark.functions.scalar import ns_to_us
from logicspark.operators.ordered import BUCKET, DEFAULT_WIDTH, neighbours, order_key
from logicspark.operators.signal import _bits, opening_runs
from logicspark.schemas import LINE_RUNS, CsPolarity, SpiMode, fields, require_columns

BY = ["capture_id"]


def cs_active(value: Column, polarity: CsPolarity) -> Column:
    if polarity is CsPolarity.DISABLED:
        return F.lit(True)
    return ~value if polarity is CsPolarity.ACTIVE_LOW else value


def cs_windows(
    cs: DataFrame, polarity: CsPolarity = CsPolarity.ACTIVE_LOW, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Closed windows ``[a, b)`` with ``pb``, the end of the window before (0 for the first)."""
    require_columns(cs, LINE_RUNS, "cs_windows")
    if polarity is CsPolarity.DISABLED:
        raise ValueError("without chip-select a window never closes, so no word could be decoded")
    d = cs.select(
        "capture_id",
        cs_active(F.col("value"), polarity).alias("active"),
        F.col("start_time").alias("a"),
        order_key("start_time").alias("__order"),
    )
    d = neighbours(
        d, BY, "__order", back={"pb": F.col("a")}, ahead={"b": F.col("a")}, inclusive=False, width=width
    )
    return d.filter(F.col("active") & F.col("b").isNotNull()).select(
        "capture_id", "a", "b", F.coalesce("pb", F.lit(0).cast("bigint")).alias("pb")
    )


def _merge_lines(
    clk: DataFrame, cs: DataFrame, mosi: DataFrame | None, miso: DataFrame | None, polarity: CsPolarity
) -> DataFrame:
    """One row per run of any line, in reading order.

    Ties: data from the start of the capture, inactive edge, clock, active edge, other
    data. So a clock run at the end of a window is outside it, one at its start is the
    gap's last run, and data is read just before the clock edge (at 0 for edge 0).
    ``key`` is the time, then the tie rank, then line * 2 + level, three bits each.
    """
    active = cs_active(F.col("value"), polarity)
    ranks = {
        "cs": F.when(active, 3).otherwise(1),
        "clk": F.lit(2),
        "mosi": F.when(F.col("start_time") == 0, 0).otherwise(4),
    }
    ranks["miso"] = ranks["mosi"]
    code_of = {"cs": _CS, "clk": _CLK, "mosi": _MOSI, "miso": _MISO}
    parts = []
    for name, line in (("cs", cs), ("clk", clk), ("mosi", mosi), ("miso", miso)):
        if line is None:
            continue
        require_columns(line, LINE_RUNS, f"{name} runs")
        level = active if name == "cs" else F.col("value")
        code = F.lit(2 * code_of[name]) + level.cast("int")
        key = order_key("start_time", ranks[name]) * 8 + code
        parts.append(line.select("capture_id", key.alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cs_window_clock(
    clk: DataFrame, cs: DataFrame, polarity: CsPolarity = CsPolarity.ACTIVE_LOW, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Clock runs read inside each window, each once, with the level read before it.

    Columns: capture_id, a, b, t (start of the clock run), value, previous. A run that begins in the gap before a window
    and goes on into it is read by the window if it is the gap's last one. Both lines are packed per bucket and shuffled
    once, as for ``spi_bits``.
    """
    _check(polarity)
    packed = _pack_runs(_merge_lines(clk, cs, None, None, polarity), width)
    return _scan(packed, _emit_clock, _CLOCK, SpiMode.MODE0, False)


_CLOCK = fields(capture_id="string", a="bigint", b="bigint", t="bigint", value="boolean", previous="boolean")
_CLK_STATE = fields(v="boolean", t="bigint", mosi="boolean", miso="boolean")
_GAP_STATE = fields(t="bigint", level="boolean")
_SUMMARY = fields(
    capture_id="string", __bucket="bigint", mosi="boolean", miso="boolean", n_target="bigint",
    clk=_CLK_STATE, gap=_GAP_STATE, cs=fields(active="boolean", t="bigint", n_target="bigint"),
    cs_clk=_CLK_STATE, cs_gap=_GAP_STATE, cs_first="bigint",
)
_BITS = fields(capture_id="string", a="bigint", t="bigint", bit_no="bigint", mosi="boolean", miso="boolean")
_PARTIAL_WORDS = fields(
    capture_id="string", window_id="bigint", word_no="bigint", mosi="bigint", miso="bigint",
    t_ns="bigint", bits="bigint",
)
_PACKED = fields(capture_id="string", __bucket="bigint", keys="binary")
_CS, _CLK, _MOSI, _MISO = range(4)


class _Bucket:
    """Index arrays over one bucket of merged line rows, in reading order."""

    def __init__(self, rows: pa.Table, target: bool):
        keys = np.sort(np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64))
        self.t = keys >> 6
        self.high = (keys & 1).astype(bool)
        line = (keys >> 1) & 3
        self.is_cs, self.is_clk = line == _CS, line == _CLK
        self.last_cs = self._last(self.is_cs)
        self.last_clk = self._last(self.is_clk)
        self.last_gap = self._last(self.is_cs & ~self.high)
        self.last_data = {"mosi": self._last(line == _MOSI), "miso": self._last(line == _MISO)}
        self.hit = self.is_clk & (self.high == target)
        self.n_hits = np.cumsum(self.hit)

    @staticmethod
    def _last(mask: np.ndarray) -> np.ndarray:
        """Index of the latest marked row at or before each row, -1 for none."""
        return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))

    def level(self, at: np.ndarray, otherwise) -> np.ndarray:
        return np.where(at >= 0, self.high[at], otherwise)


def _summarise(target: bool):
    """State each bucket leaves behind; null where it depends on an earlier bucket."""

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = _Bucket(rows, target)

        def data(name, i):
            j = b.last_data[name][i]
            return bool(b.high[j]) if j >= 0 else None

        def clk(i):
            j = b.last_clk[i]
            if j < 0:
                return None
            return {"v": bool(b.high[j]), "t": int(b.t[j]), "mosi": data("mosi", j), "miso": data("miso", j)}

        def gap(i):
            j = b.last_gap[i]
            if j < 0:
                return None
            k = b.last_clk[j]
            return {"t": int(b.t[j]), "level": bool(b.high[k]) if k >= 0 else None}

        end = len(b.t) - 1
        c = b.last_cs[end]
        row = {
            "capture_id": key[0].as_py(),
            "__bucket": key[1].as_py(),
            "mosi": data("mosi", end),
            "miso": data("miso", end),
            "n_target": int(b.n_hits[end]),
            "clk": clk(end),
            "gap": gap(end),
            "cs": None if c < 0 else {"active": bool(b.high[c]), "t": int(b.t[c]), "n_target": int(b.n_hits[c])},
            "cs_clk": None if c < 0 else clk(c),
            "cs_gap": None if c < 0 else gap(c),
            "cs_first": None if c < 0 else int(b.t[np.argmax(b.is_cs)]),
        }
        return pa.Table.from_pylist([row], schema=to_arrow_schema(_SUMMARY))

    return one


def _carry(summary: DataFrame, target: bool, initial_clock: bool) -> DataFrame:
    """State entering each bucket: one row per bucket, chained per capture."""
    before = W.partitionBy(*BY).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*BY).orderBy(F.col(BUCKET).desc()).rowsBetween(W.unboundedPreceding, -1)

    def clk_known(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(
                F.col(f"{c}.v").alias("v"), F.col(f"{c}.t").alias("t"),
                F.coalesce(f"{c}.mosi", "in_mosi").alias("mosi"),
                F.coalesce(f"{c}.miso", "in_miso").alias("miso"),
            ),
        )

    def gap_known(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.col(f"{c}.t").alias("t"), F.coalesce(f"{c}.level", "in_clk.v").alias("level")),
        )

    clock = F.coalesce(clk_known("cs_clk"), F.col("in_clk"))
    gap = F.coalesce(gap_known("cs_gap"), F.col("in_gap"))
    opens = (
        F.col("cs.active")
        & (clock.getField("t") >= F.coalesce(gap.getField("t"), F.lit(0)))
        & (clock.getField("v") == target)
        & (F.coalesce(gap.getField("level"), F.lit(initial_clock)) != target)
    )
    cs_known = F.when(
        F.col("cs").isNotNull(),
        F.struct(
            F.col("cs.active").alias("active"), F.col("cs.t").alias("t"),
            # hits of the capture that precede bit 0 of the window
            (F.col("in_hits") + F.col("cs.n_target") - F.coalesce(opens, F.lit(False)).cast("bigint")).alias("base"),
        ),
    )
    return (
        summary.withColumns(
            {
                "in_mosi": F.last("mosi", True).over(before),
                "in_miso": F.last("miso", True).over(before),
                "in_hits": F.coalesce(F.sum("n_target").over(before), F.lit(0)),
                "final_cs": F.max("cs.t").over(W.partitionBy(*BY)),
                "next_cs": F.last("cs_first", True).over(after),
            }
        )
        .withColumn("in_clk", F.last(clk_known("clk"), True).over(before))
        .withColumn("in_gap", F.last(gap_known("gap"), True).over(before))
        .withColumn("in_cs", F.last(cs_known, True).over(before))
        .select(
            *BY, BUCKET, "in_mosi", "in_miso", "in_hits", "final_cs", "next_cs",
            F.col("in_clk.v").alias("clk_v"), F.col("in_clk.t").alias("clk_t"),
            F.col("in_clk.mosi").alias("clk_mosi"), F.col("in_clk.miso").alias("clk_miso"),
            F.col("in_gap.t").alias("gap_t"), F.col("in_gap.level").alias("gap_level"),
            F.col("in_cs.active").alias("cs_active"), F.col("in_cs.t").alias("cs_t"),
            (F.col("in_hits") - F.col("in_cs.base")).alias("bits_done"),
        )
    )


def _openings(b: _Bucket, s: dict, initial_clock: bool) -> tuple[np.ndarray, ...]:
    """Windows that open in a bucket: row, time and level of the last clock run before (-1 for none), whether that run
    began in the gap, and the level before the gap's runs."""
    w = np.flatnonzero(b.is_cs & b.high)
    k, g = b.last_clk[w], b.last_gap[w]
    clk_t = np.where(k >= 0, b.t[k], -1 if s["clk_t"] is None else s["clk_t"])
    clk_v = np.where(k >= 0, b.high[k], bool(s["clk_v"]))
    gap_t = np.where(g >= 0, b.t[g], s["gap_t"] or 0)
    entry = initial_clock if s["clk_v"] is None else s["clk_v"]
    held = initial_clock if s["gap_level"] is None else s["gap_level"]
    level = np.where(g >= 0, b.level(b.last_clk[g], entry), held)
    return w, clk_t, clk_v, clk_t >= gap_t, level


def _sampled_bits(rows: pa.Table, carry: pa.Table, target: bool, initial_clock: bool):
    """(a, t, bit_no, mosi, miso) arrays of a bucket, given the state entering it."""
    s = carry.to_pylist()[0]
    b = _Bucket(rows, target)
    mosi, miso = (b.level(b.last_data[x], bool(s[f"in_{x}"])) for x in ("mosi", "miso"))
    final_cs = -1 if s["final_cs"] is None else s["final_cs"]

    # windows opening here: the gap's last clock run is read if its edge is new
    w, clk_t, clk_v, in_gap, level = _openings(b, s, initial_clock)
    opens = in_gap & (clk_v == target) & (level != target)
    k = b.last_clk[w]
    w_mosi = np.where(k >= 0, mosi[k], bool(s["clk_mosi"]))
    w_miso = np.where(k >= 0, miso[k], bool(s["clk_miso"]))
    gap_reads = opens & (b.t[w] < final_cs)

    # clock edges inside a window that opened here or before
    base = np.zeros(len(b.t), np.int64)
    base[w] = b.n_hits[w] - opens
    e = np.flatnonzero(b.hit)
    c = b.last_cs[e]
    active = np.where(c >= 0, b.high[c], bool(s["cs_active"]))
    a = np.where(c >= 0, b.t[c], s["cs_t"] or 0)
    bit = np.where(c >= 0, b.n_hits[e] - base[c], b.n_hits[e] + (s["bits_done"] or 0)) - 1
    inside = active & (a < final_cs)
    e, a, bit = e[inside], a[inside], bit[inside]

    return (
        np.concatenate([b.t[w][gap_reads], a]),
        np.concatenate([clk_t[gap_reads], b.t[e]]),
        np.concatenate([np.zeros(gap_reads.sum(), np.int64), bit]),
        np.concatenate([w_mosi[gap_reads], mosi[e]]),
        np.concatenate([w_miso[gap_reads], miso[e]]),
    )


def _emit_clock(target: bool, initial_clock: bool):
    """Clock runs of a bucket that lie in closed windows, and the last one of each gap before such a window."""

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table, carry: pa.Table) -> pa.Table:
        s = carry.to_pylist()[0]
        b = _Bucket(rows, target)
        cs_at = np.flatnonzero(b.is_cs)
        cs_t = np.r_[b.t[cs_at], -1 if s["next_cs"] is None else s["next_cs"]]
        w, clk_t, clk_v, in_gap, level = _openings(b, s, initial_clock)
        e = np.flatnonzero(b.is_clk)
        c, before = b.last_cs[e], np.r_[-1, b.last_clk[:-1]][e]
        a = np.r_[b.t[w], np.where(c >= 0, b.t[c], s["cs_t"] or 0)]
        end = cs_t[np.searchsorted(cs_at, np.r_[w, e], side="right")]
        entry = initial_clock if s["clk_v"] is None else s["clk_v"]
        keep = np.r_[in_gap, np.where(c >= 0, b.high[c], bool(s["cs_active"]))] & (end >= 0)
        columns = [
            a, end, np.r_[clk_t, b.t[e]], np.r_[clk_v, b.high[e]].astype(bool),
            np.r_[level, b.level(before, entry)].astype(bool),
        ]
        capture = pa.repeat(key[0].as_py(), int(keep.sum()))
        return pa.Table.from_arrays([capture, *(pa.array(x[keep]) for x in columns)], names=_CLOCK.names)

    return one


def _emit_bits(target: bool, initial_clock: bool):
    def one(key: tuple[pa.Scalar, ...], rows: pa.Table, carry: pa.Table) -> pa.Table:
        a, t, bit, mosi, miso = _sampled_bits(rows, carry, target, initial_clock)
        capture = pa.array([key[0].as_py()] * len(a), pa.string())
        return pa.Table.from_arrays([capture, *map(pa.array, (a, t, bit, mosi, miso))], names=_BITS.names)

    return one


def _emit_words(target: bool, initial_clock: bool, n: int):
    """Bits of a bucket folded per word, so the merge across buckets is small."""

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table, carry: pa.Table) -> pa.Table:
        a, t, bit, mosi, miso = _sampled_bits(rows, carry, target, initial_clock)
        order = np.lexsort((bit, a))
        a, t, bit, mosi, miso = a[order], t[order], bit[order], mosi[order], miso[order]
        word, weight = bit // n, np.int64(1) << (n - 1 - bit % n)
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (word[1:] != word[:-1])]) if len(a) else []
        if not len(starts):
            return to_arrow_schema(_PARTIAL_WORDS).empty_table()
        fold = lambda x: np.bitwise_or.reduceat(np.where(x, weight, 0), starts)
        capture = pa.array([key[0].as_py()] * len(starts), pa.string())
        counts = np.diff(np.r_[starts, len(a)])
        return pa.Table.from_arrays(
            [capture, *map(pa.array, (a[starts], word[starts], fold(mosi), fold(miso), t[starts], counts))],
            names=_PARTIAL_WORDS.names,
        )

    return one


_BEFORE_ALL, _AFTER_ALL = -1, 1 << 62
_EVERY_WINDOW = (1 << 63) - 1


def _check(polarity: CsPolarity, bits_per_word: int = 1) -> None:
    if polarity is CsPolarity.DISABLED:
        raise ValueError("without chip-select a window never closes, so no word could be decoded")
    if not 1 <= bits_per_word <= 63:
        raise ValueError(f"bits_per_word must be 1 to 63, got {bits_per_word}")


def _scan(packed: DataFrame, emit, schema, mode: SpiMode, initial_clock: bool) -> DataFrame:
    target = mode.samples_on_rising
    buckets, summary = _buckets(packed, target)
    carry = _carry(summary, target, initial_clock)
    return buckets.cogroup(carry.groupBy(*BY, BUCKET)).applyInArrow(emit(target, initial_clock), schema)


def _packed_rows(capture: pa.Array, group: np.ndarray, keys: np.ndarray, width: int) -> pa.RecordBatch:
    """One row per (capture, bucket); ``group`` indexes ``capture`` per key."""
    bucket = (keys >> 6) // width
    by = np.lexsort((bucket, group))
    group, bucket, keys = group[by], bucket[by], keys[by]
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])])
    ends = np.r_[starts[1:], len(keys)]
    return pa.RecordBatch.from_arrays(
        [
            capture.take(pa.array(group[starts])).cast(pa.string()),
            pa.array(bucket[starts]),
            pa.array([keys[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
        ],
        names=_PACKED.names,
    )


def _pack_runs(merged: DataFrame, width: int) -> DataFrame:
    """Rows of each batch folded per (capture, bucket) before the shuffle.

    The shuffle and the grouping then move a few byte strings instead of every row.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                capture = batch.column("capture_id").dictionary_encode()
                yield _packed_rows(
                    capture.dictionary, capture.indices.to_numpy(), batch.column("key").to_numpy(), width
                )

    return merged.mapInArrow(pack, _PACKED)


def _pack_blocks(blocks: DataFrame, lines: dict[int, list[int]], polarity: CsPolarity, width: int) -> DataFrame:
    """Level changes inside packed blocks, folded per bucket without becoming rows.

    ``lines`` maps a channel to the lines it serves.
    """
    inverted = polarity is CsPolarity.ACTIVE_LOW

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bits = _bits(row["data"], row["num_samples"])
                at = np.flatnonzero(bits[1:] != bits[:-1]) + 1
                if not len(at):
                    continue
                t = (at + row["start_position"]) * row["timestamp_step"]
                for line in lines[row["channel"]]:
                    high = bits[at].astype(np.int64)
                    if line == _CS:
                        high = 1 - high if inverted else high
                        rank = np.where(high == 1, 3, 1)
                    else:
                        rank = 2 if line == _CLK else 4
                    keys = (t << 6) + rank * 8 + 2 * line + high
                    yield _packed_rows(pa.array([row["capture_id"]]), np.zeros(len(keys), np.int64), keys, width)

    return blocks.select(
        "capture_id", "channel", "data", "start_position", "num_samples", "timestamp_step"
    ).mapInArrow(pack, _PACKED)


def _pack_lines(
    blocks: DataFrame, opening: DataFrame, lines: dict[str, int | None], polarity: CsPolarity, width: int
) -> DataFrame:
    """Packed rows of all lines from blocks (none empty) and the runs that begin on their first samples."""
    served: dict[int, list[int]] = {}
    for line, name in enumerate(("cs", "clk", "mosi", "miso")):
        if lines[name] is not None:
            served.setdefault(lines[name], []).append(line)
    inverted = polarity is CsPolarity.ACTIVE_LOW
    line = F.explode(F.create_map(*[F.lit(x) for c, of in served.items() for x in (c, of)])[F.col("channel")])
    first = opening.select("capture_id", "value", "start_time", line.alias("line"))
    high = F.when(F.col("line") == _CS, ~F.col("value") if inverted else F.col("value")).otherwise(F.col("value"))
    rank = (
        F.when(F.col("line") == _CS, F.when(high, 3).otherwise(1))
        .when(F.col("line") == _CLK, 2)
        .otherwise(F.when(F.col("start_time") == 0, 0).otherwise(4))
    )
    key = order_key("start_time", rank) * 8 + 2 * F.col("line") + high.cast("int")
    opened = first.select("capture_id", key.alias("key"))
    return _pack_blocks(blocks, served, polarity, width).unionByName(_pack_runs(opened, width))


def _buckets(packed: DataFrame, target: bool):
    buckets = packed.repartition(*BY, BUCKET).groupBy(*BY, BUCKET)
    return buckets, buckets.applyInArrow(_summarise(target), _SUMMARY)


def packed_lines(
    blocks: DataFrame, lines: dict[str, int | None], tails: DataFrame,
    *, polarity: CsPolarity = CsPolarity.ACTIVE_LOW, width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Level changes of a piece of a capture per time bucket, for ``spi_parts``; no run becomes a row.

    ``lines`` has the channels of cs, clk, mosi and miso, ``tails`` the last bits of blocks that came earlier.
    """
    _check(polarity)
    used = blocks.filter(F.col("channel").isin([c for c in lines.values() if c is not None]) & (F.col("num_samples") > 0))
    return _pack_lines(used, opening_runs(used, tails), lines, polarity, width)


def spi_parts(
    packed: DataFrame, prefix: DataFrame, *, bits_per_word: int, mode: SpiMode = SpiMode.MODE0
) -> tuple[DataFrame, DataFrame]:
    """One piece of a capture (``packed_lines``), given what the pieces before it left behind.

    Returns folded words, also of windows still open, and the state after this piece
    (``prefix`` of the next one): one row per capture. Start with an empty ``prefix``.
    """
    _check(CsPolarity.ACTIVE_LOW, bits_per_word)
    target = mode.samples_on_rising
    buckets, summary = _buckets(packed, target)
    known = prefix.select(*_SUMMARY.names).unionByName(summary)
    ends = known.select(*BY).distinct().withColumn(BUCKET, F.lit(_AFTER_ALL).cast("bigint"))
    carry = _carry(known.unionByName(ends, allowMissingColumns=True), target, False)
    entering = carry.filter(F.col(BUCKET).between(0, _AFTER_ALL - 1)).withColumn(
        "final_cs", F.lit(_EVERY_WINDOW).cast("bigint")
    )
    parts = buckets.cogroup(entering.groupBy(*BY, BUCKET)).applyInArrow(
        _emit_words(target, False, bits_per_word), _PARTIAL_WORDS
    )
    none = F.lit(None)
    after = carry.filter(F.col(BUCKET) == _AFTER_ALL).select(
        *BY, F.lit(_BEFORE_ALL).cast("bigint").alias(BUCKET),
        F.col("in_mosi").alias("mosi"), F.col("in_miso").alias("miso"), F.col("in_hits").alias("n_target"),
        F.when(F.col("clk_t").isNotNull(), F.struct(
            F.col("clk_v").alias("v"), F.col("clk_t").alias("t"),
            F.col("clk_mosi").alias("mosi"), F.col("clk_miso").alias("miso"),
        )).alias("clk"),
        F.when(F.col("gap_t").isNotNull(), F.struct(
            F.col("gap_t").alias("t"), F.col("gap_level").alias("level"))).alias("gap"),
        F.when(F.col("cs_t").isNotNull(), F.struct(
            F.col("cs_active").alias("active"), F.col("cs_t").alias("t"),
            (F.col("in_hits") - F.col("bits_done")).alias("n_target"))).alias("cs"),
        none.cast(_CLK_STATE).alias("cs_clk"), none.cast(_GAP_STATE).alias("cs_gap"), none.cast("bigint").alias("cs_first"),
    )
    return parts, after


def spi_bits(
    clk: DataFrame,
    cs: DataFrame,
    mosi: DataFrame | None = None,
    miso: DataFrame | None = None,
    *,
    mode: SpiMode = SpiMode.MODE0,
    polarity: CsPolarity = CsPolarity.ACTIVE_LOW,
    initial_clock: bool = False,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Every sampling edge: (capture_id, a, t, bit_no, mosi, miso).

    All lines are merged, packed per time bucket and shuffled once. A first pass leaves one
    row per bucket with the state at its end; those rows are chained per capture; a second
    pass over the same shuffled buckets reads the bits from a known state. Levels must
    alternate along each line, as runs do.

    The level before the first clock run is low, which gives an idle-high clock one extra
    edge in mode 3; ``initial_clock=True`` starts it high instead.
    """
    _check(polarity)
    packed = _pack_runs(_merge_lines(clk, cs, mosi, miso, polarity), width)
    return _scan(packed, _emit_bits, _BITS, mode, initial_clock)


def sampling_edges(clk: DataFrame, cs: DataFrame, **options) -> DataFrame:
    """(capture_id, a, t) of every clock edge at which data is read."""
    return spi_bits(clk, cs, **options).select(*BY, "a", "t")


def bit_index(clk: DataFrame, cs: DataFrame, **options) -> DataFrame:
    """Sampling edges with their 0-based number inside the window."""
    return spi_bits(clk, cs, **options).select(*BY, "a", "t", "bit_no")


def spi_words(
    clk: DataFrame,
    cs: DataFrame,
    mosi: DataFrame | None = None,
    miso: DataFrame | None = None,
    *,
    bits_per_word: int = 8,
    mode: SpiMode = SpiMode.MODE0,
    polarity: CsPolarity = CsPolarity.ACTIVE_LOW,
    initial_clock: bool = False,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Complete words, most significant bit first, timed at their first sampling edge."""
    _check(polarity, bits_per_word)
    packed = _pack_runs(_merge_lines(clk, cs, mosi, miso, polarity), width)
    parts = _scan(packed, partial(_emit_words, n=bits_per_word), _PARTIAL_WORDS, mode, initial_clock)
    return finish_words(fold_parts(parts), bits_per_word)


def spi_words_from_blocks(
    blocks: DataFrame,
    *,
    cs: int,
    clk: int,
    mosi: int | None = None,
    miso: int | None = None,
    bits_per_word: int = 8,
    mode: SpiMode = SpiMode.MODE0,
    polarity: CsPolarity = CsPolarity.ACTIVE_LOW,
    initial_clock: bool = False,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """``spi_words`` straight from packed blocks: no run ever becomes a row.

    Only the first sample of a block needs the block before; those runs are few and take
    the row path.
    """
    _check(polarity, bits_per_word)
    lines = {"cs": cs, "clk": clk, "mosi": mosi, "miso": miso}
    used = blocks.filter(F.col("channel").isin([c for c in lines.values() if c is not None]) & (F.col("num_samples") > 0))
    packed = _pack_lines(used, opening_runs(used), lines, polarity, width)
    parts = _scan(packed, partial(_emit_words, n=bits_per_word), _PARTIAL_WORDS, mode, initial_clock)
    return finish_words(fold_parts(parts), bits_per_word)


def fold_parts(parts: DataFrame) -> DataFrame:
    """Merge the pieces of words that were cut by a bucket or batch border."""
    return parts.groupBy(*BY, "window_id", "word_no").agg(
        F.bit_or("mosi").alias("mosi"), F.bit_or("miso").alias("miso"),
        F.min("t_ns").alias("t_ns"), F.sum("bits").alias("bits"),
    )


def finish_words(parts: DataFrame, bits_per_word: int) -> DataFrame:
    """Complete words only."""
    return parts.filter(F.col("bits") == bits_per_word).select(
        *BY, "window_id", "word_no", "mosi", "miso", "t_ns", ns_to_us(F.col("t_ns")).alias("timestamp_us")
    )


PREFIX = _SUMMARY
PARTS = _PARTIAL_WORDS
