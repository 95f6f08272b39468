"""Line shift between colour planes, from correlated row-to-row changes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logicspark.schemas import PIXELS, fields, require_columns

IMAGE = ["image_id"]
PLANES = ("g", "b", "r")
MAX_DELTA = 80
MIN_OVERLAP = 10
SAMPLED_COLUMNS = 64
BUCKET_ROWS = 1 << 12
LAG_SUMS = fields(
    image_id="string", plane="string", delta="bigint", n="bigint",
    a="double", b="double", ab="double", aa="double", bb="double",
)


def row_means(pixels: DataFrame, shape: DataFrame) -> DataFrame:
    """Mean of up to 64 evenly spaced columns per row and plane, 5 % off each side."""
    require_columns(pixels, PIXELS, "pixels")
    cols = (
        shape.select(*IMAGE, "pixel_width", F.expr("pixel_width div 20").alias("__margin"))
        .withColumn("__usable", F.greatest(F.col("pixel_width") - 2 * F.col("__margin"), F.lit(1)))
        .withColumn("__n", F.least(F.lit(SAMPLED_COLUMNS), "__usable"))
        .withColumn("__step", F.expr("__usable div __n"))
        .select(*IMAGE, "__margin", "__n", "__step")
    )
    at = F.col("col") - F.col("__margin")
    sampled = (at >= 0) & (at % F.col("__step") == 0) & (at < F.col("__n") * F.col("__step"))
    return (
        pixels.join(cols, "image_id")
        .filter(sampled)
        .groupBy(*IMAGE, "row")
        .agg(*[F.avg(p).alias(p) for p in PLANES])
    )


def row_derivative(means: DataFrame) -> DataFrame:
    """Next row minus this row. Each mean is sent to both rows it enters, one shuffle."""
    own = F.struct(F.col("row").alias("row"), *[(-F.col(p)).alias(p) for p in PLANES])
    back = F.struct((F.col("row") - 1).alias("row"), *[F.col(p).alias(p) for p in PLANES])
    return (
        means.select(*IMAGE, F.explode(F.array(own, back)).alias("x"))
        .groupBy(*IMAGE, F.col("x.row").alias("row"))
        .agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"x.{p}").alias(p) for p in PLANES])
        .filter("__n = 2")
        .drop("__n")
    )


def lag_profile(derivative: DataFrame, plane: str, max_delta: int = MAX_DELTA, reference: str = "g") -> DataFrame:
    """Pairs (a of row, b of row + delta) for every delta in -D..D.

    Shifted rows are made by exploding the delta list, then met by an equi join.
    """
    a = derivative.select(*IMAGE, "row", F.col(reference).alias("a"))
    deltas = F.explode(F.sequence(F.lit(-max_delta), F.lit(max_delta))).alias("delta")
    b = derivative.select(*IMAGE, F.col("row").alias("__row"), F.col(plane).alias("b"), deltas).select(
        *IMAGE, (F.col("__row") - F.col("delta")).alias("row"), "delta", "b"
    )
    return b.join(a, [*IMAGE, "row"])


def normalized_corr(pairs: DataFrame) -> DataFrame:
    """Correlation per delta; short overlaps are skipped, flat signals give 0."""
    d = pairs.groupBy(*IMAGE, "delta").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("a", "b").alias("__ab"),
        F.var_pop("a").alias("__aa"),
        F.var_pop("b").alias("__bb"),
    )
    scale = F.sqrt(F.col("__aa") * F.col("__bb"))
    corr = F.when(F.col("n") * scale > 1e-12, F.col("__ab") / scale).otherwise(F.lit(0.0))
    return d.filter(F.col("n") >= MIN_OVERLAP).select(*IMAGE, "delta", "n", corr.alias("corr"))


def lag_sums(
    derivative: DataFrame, planes: Sequence[str], max_delta: int = MAX_DELTA, reference: str = "g",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Sums over all pairs (reference of row, plane of row + delta), for every plane and delta in -D..D.

    Rows go to the task of their bucket of rows, and those within D of its border to the next one too, where they only
    serve as partners. One pass over a bucket gives the sums of all deltas and planes; the shuffle that adds them up holds
    2 D + 1 rows a bucket and plane.
    """
    low, high = (F.floor((F.col("row") + d) / bucket_rows) for d in (-max_delta, max_delta))
    names = [reference, *planes]
    dealt = derivative.select(
        *IMAGE, "row", *[F.col(p).cast("double").alias(f"p{k}") for k, p in enumerate(names)],
        F.explode(F.sequence(low, high)).alias("bucket"),
    )

    def sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        begin = key[1].as_py() * bucket_rows
        row = rows.column("row").to_numpy() - begin + max_delta
        values = np.full((len(names), bucket_rows + 2 * max_delta), np.nan)
        for k in range(len(names)):
            values[k, row] = rows.column(f"p{k}").to_numpy()
        own = values[0, max_delta : max_delta + bucket_rows]
        out: list[dict] = []
        for k, plane in enumerate(planes, 1):
            for delta in range(-max_delta, max_delta + 1):
                other = values[k, max_delta + delta : max_delta + delta + bucket_rows]
                met = ~(np.isnan(own) | np.isnan(other))
                a, b = own[met], other[met]
                if len(a):
                    parts = (a.sum(), b.sum(), a @ b, a @ a, b @ b)
                    out.append(dict(zip(LAG_SUMS.names, [key[0].as_py(), plane, delta, len(a), *parts], strict=True)))
        return pa.Table.from_pylist(out, schema=_LAG_SUMS)

    parts = dealt.groupBy(*IMAGE, "bucket").applyInArrow(sums, LAG_SUMS)
    return parts.groupBy(*IMAGE, "plane", "delta").agg(*[F.sum(c).alias(c) for c in LAG_SUMS.names[3:]])


_LAG_SUMS = pa.schema(
    [("image_id", pa.string()), ("plane", pa.string()), ("delta", pa.int64()), ("n", pa.int64())]
    + [(c, pa.float64()) for c in ("a", "b", "ab", "aa", "bb")]
)


def correlated(sums: DataFrame) -> DataFrame:
    """Correlation per plane and delta from ``lag_sums``, as ``normalized_corr`` has it from pairs."""
    n = F.col("n")
    cov = F.col("ab") - F.col("a") * F.col("b") / n
    scale = F.sqrt(
        F.greatest(F.col("aa") - F.col("a") * F.col("a") / n, F.lit(0.0))
        * F.greatest(F.col("bb") - F.col("b") * F.col("b") / n, F.lit(0.0))
    )
    corr = F.when(scale > 1e-12, cov / scale).otherwise(F.lit(0.0))
    return sums.filter(n >= MIN_OVERLAP).select(*IMAGE, "plane", "delta", "n", corr.alias("corr"))


def best_delta(profile: DataFrame, shape: DataFrame, max_delta: int = MAX_DELTA) -> DataFrame:
    """Delta of the highest correlation, the smallest among equals.

    (0, 0.0) when the image has fewer than 2 D + 2 rows or no width.
    """
    best = profile.groupBy(*IMAGE).agg(F.max(F.struct("corr", (-F.col("delta")).alias("minus"))).alias("__best"))
    small = (F.col("total_rows") < 2 * max_delta + 2) | (F.col("pixel_width") == 0)
    return shape.join(best, IMAGE, "left").select(
        *IMAGE,
        F.when(small, 0).otherwise(F.coalesce(-F.col("__best.minus"), F.lit(0))).alias("delta"),
        F.when(small, 0.0).otherwise(F.coalesce(F.col("__best.corr"), F.lit(float("-inf")))).alias("corr"),
    )


def top_corr(profile: DataFrame, k: int = 5) -> DataFrame:
    """The k best shifts of each image; a profile has 2 D + 1 rows per image."""
    rank = F.row_number().over(W.partitionBy(*IMAGE).orderBy(F.col("corr").desc(), "delta"))
    return profile.withColumn("rank", rank).filter(F.col("rank") <= k)


def plane_delta(derivative: DataFrame, shape: DataFrame, plane: str, max_delta: int = MAX_DELTA) -> DataFrame:
    return best_delta(correlated(lag_sums(derivative, [plane], max_delta)), shape, max_delta)


def auto_deltas(pixels: DataFrame, shape: DataFrame, max_delta: int = MAX_DELTA) -> DataFrame:
    """Both planes against green, in the signs ``row_shift_compose`` takes. One pass over the rows serves both."""
    sums = lag_sums(row_derivative(row_means(pixels, shape)), ["b", "r"], max_delta)
    best = F.max(F.struct("corr", (-F.col("delta")).alias("minus")))
    of = {p: F.max(F.when(F.col("plane") == p, F.col("best"))).alias(p) for p in ("b", "r")}
    found = correlated(sums).groupBy(*IMAGE, "plane").agg(best.alias("best")).groupBy(*IMAGE).agg(*of.values())
    small = (F.col("total_rows") < 2 * max_delta + 2) | (F.col("pixel_width") == 0)

    def delta(plane: str):
        return F.when(small, 0).otherwise(F.coalesce(-F.col(f"{plane}.minus"), F.lit(0)))

    def corr(plane: str):
        return F.when(small, 0.0).otherwise(F.coalesce(F.col(f"{plane}.corr"), F.lit(float("-inf"))))

    return shape.join(found, IMAGE, "left").select(
        *IMAGE, (-delta("b")).alias("bg_delta"), corr("b").alias("bg_corr"), delta("r").alias("gr_delta"), corr("r").alias("gr_corr")
    )
