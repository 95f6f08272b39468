"""Steps that scans of files go through: bodies from words in any order, lines to frames in one pass."""

from pyspark.sql import functions as F

from logicspark.operators import image
from logicspark.sources import sinks
from tests.conftest import rows


def test_shifted_planes_are_made_once(spark):
    lines = spark.range(9).select(
        F.when(F.col("id") < 5, "i").otherwise("j").alias("image_id"), (F.col("id") % 5).alias("row"),
        F.when(F.col("id") < 5, 12).otherwise(18).cast("bigint").alias("width_bytes"),
        F.expr("unhex(repeat(concat(hex(id + 1), '000'), 9))").alias("data"),
    )
    pixels = image.pixels_u16(lines)
    shape = spark.createDataFrame([("i", 5, 2), ("j", 4, 3)], "image_id string, total_rows long, pixel_width long")
    got = image.row_shift_compose(pixels, 1, 2, shape)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = []
    for name, first, high, wide in (("i", 1, 5, 2), ("j", 6, 4, 3)):
        value = lambda row: (first + row) * 16  # noqa: B023, E731
        want += [
            (name, row, col, value(row), value(max(row - 1, 0)), value(min(row + 2, high - 1)))
            for row in range(high) for col in range(wide)
        ]
    assert rows(got) == sorted(want, key=repr)


def test_bodies_from_words_in_any_order(spark):
    words = spark.range(2400).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("capture_id"), (F.col("id") % 2).alias("file_num"),
        F.expr("id div 6").alias("byte_index"), F.when(F.col("id") != 1200, F.col("id") * 11).alias("value"),
    )
    chunks = sinks.body_chunks(words.repartition(5, F.hash("value")).sortWithinPartitions(F.hash("byte_index")), 150)
    want = []
    for k in range(6):
        name, body = (f"c{k % 3}" if k % 3 else None), bytes(0 if i == 1200 else i * 11 & 255 for i in range(k, 2400, 6))
        want += [(name, k % 2, n, bytearray(body[n * 150 : n * 150 + 150])) for n in range(3)]
    assert rows(chunks) == sorted(want, key=repr)
