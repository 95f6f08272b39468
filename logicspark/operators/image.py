"""Scanner images: pixels from capture bodies, colour planes, screen sampling.

Planes are 16-bit G, B, R. A body is a table of fixed-size chunks, so one long file
spreads over many tasks; a line is cut out of the one or two chunks it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logicspark.functions import scalar
from logicspark.functions.scalar import BACKGROUND, BYTES_PER_PIXEL
from logicspark.schemas import PIXELS, DisplayMode, require_columns

IMAGE = ["image_id"]
PLANES = ("g", "b", "r")
CHUNK_BYTES = 1 << 20
PIXELS_PER_BATCH = 1 << 15


def line_bytes(chunks: DataFrame, lines: DataFrame, width_bytes: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Bytes of each line: (image_id, row, width_bytes, data). Short at the end of the body.

    ``chunks``: (image_id, chunk_no, data), ``chunk_bytes`` each but the last.
    ``lines``: (image_id, row, line_start) and whatever ``width_bytes`` refers to.
    """
    start, end = F.col("line_start"), F.col("line_start") + F.col("__w")
    want = (
        lines.withColumn("__w", width_bytes.cast("bigint"))
        .filter("__w > 0")
        .withColumn(
            "chunk_no",
            F.explode(F.sequence(F.floor(start / chunk_bytes), F.floor((end - 1) / chunk_bytes))),
        )
        .select(*IMAGE, "row", "line_start", "__w", "chunk_no")
    )
    base = F.col("chunk_no") * chunk_bytes
    first = F.greatest(start - base, F.lit(0))
    size = F.least(end - base, F.lit(chunk_bytes)) - first
    pieces = want.join(chunks.select(*IMAGE, "chunk_no", "data"), [*IMAGE, "chunk_no"], "left").select(
        *IMAGE, "row", "__w",
        F.struct("chunk_no", F.substr("data", (first + 1).cast("int"), size.cast("int")).alias("part")).alias("piece"),
    )
    # a line spans width / chunk_bytes + 2 chunks at most
    return (
        pieces.groupBy(*IMAGE, "row")
        .agg(F.array_sort(F.collect_list("piece")).alias("p"), F.max("__w").alias("width_bytes"))
        .select(
            *IMAGE, "row", "width_bytes",
            F.aggregate(
                "p", F.lit(b""), lambda all_, x: F.concat(all_, F.coalesce(x.part, F.lit(b"")))
            ).alias("data"),
        )
    )


def _whole_values(data: pa.Buffer, size: int) -> bytes:
    """``size`` bytes of a line, zeros from the first value that misses a byte."""
    have = min(len(data), size) // 2 * 2
    return data[:have].to_pybytes().ljust(size, b"\0")


def pixels_u16(lines: DataFrame, pixel_width: int | None = None) -> DataFrame:
    """Line bytes to pixels, low byte first; a value with a missing byte is 0.

    Without ``pixel_width`` each line has the whole pixels of its own ``width_bytes``."""
    width = F.expr(f"width_bytes div {BYTES_PER_PIXEL}") if pixel_width is None else F.lit(pixel_width)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column("pixel_width").to_numpy()
            # Lines of one width are unpacked together, some PIXELS_PER_BATCH at a time.
            for width in np.unique(wide[wide > 0]).tolist():
                own, together = np.flatnonzero(wide == width), max(1, PIXELS_PER_BATCH // width)
                for k in range(0, len(own), together):
                    part = batch.take(pa.array(own[k : k + together]))
                    raw = b"".join(_whole_values(d.as_buffer(), width * BYTES_PER_PIXEL) for d in part.column("data"))
                    planes = np.frombuffer(raw, "<u2").astype(np.int32).reshape(-1, 3).T
                    at = np.arange(len(part)).repeat(width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("image_id").take(pa.array(at)),
                            part.column("row").take(pa.array(at)),
                            pa.array(np.tile(np.arange(width, dtype=np.int64), len(part))),
                            *(pa.array(np.ascontiguousarray(p)) for p in planes),
                        ],
                        names=PIXELS.names,
                    )

    own = lines.select("image_id", "row", "data", width.cast("int").alias("pixel_width"))
    return own.mapInArrow(unpack, PIXELS)


def geometry(pixels: DataFrame) -> DataFrame:
    """(image_id, total_rows, pixel_width)."""
    return pixels.groupBy(*IMAGE).agg(
        (F.max("row") + 1).alias("total_rows"), (F.max("col") + 1).alias("pixel_width")
    )


def _fed_rows(delta: Column) -> Column:
    """Output rows that read this source row when row - delta is clamped to the image."""
    row, last = F.col("row"), F.col("total_rows") - 1
    low = F.greatest(F.when(row == 0, F.lit(0)).otherwise(row + delta), F.lit(0))
    high = F.least(F.when(row == last, last).otherwise(row + delta), last)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def row_shift_compose(
    pixels: DataFrame,
    bg_delta: int = 0,
    gr_delta: int = 0,
    shape: DataFrame | None = None,
    deltas: DataFrame | None = None,
) -> DataFrame:
    """Blue from ``row - bg_delta``, red from ``row + gr_delta``, both clamped to the image.

    ``deltas`` (image_id, bg_delta, gr_delta) gives each image shifts of its own; images it lacks take the two numbers.
    Pixels are gathered to image lines once; from there whole lines go, in one pass, to the rows that read them and meet
    in one aggregation, three rows for a line. The pixel table is read once and never joined with itself.
    """
    require_columns(pixels, PIXELS, "pixels")
    shifts = (geometry(pixels) if shape is None else shape).select(*IMAGE, "total_rows")
    blue_by, red_by = F.lit(bg_delta), F.lit(gr_delta)
    if deltas is not None:
        own = deltas.select(*IMAGE, F.col("bg_delta").alias("__bg"), F.col("gr_delta").alias("__gr"))
        shifts = shifts.join(own, IMAGE, "left")
        blue_by, red_by = F.coalesce("__bg", blue_by), F.coalesce("__gr", red_by)
    shifts = shifts.select(*IMAGE, "total_rows", blue_by.cast("bigint").alias("__bg"), red_by.cast("bigint").alias("__gr"))
    line = F.array_sort(F.collect_list(F.struct("col", *PLANES)))
    planes = pixels.groupBy(*IMAGE, "row").agg(line.alias("line")).select(*IMAGE, "row", *[F.col(f"line.{p}").alias(p) for p in PLANES])
    d = planes.join(shifts, IMAGE)

    # Each line goes out under the rows that read its plane k.
    fed = (F.array("row"), _fed_rows(F.col("__bg")), _fed_rows(-F.col("__gr")))

    def named(k: int) -> Column:
        return F.transform(fed[k], lambda row: F.struct(row.alias("row"), F.lit(k).alias("k")))

    to = F.explode(F.concat(*[named(k) for k in range(len(PLANES))])).alias("__to")
    sent = d.select(*IMAGE, to, *PLANES)
    met = (
        sent.select(*IMAGE, "__to.row", *[F.when(F.col("__to.k") == k, F.col(p)).alias(p) for k, p in enumerate(PLANES)])
        .groupBy(*IMAGE, "row")
        .agg(*[F.max(p).alias(p) for p in PLANES])
    )
    longest = F.greatest(*[F.coalesce(F.size(p), F.lit(0)) for p in PLANES])
    at = F.explode(F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>")))
    cells = met.withColumn("__at", at)
    return cells.select(*IMAGE, "row", F.col("__at").cast("bigint").alias("col"), *[F.get(p, F.col("__at")).alias(p) for p in PLANES])


def channel_toggle(pixels: DataFrame, show_r: bool = True, show_g: bool = True, show_b: bool = True) -> DataFrame:
    shown = {"r": show_r, "g": show_g, "b": show_b}
    return pixels.withColumns({c: F.lit(0) for c, on in shown.items() if not on})


def gain_gamma(pixels: DataFrame, gain: float = 1.0 / 96.0, gamma: bool = False) -> DataFrame:
    """16-bit planes to 0..255."""
    return pixels.withColumns({c: scalar.apply_gain(F.col(c), gain, gamma) for c in ("g", "b", "r")})


def frame_decode(
    pixels: DataFrame,
    mode: DisplayMode = DisplayMode.COLOR,
    *,
    bg_delta: int = 0,
    gr_delta: int = 0,
    show_r: bool = True,
    show_g: bool = True,
    show_b: bool = True,
    gain: float = 1.0 / 96.0,
    gamma: bool = False,
    shape: DataFrame | None = None,
    deltas: DataFrame | None = None,
) -> DataFrame:
    """(image_id, row, col, rgb) of a grayscale or colour frame; ``deltas`` as in ``row_shift_compose``."""
    scaled = gain_gamma(pixels, gain, gamma)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    if mode is DisplayMode.GRAYSCALE:
        gray = scaled.withColumn("v", scalar.luma(r, g, b))
        return gray.select(*IMAGE, "row", "col", scalar.pack_rgb(F.col("v"), F.col("v"), F.col("v")).alias("rgb"))
    if bg_delta or gr_delta or deltas is not None:
        scaled = row_shift_compose(scaled, bg_delta, gr_delta, shape, deltas)
    shown = channel_toggle(scaled, show_r, show_g, show_b)
    return shown.select(*IMAGE, "row", "col", scalar.pack_rgb(r, g, b).alias("rgb"))


class Viewport:
    """Screen size, scroll and zoom over images of one width; f64 arithmetic throughout."""

    def __init__(self, pixel_width: int, width: int, height: int, scroll_row=0.0, scroll_col=0.0, zoom=1.0):
        self.width, self.height = width, height
        self.scroll_row, self.scroll_col = float(scroll_row), float(scroll_col)
        self.scale = 1.0 if pixel_width == 0 else width / (pixel_width * zoom)
        self.step = 1.0 / self.scale

    @property
    def zoomed_out(self) -> bool:
        return self.scale < 1.0

    def source(self, screen: Column, scroll: float) -> Column:
        """First source index of a screen index; negative positions read index 0."""
        return F.greatest((screen.cast("double") * self.step + scroll).cast("bigint"), F.lit(0))

    def bin_of(self, source: Column, scroll: float, limit: int) -> Column:
        """Screen index whose source range holds this index, NULL when off screen.

        Arithmetic gives a guess; the exact range bounds settle it.
        """
        guess = F.floor((source - scroll) / self.step).cast("bigint")
        found = F.lit(None).cast("bigint")
        for near in (1, 0, -1):
            n = guess + near
            inside = (self.source(n, scroll) <= source) & (source < self.source(n + 1, scroll))
            found = F.when(inside & (n >= 0) & (n < limit), n).otherwise(found)
        return found


def screen_grid(images: DataFrame, view: Viewport) -> DataFrame:
    """Every screen cell of each image: width x height rows per image."""
    return images.select(
        *IMAGE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(view.height - 1).cast("bigint"))).alias("dy")
    ).select(
        *IMAGE, "dy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(view.width - 1).cast("bigint"))).alias("dx")
    )


def viewport_bins(frame: DataFrame, view: Viewport) -> DataFrame:
    """Add the screen cell (dy, dx) of every source pixel; off-screen pixels are dropped."""
    d = frame.withColumns(
        {
            "dy": view.bin_of(F.col("row"), view.scroll_row, view.height),
            "dx": view.bin_of(F.col("col"), view.scroll_col, view.width),
        }
    )
    return d.filter(F.col("dy").isNotNull() & F.col("dx").isNotNull())


def _on_screen(cells: DataFrame, images: DataFrame, view: Viewport, rgb: Column) -> DataFrame:
    grid = screen_grid(images, view)
    return grid.join(cells, [*IMAGE, "dy", "dx"], "left").select(
        *IMAGE, "dy", "dx", F.coalesce(rgb, F.lit(BACKGROUND)).alias("rgb")
    )


def box_downsample(frame: DataFrame, images: DataFrame, view: Viewport) -> DataFrame:
    """Zoomed out: integer mean of each colour over the pixels of a cell."""
    rgb = F.col("rgb")
    mean = lambda c: F.expr(f"sum({c}) div count(1)").cast("int")
    cells = (
        viewport_bins(frame, view)
        .select(
            *IMAGE, "dy", "dx",
            scalar.red_of(rgb).alias("r"), scalar.green_of(rgb).alias("g"), scalar.blue_of(rgb).alias("b"),
        )
        .groupBy(*IMAGE, "dy", "dx")
        .agg(mean("r").alias("r"), mean("g").alias("g"), mean("b").alias("b"))
    )
    return _on_screen(cells, images, view, scalar.pack_rgb(F.col("r"), F.col("g"), F.col("b")))


def nearest_upsample(frame: DataFrame, images: DataFrame, view: Viewport) -> DataFrame:
    """Zoomed in or 1:1: each cell shows the pixel at its start, else background."""
    grid = screen_grid(images, view).withColumns(
        {
            "row": view.source(F.col("dy"), view.scroll_row),
            "col": view.source(F.col("dx"), view.scroll_col),
        }
    )
    return grid.join(frame, [*IMAGE, "row", "col"], "left").select(
        *IMAGE, "dy", "dx", F.coalesce("rgb", F.lit(BACKGROUND)).alias("rgb")
    )


def render(frame: DataFrame, images: DataFrame, view: Viewport) -> DataFrame:
    """Screen cells at any zoom."""
    return box_downsample(frame, images, view) if view.zoomed_out else nearest_upsample(frame, images, view)
