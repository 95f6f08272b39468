"""The composed jobs: words, controlled captures, register dumps, images."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logicspark.operators import alignment, image, parallel, registers, sessions, signal, spi
from logicspark.operators.control import DISABLE_COMMAND, ENABLE_COMMAND, control_state
from logicspark.operators.ordered import DEFAULT_WIDTH
from logicspark.schemas import CsPolarity, DisplayMode, SpiMode, StrobeMode
from logicspark.sources.sinks import register_csv_rows
from logicspark.sources.capture import root_folder
from logicspark.sources.tables import companion_path, file_name_below, read_body_chunks, read_line_records


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or a local one in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    import tempfile

    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and continue from the table."""
    path = f"{shared_folder(df.sparkSession)}/logicspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spi_decode(
    blocks: DataFrame | Callable[[list[int]], DataFrame],
    *,
    cs: int,
    clk: int,
    mosi: int | None = None,
    miso: int | None = None,
    bits_per_word: int = 24,
    mode: SpiMode = SpiMode.MODE0,
    polarity: CsPolarity = CsPolarity.ACTIVE_LOW,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Packed blocks to serial words. Only the channels in use are read.

    ``blocks`` is a table laid out by channel (``save_blocks``), or a function that opens
    the wanted channels, such as an archive scan with its ``channels`` option.
    """
    channels = sorted({c for c in (cs, clk, mosi, miso) if c is not None})
    used = blocks(channels) if callable(blocks) else signal.project_channels(blocks, channels)
    return spi.spi_words_from_blocks(
        used, cs=cs, clk=clk, mosi=mosi, miso=miso,
        bits_per_word=bits_per_word, mode=mode, polarity=polarity, width=width,
    )


@dataclass
class ControlledCapture:
    control: DataFrame
    words: DataFrame
    edges: DataFrame
    records: DataFrame
    index: DataFrame


def controlled_capture(
    blocks: DataFrame,
    line_clock: DataFrame,
    commands: DataFrame,
    *,
    strobe: int,
    data: Sequence[int],
    cs: int | None = None,
    mode: StrobeMode = StrobeMode.ANY,
    polarity: CsPolarity = CsPolarity.DISABLED,
    enable: int = ENABLE_COMMAND,
    disable: int = DISABLE_COMMAND,
    width: int = DEFAULT_WIDTH,
    keep: bool = True,
) -> ControlledCapture:
    """Bus words gated and split into sessions by serial commands, with line records.

    ``commands`` are serial words (capture_id, t_ns, mosi). Every step feeds several
    later ones, so ``keep`` writes each once to the shared folder; the index stays lazy.
    """
    hold = stage if keep else lambda df, name: df
    control = hold(control_state(commands, enable, disable, width), "control")
    bus = hold(
        parallel.parallel_words(blocks, strobe=strobe, data=data, cs=cs, mode=mode, polarity=polarity), "bus"
    )
    words = hold(sessions.assign_sessions(bus, control, width), "words")
    edges = hold(sessions.line_edge_to_word(line_clock, words, width), "edges")
    records = hold(sessions.line_records(edges, width), "records")
    return ControlledCapture(control, words, edges, records, sessions.capture_index(words, records, width))


def capture_job(
    blocks: DataFrame,
    *,
    cs: int,
    clk: int,
    mosi: int,
    line_clock: int,
    strobe: int,
    data: Sequence[int],
    bus_cs: int | None = None,
    bits_per_word: int = 24,
    spi_mode: SpiMode = SpiMode.MODE0,
    spi_polarity: CsPolarity = CsPolarity.ACTIVE_LOW,
    mode: StrobeMode = StrobeMode.ANY,
    polarity: CsPolarity = CsPolarity.DISABLED,
    enable: int = ENABLE_COMMAND,
    disable: int = DISABLE_COMMAND,
    width: int = DEFAULT_WIDTH,
) -> ControlledCapture:
    """From one block table to sessions, line records and index: the serial lines are decoded to commands, commands
    gate and split the bus words, and the line clock marks the lines in them."""
    commands = stage(
        spi_decode(
            blocks, cs=cs, clk=clk, mosi=mosi, bits_per_word=bits_per_word, mode=spi_mode, polarity=spi_polarity, width=width
        ).select("capture_id", "t_ns", "mosi"),
        "commands",
    )
    clock = stage(signal.edge_runs(signal.project_channels(blocks, [line_clock])).drop("channel"), "line-clock")
    return controlled_capture(
        blocks, clock, commands, strobe=strobe, data=data, cs=bus_cs, mode=mode, polarity=polarity,
        enable=enable, disable=disable, width=width,
    )


def register_dump(
    commands: DataFrame,
    capture_num: int | None = None,
    enable: int = ENABLE_COMMAND,
    disable: int = DISABLE_COMMAND,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Register table before the chosen capture, or before the longest one.

    Only the chosen enable is looked up: last write per register before it.
    """
    enabled = registers.enables(commands, enable, width)
    durations = None if capture_num is not None else registers.capture_durations(commands, enable, disable, width)
    chosen = registers.snapshot_pick(enabled, durations, capture_num)
    snapshot = registers.snapshot_before(registers.register_writes(commands, enable, disable), chosen)
    return register_csv_rows(snapshot)


def scan_image(
    chunks: DataFrame,
    lines: DataFrame,
    *,
    width_bytes: int,
    chunk_bytes: int = image.CHUNK_BYTES,
    bg_delta: int = 0,
    gr_delta: int = 0,
    gain: float = 1.0 / 96.0,
    gamma: bool = False,
    mode: DisplayMode = DisplayMode.COLOR,
) -> DataFrame:
    """Body chunks and line starts to a frame (image_id, row, col, rgb)."""
    pixel_width = width_bytes // image.BYTES_PER_PIXEL
    cut = image.line_bytes(chunks, lines, F.lit(pixel_width * image.BYTES_PER_PIXEL), chunk_bytes)
    pixels = image.pixels_u16(cut, pixel_width)
    shape = lines.groupBy("image_id").agg(
        (F.max("row") + 1).alias("total_rows"), F.lit(pixel_width).cast("bigint").alias("pixel_width")
    )
    shifted = bool(bg_delta or gr_delta) and mode is DisplayMode.COLOR
    return image.frame_decode(
        pixels, mode, bg_delta=bg_delta, gr_delta=gr_delta, gain=gain, gamma=gamma,
        shape=shape if shifted else None,
    )


@dataclass
class ScanFiles:
    """Bodies of a folder and what their line tables say: body chunks, line starts and bytes of a line of each image."""

    chunks: DataFrame
    lines: DataFrame
    widths: DataFrame


def open_scans(
    spark: SparkSession, folder: str, chunk_bytes: int = image.CHUNK_BYTES, start_offset: int = 4, width: int = DEFAULT_WIDTH
) -> ScanFiles:
    """Bodies ``<folder>/*/*.bin`` (or parts) with the line tables that belong to them.

    An image needs both: bodies whose companion is not there, and tables without a body, give nothing. Lines start at the
    falling index; their width is the upper median of the steps between them, so each image has its own."""
    paths = f"{folder}/*/*.bin*"
    chunks = read_body_chunks(spark, paths, chunk_bytes)
    # By names alone; a part of a body is named after it.
    body = F.concat(F.regexp_replace(file_name_below(root_folder(paths)), r"\.bin$", ""), F.lit(".bin"))
    bodies = spark.read.format("binaryFile").load(paths).select(companion_path(body).alias("table")).distinct()
    table = F.concat("image_id", F.lit("_tgck.csv")) == F.col("table")
    # Width and line starts go through the records several times.
    records = stage(read_line_records(spark, f"{folder}/*/*_tgck.csv").join(bodies, table, "left_semi"), "records")
    widths = sessions.line_width(records, ["image_id"], width).withColumnRenamed("width", "width_bytes")
    lines = sessions.line_offsets(records, ["image_id"], start_offset, width)
    return ScanFiles(chunks, lines, widths)


def scan_image_files(
    spark: SparkSession,
    folder: str,
    *,
    chunk_bytes: int = image.CHUNK_BYTES,
    start_offset: int = 4,
    width: int = DEFAULT_WIDTH,
    deltas: DataFrame | None = None,
    bg_delta: int = 0,
    gr_delta: int = 0,
    gain: float = 1.0 / 96.0,
    gamma: bool = False,
    mode: DisplayMode = DisplayMode.COLOR,
) -> DataFrame:
    """Frames (image_id, row, col, rgb) of all scans of a folder, each with the line width that its own table shows.

    ``deltas`` (image_id, bg_delta, gr_delta) as in ``row_shift_compose``."""
    files = open_scans(spark, folder, chunk_bytes, start_offset, width)
    lines = stage(files.lines.join(files.widths, "image_id"), "lines")
    pixel = F.lit(image.BYTES_PER_PIXEL)
    whole = F.expr(f"width_bytes div {image.BYTES_PER_PIXEL}") * pixel
    pixels = image.pixels_u16(image.line_bytes(files.chunks, lines, whole, chunk_bytes))
    shape = lines.groupBy("image_id").agg(
        (F.max("row") + 1).alias("total_rows"), F.expr(f"max(width_bytes) div {image.BYTES_PER_PIXEL}").alias("pixel_width")
    )
    shifted = mode is DisplayMode.COLOR and (bg_delta or gr_delta or deltas is not None)
    return image.frame_decode(
        pixels, mode, bg_delta=bg_delta, gr_delta=gr_delta, gain=gain, gamma=gamma,
        shape=shape if shifted else None, deltas=deltas,
    )


def aligned_scan_image(
    chunks: DataFrame, lines: DataFrame, *, width_bytes: int, chunk_bytes: int = image.CHUNK_BYTES,
    max_delta: int = alignment.MAX_DELTA, **options,
) -> tuple[DataFrame, DataFrame]:
    """Frame with the shifts detected for each image, and the table of shifts."""
    pixel_width = width_bytes // image.BYTES_PER_PIXEL
    cut = image.line_bytes(chunks, lines, F.lit(pixel_width * image.BYTES_PER_PIXEL), chunk_bytes)
    pixels = stage(image.pixels_u16(cut, pixel_width), "pixels")
    shape = stage(image.geometry(pixels), "shape")
    deltas = stage(alignment.auto_deltas(pixels, shape, max_delta), "deltas")
    return image.frame_decode(pixels, DisplayMode.COLOR, shape=shape, deltas=deltas, **options), deltas
