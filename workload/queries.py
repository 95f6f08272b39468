"""Every registered query: (spark, sf_dir) -> DataFrame over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logicspark import CsPolarity, DisplayMode, SpiMode, StrobeMode
from logicspark.functions import scalar
from logicspark.operators import alignment, control, image, parallel, registers, sessions, signal, spi
from logicspark.operators.ordered import asof_state
from logicspark.plans import jobs
from logicspark.sources import capture, sinks, tables
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

T = 1 << 20  # bucket width for 1000 ns per event
P = 1 << 14  # bucket width for 10 ns per event
S = 1 << 11  # bucket width for sequence numbers
CS, CLK, MOSI, MISO, STROBE, DATA = 8, 7, 6, 5, 10, list(range(8))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_int(*names: str) -> list[Column]:
    return [F.col(n).cast("int").alias(n) for n in names]


def blocks(spark: SparkSession, sf: str, step: int = fx.STEP_NS) -> DataFrame:
    return signal.pack_levels(fx.levels(spark, sf), fx.SAMPLES_PER_BLOCK, step)


def whole_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Block table of the capture with everything, written once: the job reads it for every line."""
    return jobs.stage(signal.pack_levels(fx.whole_capture(spark, sf), 1024, 1000), "blocks")


def line(spark: SparkSession, sf: str, channel: int, step: int = fx.STEP_NS) -> DataFrame:
    """Runs of one noisy channel."""
    one = fx.levels(spark, sf).filter(F.col("channel") == channel)
    return signal.runs_from_levels(one, step, P if step == fx.STEP_NS else T)


def frames_spi(spark: SparkSession, sf: str, bits: int = 24) -> DataFrame:
    w = fx.waveform(spark, sf)
    return spi.spi_words(w["clk"], w["cs"], w["mosi"], bits_per_word=bits, width=T)


def capture_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The command log seen as decoded words of the capture."""
    return fx.commands(spark, sf).select(
        F.lit(fx.CAPTURE).alias("capture_id"), F.col("time_ns").alias("t_ns"), "mosi"
    )


def control_rows(spark: SparkSession, sf: str) -> DataFrame:
    return control.control_state(capture_commands(spark, sf), width=T)


def bus_words(spark: SparkSession, sf: str) -> DataFrame:
    return parallel.parallel_words(blocks(spark, sf, 1000), strobe=STROBE, data=DATA, mode=StrobeMode.ANY)


def capture_job(spark: SparkSession, sf: str) -> jobs.ControlledCapture:
    """Sessions of the noisy bus under the command log; every step is written once."""
    return jobs.controlled_capture(
        blocks(spark, sf, 1000), fx.line_clock(spark, sf), fx.blocky_commands(spark, sf),
        strobe=STROBE, data=DATA, mode=StrobeMode.ANY, width=T,
    )


# --- serial --------------------------------------------------------------------


@query
def cs_windows(spark, sf):
    w = fx.waveform(spark, sf)
    return spi.cs_windows(w["cs"], width=T).select("a", "b", "pb")


@query
def cs_active(spark, sf):
    w = fx.waveform(spark, sf)
    v = F.col("value")
    return w["cs"].select(
        "start_time",
        spi.cs_active(v, CsPolarity.ACTIVE_LOW).cast("int").alias("low"),
        spi.cs_active(v, CsPolarity.ACTIVE_HIGH).cast("int").alias("high"),
        spi.cs_active(v, CsPolarity.DISABLED).cast("int").alias("none"),
    )


@query
def spi_word(spark, sf):
    return frames_spi(spark, sf).select("window_id", "word_no", "mosi", "miso", "t_ns", "timestamp_us")


@query
def spi_word_blocks(spark, sf):
    """The round trip from packed blocks, over all orders."""
    packed = jobs.stage(fx.waveform_blocks(spark, sf), "blocks")
    d = jobs.spi_decode(packed, cs=0, clk=1, mosi=2, width=T)
    return d.select("window_id", "word_no", "mosi", "miso", "t_ns")


@query
def spi_word_bytes(spark, sf):
    return frames_spi(spark, sf, 8).select("window_id", "word_no", "mosi", "t_ns")


def _noisy_words(mode: SpiMode, polarity: CsPolarity, bits: int) -> Query:
    def run(spark, sf):
        return spi.spi_words(
            line(spark, sf, CLK), line(spark, sf, CS), line(spark, sf, MOSI), line(spark, sf, MISO),
            bits_per_word=bits, mode=mode, polarity=polarity, width=P,
        ).select("window_id", "word_no", "mosi", "miso", "t_ns")

    return run


QUERIES["spi_word_noise_rising"] = _noisy_words(SpiMode.MODE0, CsPolarity.ACTIVE_HIGH, 1)
QUERIES["spi_word_noise_falling"] = _noisy_words(SpiMode.MODE1, CsPolarity.ACTIVE_LOW, 1)
QUERIES["spi_word_noise_pairs"] = _noisy_words(SpiMode.MODE0, CsPolarity.ACTIVE_HIGH, 2)


@query
def spi_sampling_edge(spark, sf):
    w = fx.waveform(spark, sf)
    return spi.sampling_edges(w["clk"], w["cs"], mode=SpiMode.MODE1, width=T).select("a", "t")


@query
def bit_index(spark, sf):
    w = fx.waveform(spark, sf)
    return spi.bit_index(w["clk"], w["cs"], width=T).select("a", "t", "bit_no")


@query
def cs_window_clock(spark, sf):
    d = spi.cs_window_clock(line(spark, sf, CLK), line(spark, sf, CS), width=P)
    return d.select("a", "b", "t", *as_int("value"))


@query
def clock_prev_carry(spark, sf):
    d = spi.cs_window_clock(line(spark, sf, CLK), line(spark, sf, CS), width=P)
    return d.select("a", "t", *as_int("value", "previous"))


@query
def asof_level(spark, sf):
    probe = line(spark, sf, CLK).select("capture_id", F.greatest(F.col("start_time") - 1, F.lit(0)).alias("t"))
    return signal.asof_level(probe, line(spark, sf, MOSI), "t", width=P).select("t", *as_int("level"))


@query
def spi_csv_sink(spark, sf):
    from logicspark.sources.sinks import spi_csv_rows

    return spi_csv_rows(frames_spi(spark, sf), width=T)


@query
def spi_show(spark, sf):
    from logicspark.sources.sinks import spi_show_rows

    return spi_show_rows(frames_spi(spark, sf), 100)


@query
def limit_n(spark, sf):
    from logicspark.sources.sinks import first_words

    return first_words(frames_spi(spark, sf), 50).select("t_ns", "mosi")


@query
def first_words_each(spark, sf):
    """The first ten bus words of every capture."""
    words = parallel.parallel_words(fx.archived(spark, sf), strobe=STROBE, data=DATA, mode=StrobeMode.ANY)
    return sinks.first_words_each(words, 10, width=P).select("capture_id", "t_ns", "value")


# --- signal --------------------------------------------------------------------


@query
def edge_runs(spark, sf):
    return signal.edge_runs(blocks(spark, sf)).select("channel", "start_time", *as_int("value"))


@query
def run_bounds(spark, sf):
    runs = signal.edge_runs(blocks(spark, sf))
    return signal.run_bounds(runs, width=P).select("channel", "start_time", "next_start", *as_int("value"))


@query
def edge_detect(spark, sf):
    runs = signal.edge_runs(blocks(spark, sf))
    return signal.edge_detect(runs, width=P).select("channel", "start_time", *as_int("rising", "falling"))


@query
def bit_unpack(spark, sf):
    return signal.unpack_bits(blocks(spark, sf)).select("channel", "position", *as_int("value"))


@query
def packed_blocks(spark, sf):
    return blocks(spark, sf).select(
        "channel", "block_num", F.hex("data").alias("data_hex"), "start_position", "num_samples", "timestamp_step"
    )


@query
def block_bounds(spark, sf):
    return signal.block_bounds(blocks(spark, sf)).select(
        "channel", "block_num", "start_position", "end_position", "start_ns", "end_ns"
    )


@query
def bounded_scan(spark, sf):
    capped = signal.bound_blocks(blocks(spark, sf), 1500)
    return signal.unpack_bits(capped).select("channel", "position", *as_int("value"))


@query
def channel_projection(spark, sf):
    kept = signal.project_channels(blocks(spark, sf), [2, 5, 11], total_probes=fx.CHANNELS)
    return signal.edge_runs(kept).select("channel", "start_time", *as_int("value"))


@query
def run_counter(spark, sf):
    return signal.count_runs(signal.edge_runs(blocks(spark, sf)), 3000).select("channel", "n_runs")


def _facts(spark, sf) -> DataFrame:
    """Header row of the fixture capture."""
    return fx.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total_samples")).select(
        F.lit(fx.CAPTURE).alias("capture_id"),
        F.lit(fx.CHANNELS).alias("total_probes"),
        "total_samples",
        F.ceil(F.col("total_samples") / fx.SAMPLES_PER_BLOCK).alias("total_blocks"),
        F.lit(fx.SAMPLES_PER_BLOCK).cast("bigint").alias("samples_per_block"),
    )


@query
def probe_bit(spark, sf):
    keys = fx.table(spark, sf, "events").select(
        F.lit(fx.CAPTURE).alias("capture_id"),
        (F.col("user_id") % 14).cast("int").alias("channel"),
        (F.col("event_id") * 3 - F.col("user_id") % 5).alias("position"),
    )
    return signal.probe_bits(blocks(spark, sf), _facts(spark, sf), keys).select("channel", "position", "status", "bit")


@query
def block_align(spark, sf):
    d = parallel.align_blocks(blocks(spark, sf), [0, 3, 9])
    return d.select(
        "block_num", "start_position", "num_samples",
        *[F.hex(F.element_at("channels", F.lit(c))).alias(f"c{c}") for c in (0, 3, 9)],
    )


# --- parallel ------------------------------------------------------------------


def _strobe(mode: StrobeMode) -> Query:
    return lambda spark, sf: parallel.strobe_triggers(blocks(spark, sf), STROBE, mode).select("position", "t_ns")


for _mode in StrobeMode:
    QUERIES[f"strobe_trigger_{_mode.value}"] = _strobe(_mode)


@query
def cs_inactive_gate(spark, sf):
    b = blocks(spark, sf)
    hits = parallel.strobe_triggers(b, STROBE, StrobeMode.RISING)
    return parallel.cs_inactive_gate(hits, b, CS, CsPolarity.ACTIVE_LOW).select("position")


@query
def parallel_word(spark, sf):
    return parallel.parallel_words(
        blocks(spark, sf), strobe=STROBE, data=DATA, cs=CS, mode=StrobeMode.ANY, polarity=CsPolarity.ACTIVE_LOW
    ).select("position", "value", "t_ns", "timestamp_us")


@query
def parallel_word_level(spark, sf):
    return parallel.parallel_words(
        blocks(spark, sf), strobe=STROBE, data=[11, 9, 4], cs=CS, mode=StrobeMode.HIGH, polarity=CsPolarity.ACTIVE_HIGH
    ).select("position", "value")


# --- control and sessions ------------------------------------------------------


@query
def command_match(spark, sf):
    return fx.commands(spark, sf).select("seq", control.command_match(F.col("mosi")).cast("int").alias("state"))


@query
def control_state(spark, sf):
    return control_rows(spark, sf).select("t_ns", *as_int("state"))


@query
def initial_state_union(spark, sf):
    c = capture_commands(spark, sf)
    both = control.initial_state(c).unionByName(control.state_changes(c, width=T))
    return both.select("t_ns", *as_int("state"))


@query
def state_monitor(spark, sf):
    return control.state_monitor(control_rows(spark, sf)).select("t_ns", "report")


@query
def command_monitor(spark, sf):
    return control.command_monitor(capture_commands(spark, sf)).select("t_ns", "mosi", "report")


@query
def enable_asof(spark, sf):
    hits = parallel.strobe_triggers(blocks(spark, sf, 1000), STROBE, StrobeMode.ANY)
    return parallel.enable_asof(hits, control_rows(spark, sf), width=T).select("t_ns", *as_int("enabled"))


@query
def enable_gate(spark, sf):
    return parallel.enable_gate(bus_words(spark, sf), control_rows(spark, sf), width=T).select("t_ns", "value")


@query
def session_asof(spark, sf):
    return sessions.session_asof(bus_words(spark, sf), control_rows(spark, sf), width=T).select("t_ns", "enabled_at")


@query
def session_id(spark, sf):
    return capture_job(spark, sf).words.select("t_ns", "value", "file_num")


@query
def byte_index(spark, sf):
    return capture_job(spark, sf).words.select("file_num", "byte_index", "t_ns")


@query
def session_summary(spark, sf):
    return sessions.session_summary(capture_job(spark, sf).words).drop("capture_id")


@query
def capture_index(spark, sf):
    return capture_job(spark, sf).index.drop("capture_id")


@query
def capture_body_sink(spark, sf):
    """Bodies as byte chunks, one session after another (what the sink writes)."""
    from logicspark.sources.sinks import body_chunks

    return body_chunks(capture_job(spark, sf).words, 64).select("file_num", "chunk_no", F.hex("data").alias("data_hex"))


@query
def line_edge_to_word(spark, sf):
    return capture_job(spark, sf).edges.select("file_num", "edge_t", "byte_index", "clock_t", *as_int("rising"))


@query
def line_records(spark, sf):
    return capture_job(spark, sf).records.drop("capture_id")


@query
def line_width(spark, sf):
    return sessions.line_width(capture_job(spark, sf).records, width=T).drop("capture_id")


@query
def line_offsets(spark, sf):
    return sessions.line_offsets(capture_job(spark, sf).records, width=T).drop("capture_id")


@query
def controlled_capture_blocks(spark, sf):
    """The whole job from one block table: serial decode, control, bus words, sessions, lines, index."""
    job = jobs.capture_job(
        whole_blocks(spark, sf), cs=fx.SERIAL_CS, clk=fx.SERIAL_CLK, mosi=fx.SERIAL_MOSI, line_clock=fx.LINE_CLOCK,
        strobe=STROBE, data=DATA, width=T,
    )
    return job.index.drop("capture_id")


@query
def controlled_capture(spark, sf):
    """The composed job: serial commands on one side gate and split the bus words."""
    job = jobs.controlled_capture(
        blocks(spark, sf, 1000), fx.line_clock(spark, sf), fx.blocky_commands(spark, sf),
        strobe=STROBE, data=[11, 9, 4], cs=CS, mode=StrobeMode.RISING, polarity=CsPolarity.ACTIVE_LOW, width=T,
    )
    return job.index.select("file_num", "bytes", "width", "start_pos", "end_pos")


# --- registers -----------------------------------------------------------------


@query
def decode_command(spark, sf):
    return registers.decode_command(fx.commands(spark, sf)).select("seq", *as_int("is_read"), "register", "value")


@query
def describe_command(spark, sf):
    return registers.describe_commands(fx.commands(spark, sf)).select("seq", "description")


@query
def describe_command_dense(spark, sf):
    """Every rule of the description is reached: registers and values are folded down."""
    d = fx.commands(spark, sf).select(
        "seq",
        F.expr("(seq % 256) * 65536 + case seq % 7 when 0 then 65535 when 1 then 0 when 2 then 526 when 3 then 49152 + seq % 255 when 4 then 129 when 5 then 256 else seq % 65536 end").alias("mosi"),
    )
    return registers.describe_commands(d).select("seq", "mosi", "description")


@query
def decode_gain(spark, sf):
    d = registers.decode_command(fx.commands(spark, sf))
    text = registers.decode_gain(F.lit(0x78) + F.col("register") % 4, F.col("value"), F.col("is_read"))
    return d.select("seq", text.alias("gain_text"))


@query
def register_names(spark, sf):
    return registers.register_names(registers.decode_command(fx.commands(spark, sf))).select("seq", "register_name")


@query
def special_commands(spark, sf):
    return registers.special_commands(fx.commands(spark, sf)).select("seq", "special")


@query
def bad_command_text(spark, sf):
    text = (
        F.when(F.col("seq") % 11 == 0, F.lit("zz"))
        .when(F.col("seq") % 11 == 1, F.lit(None))
        .when(F.col("seq") % 11 == 2, F.concat(F.lit("0x"), F.hex("mosi")))
        .otherwise(F.format_string("%06X", "mosi"))
    )
    d = fx.commands(spark, sf).select("seq", text.alias("field"))
    return registers.describe_text(d, "field").select("seq", "description")


@query
def register_write_filter(spark, sf):
    return registers.register_writes(fx.commands(spark, sf)).select("seq", "register", "value")


@query
def register_state(spark, sf):
    return registers.register_state(registers.register_writes(fx.commands(spark, sf))).select("register", "value")


@query
def enable_number(spark, sf):
    return registers.enables(fx.commands(spark, sf), width=S).select("seq", "enable_num")


def _snapshots(spark, sf) -> DataFrame:
    c = fx.commands(spark, sf)
    return registers.register_snapshots(registers.register_writes(c), registers.enables(c, width=S), width=S)


@query
def register_snapshot(spark, sf):
    return _snapshots(spark, sf).select("enable_num", "time_ns", "register", "value")


@query
def snapshot_size(spark, sf):
    c = fx.commands(spark, sf)
    d = registers.snapshot_sizes(registers.register_writes(c), registers.enables(c, width=S), width=S)
    return d.select("enable_num", F.col("registers").cast("bigint").alias("registers"))


@query
def capture_durations(spark, sf):
    return registers.capture_durations(fx.commands(spark, sf), width=S).select("enable_num", "duration_ns")


@query
def longest_capture(spark, sf):
    return registers.longest_capture(registers.capture_durations(fx.commands(spark, sf), width=S)).drop("log_id")


def _picked(commands: DataFrame, **choice) -> DataFrame:
    """Registers before the chosen enable of the log."""
    chosen = registers.snapshot_pick(registers.enables(commands, width=S), **choice)
    return registers.snapshot_before(registers.register_writes(commands), chosen)


@query
def snapshot_pick(spark, sf):
    c = fx.commands(spark, sf)
    durations = registers.capture_durations(c, width=S)
    return _picked(c, durations=durations).select("enable_num", "register", "value")


@query
def ordered_registers(spark, sf):
    picked = _picked(fx.commands(spark, sf), capture_num=3)
    return registers.ordered_registers(picked).select("register", "value")


@query
def register_csv_sink(spark, sf):
    from logicspark.sources.sinks import register_csv_rows

    picked = _picked(fx.commands(spark, sf), capture_num=5)
    return register_csv_rows(picked).select("register", "value_hex", "value_dec")


@query
def register_dump(spark, sf):
    """The composed job: command log to the register table of the longest capture."""
    return jobs.register_dump(fx.commands(spark, sf), width=S).select("register", "value_hex", "value_dec")


# --- image ---------------------------------------------------------------------

GAIN = 1.0 / 96.0


def _shape(spark, sf) -> DataFrame:
    return image.geometry(fx.pixels(spark, sf))


@query
def pixel_u16(spark, sf):
    """Pixels to body bytes with ragged line gaps, and back."""
    chunks, lines = fx.body(spark, sf)
    cut = image.line_bytes(chunks, lines, F.lit(132), chunk_bytes=fx.BODY_CHUNK)
    return image.pixels_u16(cut, 22).select("row", "col", "g", "b", "r")


@query
def luma(spark, sf):
    d = image.gain_gamma(fx.pixels(spark, sf), GAIN)
    return d.select("row", "col", scalar.luma(F.col("r"), F.col("g"), F.col("b")).alias("lum"))


@query
def gain_gamma(spark, sf):
    return image.gain_gamma(fx.pixels(spark, sf), 1.0 / 64.0).select("row", "col", "g", "b", "r")


@query
def gain_gamma_sqrt(spark, sf):
    d = image.gain_gamma(fx.pixels(spark, sf), 1.0 / 128.0, gamma=True)
    return d.select("row", "col", "g", "b", "r")


@query
def pack_rgb(spark, sf):
    d = image.gain_gamma(fx.pixels(spark, sf), GAIN)
    return d.select("row", "col", scalar.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))


@query
def unpack_rgb(spark, sf):
    d = fx.pixels(spark, sf).withColumn("rgb", (F.col("g") * 251 + F.col("b") * 7) % 16777216)
    c = F.col("rgb")
    return d.select(
        "row", "col", scalar.red_of(c).alias("r"), scalar.green_of(c).alias("g"), scalar.blue_of(c).alias("b")
    )


@query
def channel_toggle(spark, sf):
    return image.channel_toggle(fx.pixels(spark, sf), show_g=False).select("row", "col", "g", "b", "r")


@query
def row_shift_compose(spark, sf):
    d = image.row_shift_compose(fx.pixels(spark, sf), 3, 5, _shape(spark, sf))
    return d.select("row", "col", "g", "b", "r")


@query
def frame_decode(spark, sf):
    d = image.frame_decode(
        fx.pixels(spark, sf), DisplayMode.COLOR, bg_delta=-2, gr_delta=4, show_g=True, gain=GAIN, shape=_shape(spark, sf)
    )
    return d.select("row", "col", "rgb")


@query
def frame_decode_gray(spark, sf):
    return image.frame_decode(fx.pixels(spark, sf), DisplayMode.GRAYSCALE, gain=GAIN).select("row", "col", "rgb")


def _means(spark, sf) -> DataFrame:
    return alignment.row_means(fx.pixels(spark, sf), _shape(spark, sf))


def _profile(spark, sf, plane: str, max_delta: int) -> DataFrame:
    derivative = alignment.row_derivative(_means(spark, sf))
    return alignment.correlated(alignment.lag_sums(derivative, [plane], max_delta)).drop("plane")


@query
def row_means(spark, sf):
    return _means(spark, sf).select("row", *[F.round(p, 6).alias(p) for p in "gbr"])


@query
def row_derivative(spark, sf):
    return alignment.row_derivative(_means(spark, sf)).select("row", *[F.round(p, 6).alias(p) for p in "gbr"])


@query
def lag_profile(spark, sf):
    d = alignment.lag_profile(alignment.row_derivative(_means(spark, sf)), "b", 4)
    return d.select("delta", "row", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query
def normalized_corr(spark, sf):
    return _profile(spark, sf, "r", 80).select("delta", "n", F.round("corr", 6).alias("corr"))


@query
def best_delta(spark, sf):
    d = alignment.best_delta(_profile(spark, sf, "b", 80), _shape(spark, sf))
    return d.select("delta", F.round("corr", 6).alias("corr"))


@query
def top5_corr(spark, sf):
    d = alignment.top_corr(_profile(spark, sf, "b", 80))
    return d.select("rank", "delta", F.round("corr", 6).alias("corr"))


@query
def auto_deltas(spark, sf):
    d = alignment.auto_deltas(fx.pixels(spark, sf), _shape(spark, sf))
    return d.select("bg_delta", F.round("bg_corr", 6).alias("bg_corr"), "gr_delta", F.round("gr_corr", 6).alias("gr_corr"))


OUT = image.Viewport(22, 8, 90, scroll_row=2.0, scroll_col=0.0, zoom=1.0)
IN = image.Viewport(22, 88, 60, scroll_row=3.0, scroll_col=1.0, zoom=2.0)


def _frame(spark, sf) -> DataFrame:
    return image.frame_decode(fx.pixels(spark, sf), DisplayMode.COLOR, gain=GAIN)


@query
def viewport_bins(spark, sf):
    return image.viewport_bins(_frame(spark, sf), OUT).select("row", "col", "dy", "dx")


@query
def box_downsample(spark, sf):
    return image.box_downsample(_frame(spark, sf), _shape(spark, sf), OUT).select("dy", "dx", "rgb")


@query
def nearest_upsample(spark, sf):
    return image.nearest_upsample(_frame(spark, sf), _shape(spark, sf), IN).select("dy", "dx", "rgb")


@query
def scan_image(spark, sf):
    """The composed job: body bytes and lines to an aligned colour frame."""
    chunks, lines = fx.body(spark, sf)
    d = jobs.scan_image(
        chunks, lines, width_bytes=132, chunk_bytes=fx.BODY_CHUNK, bg_delta=1, gr_delta=2, gain=GAIN
    )
    return d.select("row", "col", "rgb")


# --- scalars -------------------------------------------------------------------


@query
def parse_sample_rate(spark, sf):
    d = fx.table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.col("user_id").cast("string"),
            F.element_at(F.array(*map(F.lit, [" MHz", " GHz", " KHz", " kHz", " Hz", " mhz", "", "x MHz", ".5 MHz"])),
                         (F.col("event_id") % 9 + 1).cast("int")),
        ).alias("text"),
    )
    return d.select("event_id", "text", scalar.parse_sample_rate(F.col("text")).alias("hz"))


@query
def ns_to_us(spark, sf):
    return fx.commands(spark, sf).select("seq", scalar.ns_to_us(F.col("time_ns") + F.col("seq") % 1000).alias("us"))


@query
def parse_hex(spark, sf):
    c = fx.commands(spark, sf).select(
        "seq", F.concat(F.element_at(F.array(F.lit(""), F.lit("0x"), F.lit("0X"), F.lit("g")), (F.col("seq") % 4 + 1).cast("int")),
                        F.lower(F.hex("mosi"))).alias("text"))
    return c.select("seq", scalar.parse_hex(F.col("text")).alias("number"))


@query
def format_hex(spark, sf):
    c = registers.decode_command(fx.commands(spark, sf))
    return c.select(
        "seq", scalar.format_hex(F.col("register"), 2).alias("h2"), scalar.format_hex(F.col("value"), 4).alias("h4"),
        scalar.format_hex(F.col("mosi"), 6, "0x").alias("h6"),
    )


@query
def capture_stats(spark, sf):
    from logicspark.sources.capture import capture_stats as stats

    header = _facts(spark, sf).withColumns(
        {
            "samplerate": F.lit("100 MHz"), "samplerate_hz": F.lit(1e8), "sample_period": F.lit(1.0) / F.lit(1e8),
            "probe_names": F.array(),
        }
    )
    return stats(header).select("total_probes", "total_samples", "samplerate_hz", "sample_period",
                                F.round("duration_s", 9).alias("duration_s"))


@query
def asof_forward(spark, sf):
    """First control change at or after each trigger."""
    hits = parallel.strobe_triggers(blocks(spark, sf, 1000), STROBE, StrobeMode.RISING)
    d = asof_state(
        hits, control_rows(spark, sf), ["capture_id"], probe_time="t_ns", state_time="t_ns",
        values={"next_change": "t_ns"}, forward=True, width=T,
    )
    return d.select("t_ns", "next_change")


# --- files written and read back ----------------------------------------------


def _archives(spark: SparkSession, sf: str) -> str:
    """The noisy channels as archives of several captures, two levels deep; the folder."""
    folder = fx.shared_path(spark, "archives")
    fx.write_archives(fx.archived(spark, sf), folder)
    return folder


@query
def capture_header(spark, sf):
    header = capture.read_capture(spark, _archives(spark, sf) + "/*/*.zip").header
    return capture.capture_stats(header).select(
        "capture_id", "total_probes", "samplerate", "total_samples", "total_blocks", "samples_per_block",
        F.get("probe_names", F.lit(3)).alias("probe3"), F.round("duration_s", 9).alias("duration_s"),
    )


@query
def archive_blocks(spark, sf):
    opened = capture.read_capture(spark, _archives(spark, sf) + "/*/*.zip", bytes_per_partition=20_000).blocks
    return opened.select(
        "capture_id", "channel", "block_num", F.hex("data").alias("data_hex"), "start_position", "num_samples", "timestamp_step", "first", "last"
    )


@query
def archive_aligned(spark, sf):
    """Bus words straight from an archive, without a shuffle."""
    opened = capture.read_aligned(spark, _archives(spark, sf) + "/*/*.zip", [STROBE, CS, *DATA], bytes_per_partition=20_000)
    return parallel.decode_aligned(
        opened, strobe=STROBE, data=DATA, cs=CS, mode=StrobeMode.ANY, polarity=CsPolarity.ACTIVE_LOW
    ).select("capture_id", "position", "value", "t_ns", "timestamp_us")


def _logs(spark: SparkSession, sf: str) -> str:
    """Command logs of 1,000 lines with missing and repeated ids and a fourth column; a glob of the files."""
    folder = fx.shared_path(spark, "logs")
    cells = F.concat_ws(
        ",",
        F.when(F.col("seq") % 3 == 0, F.lit("x")).otherwise((F.col("seq") % 7).cast("string")),
        F.format_string("%d.00", "time_ns"), F.format_string("%06X", "mosi"), F.concat(F.lit("note "), F.col("seq")),
    )
    line = F.array_sort(F.collect_list(F.struct("seq", cells.alias("line"))))
    logs = fx.commands(spark, sf).groupBy(F.expr("seq div 1000").alias("log")).agg(line.alias("x"))
    text = F.concat(F.lit("Id,Time[ns],1:SPI: MOSI data,note\n"), F.array_join("x.line", "\n"), F.lit("\n"))
    zero = F.lit(0).cast("bigint")
    chunks = logs.select(
        F.concat(F.lit("log="), F.col("log")).alias("capture_id"), zero.alias("file_num"), zero.alias("chunk_no"),
        text.cast("binary").alias("data"),
    )
    sinks._write_files(chunks, folder, 1 << 23, False, ".csv")
    return folder + "/*/*.csv"


@query
def command_log_scan(spark, sf):
    got = tables.read_commands(spark, _logs(spark, sf))
    place = F.row_number().over(W.partitionBy("log_id").orderBy("seq"))
    log = F.regexp_extract("log_id", "^log=([0-9]+)/", 1).cast("bigint")
    return got.select(log.alias("log"), place.alias("place"), "time_ns", "mosi")


@query
def annotated_csv_sink(spark, sf):
    out = fx.shared_path(spark, "annotated")
    sinks.write_annotated_csv(tables.read_log_rows(spark, _logs(spark, sf)), out)
    columns = "Id string, `Time[ns]` string, `1:SPI: MOSI data` string, note string, Description string"
    back = spark.read.schema(columns).csv(out, header=True)
    return back.select(
        F.col("Id").alias("id"), F.col("`Time[ns]`").alias("time_text"), F.col("1:SPI: MOSI data").alias("mosi_text"),
        "note", F.col("Description").alias("description"),
    )


@query
def capture_body_scan(spark, sf):
    """Session bodies written in parts of 64 bytes and read in chunks of 48."""
    out = fx.shared_path(spark, "bodies")
    sinks.write_bodies(capture_job(spark, sf).words, out, chunk_bytes=64, parts=True)
    chunks = tables.read_body_chunks(spark, out + "/*/*", 48)
    number = F.regexp_extract("image_id", "capture_([0-9]+)$", 1).cast("bigint")
    return chunks.select(number.alias("file_num"), "chunk_no", F.hex("data").alias("data_hex"))
