"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logicspark import CsPolarity, StrobeMode  # noqa: E402
from logicspark.operators import parallel, signal, spi  # noqa: E402
from logicspark.plans import jobs  # noqa: E402
from workload import fixtures as fx  # noqa: E402
from workload import queries as q  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REGISTERED = [
    "spi_word", "spi_word_bytes", "cs_window_clock", "asof_level", "edge_runs", "run_bounds", "bit_unpack", "probe_bit",
    "strobe_trigger_any", "parallel_word", "parallel_word_level", "control_state", "enable_asof", "session_asof",
    "controlled_capture", "describe_command", "register_snapshot", "capture_durations", "register_dump",
    "row_shift_compose", "frame_decode", "normalized_corr", "auto_deltas", "box_downsample", "scan_image",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(df: DataFrame) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def count_work(spark: SparkSession, work: dict, name: str, run) -> float:
    """Seconds of ``run``; its tasks and shuffle megabytes go into ``work``."""
    before = tasks_and_shuffle(spark)
    seconds = run()
    after = tasks_and_shuffle(spark)
    work[name] = {"tasks": after[0] - before[0], "shuffle_mb": round((after[1] - before[1]) / 1e6, 1)}
    return seconds


def timed_query(spark: SparkSession, name: str) -> float:
    start = time.time()
    q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.time() - start


def tasks_and_shuffle(spark: SparkSession) -> tuple[int, int]:
    """Tasks run and shuffle bytes written by this session so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    each = [executors.apply(i) for i in range(executors.size())]
    return sum(e.completedTasks() for e in each), sum(e.totalShuffleWrite() for e in each)


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}
    work: dict[str, dict[str, int]] = {}
    folder = tempfile.mkdtemp(prefix="spark-")

    def stored(name: str, df: DataFrame) -> DataFrame:
        """Fixture written before the clock starts, in enough files for every core."""
        df.repartition(4 * int(CPUS)).write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lines = {k: stored(k, v) for k, v in fx.waveform(spark, SF_DIR, "orders").items()}
    blocks = stored("blocks", q.blocks(spark, SF_DIR))
    wave = stored("wave", fx.waveform_blocks(spark, SF_DIR))
    wave_samples = wave.agg(F.sum("num_samples")).collect()[0][0]
    clock_rows, frame_count = lines["clk"].count(), lines["cs"].count() // 2
    samples = blocks.agg(F.sum("num_samples")).collect()[0][0]
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()

    t = seconds["decode_words_orders"] = count_work(
        spark, work, "decode_words_orders",
        lambda: timed(spi.spi_words(lines["clk"], lines["cs"], lines["mosi"], bits_per_word=24)),
    )
    rates["spi_words_per_s"], rates["clock_runs_per_s"] = frame_count / t, clock_rows / t
    t = seconds["decode_words_blocks"] = count_work(
        spark, work, "decode_words_blocks", lambda: timed(jobs.spi_decode(wave, cs=0, clk=1, mosi=2))
    )
    rates["spi_words_per_s_from_blocks"], rates["spi_samples_per_s"] = frame_count / t, wave_samples / t
    t = seconds["edge_runs_blocks"] = timed(signal.edge_runs(blocks))
    rates["edge_run_samples_per_s"] = samples / t
    t = seconds["bus_words_blocks"] = timed(
        parallel.parallel_words(
            blocks, strobe=q.STROBE, data=q.DATA, cs=q.CS, mode=StrobeMode.ANY, polarity=CsPolarity.ACTIVE_LOW
        )
    )
    rates["bus_samples_per_s"] = samples / t
    for name in REGISTERED:
        seconds[name] = count_work(spark, work, name, lambda name=name: timed_query(spark, name))
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "rates": {k: round(v) for k, v in rates.items()},
                "work": work,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
