"""Readers of command logs, line-clock tables and capture bodies."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from logicspark.functions.scalar import parse_hex
from logicspark.schemas import LINE_RECORD_COLUMNS, fields
from logicspark.sources.capture import list_files, name_below, open_file, root_folder

BODY_BYTES = fields(image_id="string", byte_index="bigint", byte="int")


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def companion_path(body_path: Column) -> Column:
    """Line-clock table that belongs to a capture body."""
    return F.regexp_replace(body_path, r"^(.*?)(\.[^./]*)?$", "$1_tgck.csv")


def _common_root(path: str | list[str]) -> str:
    roots = [root_folder(p) for p in ([path] if isinstance(path, str) else path)]
    return roots[0] if len(set(roots)) == 1 else os.path.commonpath(roots)


def file_name_below(root: str) -> Column:
    """Name of the row's file below ``root``, without extension."""
    full = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    below = F.substring_index(full, root.rstrip("/") + "/", -1) if root else F.element_at(F.split(full, "/"), -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def file_order() -> Column:
    """BIGINT that rises with a row's place in its file.

    The start of the row's split plus its number in the scan task. A file of several splits has each full one in a
    task of its own, and a split has fewer rows than bytes, so numbers of later splits are larger."""
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + number


LOG_COLUMNS = ("id", "time_text", "mosi_text")


def _with_heading(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV rows as text, the heading taken from the first file that is not empty: inferring it lists every file again."""
    read = spark.read.option("header", True).option("mode", "PERMISSIVE")
    for one in [path] if isinstance(path, str) else path:
        if "://" in one.removeprefix("file://"):
            break
        first = next((f for f, size in list_files(one) if size and os.path.basename(f)[0] not in "._"), None)
        if first is not None:
            names = spark.read.option("header", True).csv(glob.escape(first)).columns
            return read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return read.csv(path)


def read_log_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV rows of command logs as text: (log_id, seq, id, time_text, mosi_text, further columns as they are named).

    ``seq`` is the row's place in the file; the log's own running id does not count, as it may be missing or repeat.
    ``log_id`` is the file's path below the folder read. The logs of one call share a heading; names of its first three
    columns are kept as metadata ``heading`` of the columns here."""
    raw = _with_heading(spark, path)
    names = raw.columns
    if len(names) < len(LOG_COLUMNS):
        raise ValueError(f"a command log has at least three columns, got {names}")
    known = [F.col(f"`{n}`").alias(k, metadata={"heading": n}) for n, k in zip(names, LOG_COLUMNS)]
    return raw.select(
        file_name_below(_common_root(path)).alias("log_id"),
        file_order().alias("seq"),
        *known,
        *[F.col(f"`{n}`") for n in names[len(LOG_COLUMNS) :]],
    )


def read_commands(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(log_id, seq, time_ns, mosi) with ``seq`` in file order. Short rows are skipped, a bad value fails the job."""
    d = read_log_rows(spark, path).filter(F.col("mosi_text").isNotNull())
    time = F.trim("time_text").try_cast("double")
    mosi = parse_hex(F.trim("mosi_text"))

    def sure(value: Column, text: str, kind: str) -> Column:
        return F.when(value.isNotNull(), value).otherwise(
            F.raise_error(F.concat(F.lit("bad value in command log: "), F.coalesce(text, F.lit("")))).cast(kind)
        )

    return d.select(
        "log_id", "seq", sure(time, "time_text", "double").alias("time_ns"), sure(mosi, "mosi_text", "bigint").alias("mosi")
    )


def read_log_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Text rows of all logs of a folder but the annotated and register outputs."""
    rows = read_log_rows(spark, f"{folder}/*.csv")
    return rows.filter(~F.col("log_id").contains("_annotated") & ~F.col("log_id").contains("_spi"))


def read_line_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Line-clock tables: (image_id, seq, rising_timestamp, falling_byte_index), ``seq`` in file order.

    The third column is the line start; rows in which it is unreadable are skipped, whatever the others hold. A table
    with fewer than two lines gives nothing."""
    columns = T.StructType([T.StructField(n, T.StringType()) for n in LINE_RECORD_COLUMNS])
    rows = (
        spark.read.schema(columns)
        .csv(path, header=True, enforceSchema=True)
        .select(
            F.regexp_replace(file_name_below(_common_root(path)), "_tgck$", "").alias("image_id"),
            file_order().alias("seq"),
            F.trim("rising_timestamp").try_cast("bigint").alias("rising_timestamp"),
            F.when(F.trim("falling_byte_index").rlike(r"^\+?[0-9]+$"), F.trim("falling_byte_index").try_cast("bigint")).alias(
                "falling_byte_index"
            ),
        )
        .filter(F.col("falling_byte_index").isNotNull())
    )
    enough = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2").drop("__n")
    return rows.join(enough, "image_id", "left_semi")


_CHUNK = pa.schema([("image_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary())])


#: Bytes of bodies that a task reads, and what opening a file counts as, so that small bodies share a task.
TASK_BYTES, OPEN_BYTES = 1 << 22, 1 << 15


@dataclass
class _Range:
    """Chunks ``first`` to ``last`` - 1 of a body, and its files by the byte each begins at."""

    image_id: str
    files: list[tuple[int, str, int]]
    first: int
    last: int


@dataclass
class _Ranges(InputPartition):
    ranges: list[_Range]


def _chunk_rows(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)


class BodySource(DataSource):
    """Capture bodies in chunks of option ``chunk_bytes``; a task reads its own byte ranges, whatever the file sizes.

    A body is ``<name>.bin``, or the files ``<name>.bin.part-<first byte>`` of a body written in parts. Option
    ``chunks_per_partition`` sets the length of a range. Short ranges share a task, up to ``TASK_BYTES``."""

    @classmethod
    def name(cls) -> str:
        return "capture_body"

    def schema(self) -> T.StructType:
        return fields(image_id="string", chunk_no="bigint", data="binary")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BodyReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        from logicspark.sources.sinks import BodyWriter

        return BodyWriter(self.options, overwrite)


class _BodyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options["chunk_bytes"])
        self.per = int(options.get("chunks_per_partition", "8"))

    def partitions(self):
        root, bodies = root_folder(self.path), {}
        for path, size in list_files(self.path):
            found = re.fullmatch(r"(.*\.bin)(?:\.part-([0-9]+))?", path)
            if found:
                bodies.setdefault(name_below(found[1], root), []).append((int(found[2] or 0), path, size))
        tasks, bytes_ = [[]], 0
        for name, files in sorted(bodies.items()):
            files.sort()
            total = max(first + size for first, _, size in files)
            chunks = max(1, -(-total // self.chunk))
            for k in range(0, chunks, self.per):
                last = min(chunks, k + self.per)
                held = [x for x in files if x[0] < last * self.chunk and x[0] + x[2] > k * self.chunk]
                cost = (last - k) * self.chunk + len(held) * OPEN_BYTES
                if tasks[-1] and bytes_ + cost > TASK_BYTES:
                    tasks.append([])
                    bytes_ = 0
                tasks[-1].append(_Range(name, held, k, last))
                bytes_ += cost
        return [_Ranges(t) for t in tasks]

    def read(self, partition):
        rows, bytes_ = [], 0
        for part in partition.ranges:
            for chunk in range(part.first, part.last):
                begin, end, data = chunk * self.chunk, (chunk + 1) * self.chunk, []
                for first, path, size in part.files:
                    low, high = max(begin, first), min(end, first + size)
                    if low < high:
                        with open_file(path) as f:
                            f.seek(low - first)
                            data.append(f.read(high - low))
                rows.append((part.image_id, chunk, b"".join(data)))
                bytes_ += len(rows[-1][2])
                if bytes_ >= TASK_BYTES:
                    yield _chunk_rows(rows)
                    rows, bytes_ = [], 0
        if rows:
            yield _chunk_rows(rows)


def read_body_chunks(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """Capture bodies (file, glob or folder) as (image_id, chunk_no, data), in chunks of any size.

    ``image_id`` is the body's path below the folder read, so bodies of several captures stay apart."""
    spark.dataSource.register(BodySource)
    return spark.read.format("capture_body").option("chunk_bytes", chunk_bytes).load(path)


def body_bytes(chunks: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per byte of a body: (image_id, byte_index, byte)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], np.uint8)
                at = np.arange(len(data), dtype=np.int64) + row["chunk_no"] * chunk_bytes
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(row["image_id"], len(data)), pa.array(at), pa.array(data.astype(np.int32))],
                    names=BODY_BYTES.names,
                )

    return chunks.select("image_id", "chunk_no", "data").mapInArrow(unpack, BODY_BYTES)
