"""Writers: word logs, session bodies and index, register and annotated tables."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from logicspark.functions.scalar import format_hex
from logicspark.operators.ordered import DEFAULT_WIDTH, order_key, running_sum
from logicspark.operators.registers import describe_text
from logicspark.schemas import LINE_RECORD_COLUMNS, fields
from logicspark.sources.tables import BodySource

BY = ["capture_id"]
CHUNK_BYTES = 1 << 23
LINES_PER_CHUNK = 1 << 16
_CHUNKS = fields(capture_id="string", file_num="bigint", chunk_no="bigint", data="binary")
_PIECES = fields(capture_id="string", file_num="bigint", chunk_no="bigint", at="binary", bytes="binary")


def first_words(words: DataFrame, n: int) -> DataFrame:
    """First ``n`` words by time over all captures; 0 keeps all."""
    ordered = words.orderBy(*BY, "t_ns")
    return ordered.limit(n) if n > 0 else ordered


def first_words_each(words: DataFrame, n: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """First ``n`` words of each capture by time; 0 keeps all. Counted in buckets, no capture is sorted in one task."""
    if n <= 0:
        return words
    numbered = running_sum(words.withColumn("__order", order_key("t_ns")), BY, "__order", {"__id": F.lit(1)}, width=width)
    return numbered.filter(F.col("__id") <= n).drop("__order", "__id")


def spi_csv_rows(words: DataFrame, n: int = 0, width: int = DEFAULT_WIDTH, keep_capture: bool = False) -> DataFrame:
    """Columns of the word log: running id, time with two decimals, six hex digits; ``n`` words of each capture.

    The id is a bucketed running count, so an unlimited log is never sorted in one task.
    """
    d = running_sum(words.withColumn("__order", order_key("t_ns")), BY, "__order", {"__id": F.lit(1)}, width=width)
    if n > 0:
        d = d.filter(F.col("__id") <= n)
    return d.select(
        *(BY if keep_capture else ()),
        F.col("__id").cast("bigint").alias("Id"),
        F.format_string("%d.00", F.col("t_ns")).alias("Time[ns]"),
        format_hex(F.col("mosi"), 6).alias("1:SPI: MOSI data"),
    )


def write_spi_csv(words: DataFrame, path: str, n: int = 0, width: int = DEFAULT_WIDTH) -> None:
    """Word logs as CSV part files in id order, one folder for each capture."""
    rows = spi_csv_rows(words, n, width, keep_capture=True)
    rows.repartitionByRange(*BY, "Id").sortWithinPartitions(*BY, "Id").write.mode("overwrite").partitionBy(*BY).csv(
        path, header=True
    )


def spi_show_rows(words: DataFrame, n: int = 100) -> DataFrame:
    """Text rows of the first ``n`` words (0 = all)."""
    return first_words(words, n).select(
        "t_ns",
        F.format_string(
            "MOSI=0x%06X MISO=0x%06X at t=%.6fs (pos=%d)",
            F.col("mosi"), F.col("miso"), F.col("timestamp_us") / 1e6, F.col("t_ns"),
        ).alias("text"),
    )


def body_chunks(session_words: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Low byte of every word as (capture_id, file_num, chunk_no, data) chunks.

    Words of a batch are packed by chunk before the shuffle. A group is one chunk, so a long session is put together by
    many tasks.
    """
    key = ["capture_id", "file_num", "chunk_no"]
    words = session_words.select(
        "capture_id", "file_num", F.expr(f"byte_index div {chunk_bytes}").alias("chunk_no"), "byte_index",
        F.coalesce(F.col("value").bitwiseAND(F.lit(0xFF)), F.lit(0)).cast("smallint").alias("byte"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            capture = batch.column("capture_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            file, chunk, at = (batch.column(c).to_numpy() for c in ("file_num", "chunk_no", "byte_index"))
            order = np.lexsort((at, chunk, file, capture))
            new = np.zeros(len(order), bool)
            for k in (capture, file, chunk):
                new[1:] |= np.diff(k[order]) != 0
            new[0] = True
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(order))
            places, bytes_ = at[order].astype("<i8"), batch.column("byte").to_numpy()[order].astype(np.uint8)
            first = batch.take(pa.array(order[starts]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(first.column(k) for k in key),
                    *(pa.array([v[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for v in (places, bytes_)),
                ],
                names=[*key, "at", "bytes"],
            )

    def assemble(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        at, bytes_ = (b"".join(pieces.column(c).to_pylist()) for c in ("at", "bytes"))
        ordered = np.frombuffer(bytes_, np.uint8)[np.argsort(np.frombuffer(at, "<i8"), kind="stable")]
        return pa.Table.from_pylist(
            [dict(zip(_CHUNKS.names, [*(k.as_py() for k in key), ordered.tobytes()], strict=True))],
            schema=pa.schema(
                [("capture_id", pa.string()), ("file_num", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary())]
            ),
        )

    return words.mapInArrow(pack, _PIECES).groupBy(*key).applyInArrow(assemble, _CHUNKS)


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task: name, byte from which the file goes on, the unpublished file."""

    files: list[tuple[str, int, str]]


class BodyWriter(DataSourceArrowWriter):
    """Writes chunks into ``<path>/<capture_id>/capture_%04d<suffix>``, on any file system that Arrow knows.

    Option ``suffix`` is ``.bin`` unless told. Chunks of a file come to one task in order, which joins them in an
    unpublished file of its own; with ``parts=true`` each chunk makes a file ``.part-<first byte>``, in any task. Commit,
    on the driver, only gives the files their names, so a repeated or failed task leaves nothing behind, and a file that
    was longer before keeps none of its old bytes. Mode ``overwrite`` drops all else below the path."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path = options["path"].rstrip("/")
        self.chunk_bytes = int(options.get("chunk_bytes", str(CHUNK_BYTES)))
        self.parts = options.get("parts", "false") == "true"
        self.suffix = options.get("suffix", ".bin")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        if "://" in self.path:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), os.path.abspath(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = self._store()
        files: list[tuple[str, int, str]] = []
        stream = None
        for batch in iterator:
            for row in batch.to_pylist():
                name = f"{row['capture_id']}/capture_{row['file_num']:04d}{self.suffix}"
                if self.parts or stream is None or files[-1][0] != name:
                    if stream is not None:
                        stream.close()
                    store.create_dir(f"{root}/_unpublished-{self.job}", recursive=True)
                    first = row["chunk_no"] * self.chunk_bytes if self.parts else 0
                    files.append((name, first, f"{root}/_unpublished-{self.job}/{uuid.uuid4().hex}"))
                    stream = store.open_output_stream(files[-1][2])
                stream.write(row["data"])
        if stream is not None:
            stream.close()
        return _Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = self._store()
        found: dict[str, list[tuple[int, str]]] = {}
        for message in messages:
            for name, first, own in message.files if message else ():
                found.setdefault(name, []).append((first, own))
        torn = [name for name, files in found.items() if not self.parts and len(files) > 1]
        if torn:
            raise ValueError(f"chunks of {torn[0]} came to several tasks or out of order")
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name != f"_unpublished-{self.job}":
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        # Each folder is listed once, however many files it has or gets.
        for folder in sorted({os.path.dirname(f"{root}/{name}") for name in found}):
            store.create_dir(folder, recursive=True)
            for old in store.get_file_info(fs.FileSelector(folder)):
                name = os.path.relpath(re.sub(r"\.part-[0-9]+$", "", f"{folder}/{old.base_name}"), root)
                if name in found:
                    store.delete_file(old.path)
        for name, files in sorted(found.items()):
            target = f"{root}/{name}"
            for first, own in sorted(files):
                store.move(own, f"{target}.part-{first:015d}" if self.parts else target)
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = self._store()
        left = f"{root}/_unpublished-{self.job}"
        if store.get_file_info(left).type == fs.FileType.Directory:
            store.delete_dir(left)


def _write_files(chunks: DataFrame, path: str, chunk_bytes: int, parts: bool, suffix: str, mode: str = "append") -> None:
    chunks.sparkSession.dataSource.register(BodySource)
    if not parts:
        chunks = chunks.repartition("capture_id", "file_num").sortWithinPartitions("capture_id", "file_num", "chunk_no")
    chunks.write.format("capture_body").options(
        chunk_bytes=chunk_bytes, parts=str(parts).lower(), suffix=suffix
    ).mode(mode).save(path)


def write_bodies(session_words: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, parts: bool = False) -> None:
    """One body per session; a session without words has no file. A body that is there already is replaced.

    Chunks are put together by many tasks; one task for each body then appends them in order, a chunk at a time. With
    ``parts`` each chunk stays a file of its own, which is the form for captures too long for one writer. The driver
    handles names only."""
    _write_files(body_chunks(session_words, chunk_bytes), path, chunk_bytes, parts, ".bin")


def line_table_chunks(records: DataFrame, lines: int = LINES_PER_CHUNK, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Text of each session's line table, heading first, in chunks of ``lines`` records in time order."""
    file = ["capture_id", "file_num"]
    ordered = records.withColumn("__order", order_key("rising_timestamp"))
    numbered = running_sum(ordered, file, "__order", {"__n": F.lit(1)}, width=width)
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in LINE_RECORD_COLUMNS])
    line = F.array_sort(F.collect_list(F.struct("__n", text.alias("line"))))
    chunks = numbered.groupBy(*file, F.expr(f"(__n - 1) div {lines}").alias("chunk_no")).agg(line.alias("__lines"))
    body = F.concat(F.array_join("__lines.line", "\n"), F.lit("\n"))
    heading = F.when(F.col("chunk_no") == 0, F.lit(",".join(LINE_RECORD_COLUMNS) + "\n")).otherwise("")
    return chunks.select(*file, F.col("chunk_no").cast("bigint").alias("chunk_no"), F.concat(heading, body).cast("binary").alias("data"))


def write_line_tables(records: DataFrame, path: str, width: int = DEFAULT_WIDTH) -> None:
    """``<path>/<capture_id>/capture_%04d_tgck.csv`` for each session that has records, beside its body: the name that
    ``companion_path`` gives."""
    _write_files(line_table_chunks(records, width=width), path, CHUNK_BYTES, False, "_tgck.csv")


def write_capture_index(index: DataFrame, path: str) -> None:
    """``captures.csv`` rows, times with six decimals."""
    times = {c: F.format_string("%.6f", c) for c in ("start_time_us", "end_time_us", "duration_us")}
    index.withColumns(times).orderBy("capture_id", "file_num").write.mode("overwrite").partitionBy("capture_id").csv(
        path, header=True
    )


def write_line_records(records: DataFrame, path: str) -> None:
    """One folder of 8-column CSV per session that has records, in time order."""
    records.select("capture_id", "file_num", *LINE_RECORD_COLUMNS).repartitionByRange(
        "capture_id", "file_num", "rising_timestamp"
    ).sortWithinPartitions("capture_id", "file_num", "rising_timestamp").write.mode("overwrite").partitionBy(
        "capture_id", "file_num"
    ).csv(path, header=True)


def register_csv_rows(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows in register order: hex register, hex value, decimal value."""
    return snapshot.orderBy("log_id", "register").select(
        "log_id",
        format_hex(F.col("register"), 2, "0x").alias("register"),
        format_hex(F.col("value"), 4, "0x").alias("value_hex"),
        F.col("value").alias("value_dec"),
    )


def register_csv_comment(snapshot: DataFrame) -> DataFrame:
    """The comment line of the register file, one row per snapshot."""
    return snapshot.groupBy("log_id", "enable_num", "time_ns").agg(F.count(F.lit(1)).alias("__n")).select(
        "log_id",
        F.format_string(
            "# Register snapshot before enable #%d at t=%.6fs (%d registers)",
            F.col("enable_num"), F.col("time_ns") / 1e9, F.col("__n"),
        ).alias("comment"),
    )


def write_register_csv(snapshot: DataFrame, path: str) -> None:
    """``<path>/<log>_spi`` holds comment and rows; a snapshot has at most 128 registers."""
    lines = register_csv_comment(snapshot).select("log_id", F.lit(0).alias("o"), F.col("comment").alias("value"))
    head = register_csv_comment(snapshot).select(
        "log_id", F.lit(1).alias("o"), F.lit("register,value_hex,value_dec").alias("value")
    )
    rows = snapshot.select(
        "log_id",
        (F.col("register") + 2).alias("o"),
        F.format_string("0x%02X,0x%04X,%d", "register", "value", "value").alias("value"),
    )
    lines.unionByName(head).unionByName(rows).withColumn(
        "file", F.concat("log_id", F.lit("_spi"))
    ).repartition("file").sortWithinPartitions("file", "o").select("file", "value").write.mode("overwrite").partitionBy(
        "file"
    ).text(path)


def annotate_log(rows: DataFrame) -> DataFrame:
    """Log text rows with ``Description`` added."""
    return describe_text(rows, "mosi_text", "Description")


#: Characters that Spark escapes in names of partition folders.
_ESCAPED = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"


def _partition_folder(column: str, value: Column) -> Column:
    """Name of a partition folder, as Spark reads it back."""
    for c in _ESCAPED:
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit(f"{column}="), F.coalesce(value, F.lit("__HIVE_DEFAULT_PARTITION__")))


def write_annotated_csv(rows: DataFrame, path: str) -> None:
    """Annotated logs, one folder ``file=<log>_annotated`` each, in file order and with all columns under their names.

    Text is put together in groups of at most ``LINES_PER_CHUNK`` lines, each a file with the heading, named by its place;
    a long log is neither sorted nor written in one task, and the logs are read once."""
    headings = {f.name: f.metadata.get("heading", f.name) for f in rows.schema.fields}
    kept = [c for c in rows.columns if c not in ("log_id", "seq")] + ["Description"]
    cells = F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(kept)])
    heading = F.struct(*[F.lit(headings.get(c, c)).alias(f"c{k}") for k, c in enumerate(kept)])
    line = F.array_sort(F.collect_list(F.struct("seq", F.to_csv(cells).alias("line"))))
    text = annotate_log(rows).groupBy("log_id", F.expr(f"seq div {LINES_PER_CHUNK}").alias("chunk_no")).agg(line.alias("x"))
    chunks = text.select(
        _partition_folder("file", F.concat("log_id", F.lit("_annotated"))).alias("capture_id"),
        F.lit(0).cast("bigint").alias("file_num"), F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.concat(F.to_csv(heading), F.lit("\n"), F.array_join("x.line", "\n"), F.lit("\n")).cast("binary").alias("data"),
    )
    _write_files(chunks, path, LINES_PER_CHUNK, True, ".csv", "overwrite")
