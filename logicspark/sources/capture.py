"""Capture archives as Spark tables.

An archive is a ZIP with a ``header`` text entry and one entry ``L-{channel}/{block}``
of packed bits per channel and block. ``format("logic_capture")`` reads three tables:

* ``header``  - one row per archive with the raw header text (parsed in columns below)
* ``blocks``  - one row per channel and block
* ``aligned`` - one row per block with the bytes of every channel, so a bus decode
  needs no shuffle of packed data

The driver only lists files. Scan partitions are slices of an archive, as many as its
size asks for; a task opens the archive, reads header and directory, and works out its
own block range. Time step, first and last bit of a block come from the scan, so no
table needs a join of packed bytes.

``readStream`` follows archives that grow and archives that are added: the blocks table only, in the order in which blocks
are there on every look. The offset is the number of blocks taken of each file and channel.

A capture is named by its path below the folder that was opened, without extension.
"""

from __future__ import annotations

import glob
import itertools
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    In,
    InputPartition,
)

from logicspark.functions.scalar import RATE_UNITS, bit_of, parse_sample_rate
from logicspark.schemas import BLOCKS, HEADER, STORED_BLOCKS, fields

RAW_HEADER = fields(capture_id="string", path="string", header="string", first_block_bytes="bigint")
RAW_ALIGNED = fields(
    capture_id="string", block_num="bigint", channels=T.MapType(T.IntegerType(), T.BinaryType()),
    previous=T.MapType(T.IntegerType(), T.IntegerType()),
    start_position="bigint", num_samples="bigint", timestamp_step="bigint",
)
BYTES_PER_PARTITION = 64 << 20
BLOCKS_PER_PARTITION = 32
#: Packed bytes that a task of a stream reads, and what opening a file counts as, so that small archives share a task.
STREAM_TASK_BYTES, OPEN_BYTES = 1 << 22, 1 << 15


class CaptureError(ValueError):
    """An archive is not a readable capture."""


def open_file(path: str):
    """Random-access file; local and mounted paths as such, other URIs through Arrow."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def list_files(path: str) -> list[tuple[str, int]]:
    """Files of a file, glob or folder with their sizes."""
    if "://" not in path or path.startswith("file://"):
        local = path.removeprefix("file://")
        found = glob.glob(os.path.join(local, "*") if os.path.isdir(local) else local, recursive=True)
        return sorted((f, os.path.getsize(f)) for f in found if os.path.isfile(f))
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: path.index("://") + 3]
    found = store.get_file_info(fs.FileSelector(inner, recursive=False))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file)


def root_folder(path: str) -> str:
    """Folder below which the files of ``path`` get their names: the part before any wildcard."""
    fixed = path.removeprefix("file://").rstrip("/")
    if re.search(r"[*?\[{]", fixed):
        return os.path.dirname(re.split(r"[*?\[{]", fixed)[0])
    if "://" not in fixed and os.path.isdir(fixed):
        return fixed
    return os.path.dirname(fixed) if os.path.splitext(fixed)[1] else fixed


def name_below(path: str, root: str) -> str:
    """Path below ``root`` without extension."""
    name = path.removeprefix("file://")
    name = name[len(root) + 1 :] if root and name.startswith(root + "/") else os.path.basename(name)
    return os.path.splitext(name)[0]


def _header_value(text: str, key: str) -> str | None:
    value = None
    for line in text.splitlines():
        name, sep, rest = line.strip().partition(" = ")
        if sep and name == key:
            value = rest
    return value


@dataclass
class _Facts:
    """What a task needs to know of its archive."""

    probes: int
    samples: int
    blocks: int
    samples_per_block: int
    step: int


def _step(path: str, rate: str | None) -> int:
    """Whole nanoseconds per sample of a rate such as ``50 MHz``."""
    if rate is None:
        raise CaptureError(f"{path}: missing field samplerate")
    parts = rate.split()
    try:
        hz = float(parts[0]) * RATE_UNITS[parts[1]]
    except (IndexError, KeyError, ValueError):
        raise CaptureError(f"{path}: invalid sample rate: {rate}") from None
    step = int(1e9 // hz) if hz > 0 else 0
    if step < 1:
        raise CaptureError(f"{path}: sample rate without a whole ns step: {rate}")
    return step


def _facts(path: str, archive: zipfile.ZipFile) -> _Facts:
    try:
        text = archive.read("header").decode("utf-8", "replace")
    except KeyError:
        raise CaptureError(f"{path}: cannot find header") from None
    numbers = []
    for key in ("total probes", "total samples", "total blocks"):
        value = _header_value(text, key)
        if value is None or not value.removeprefix("+").isdigit():
            raise CaptureError(f"{path}: missing field {key}")
        numbers.append(int(value))
    try:
        size = archive.getinfo("L-0/0").file_size * 8
    except KeyError:
        raise CaptureError(f"{path}: could not read first block") from None
    return _Facts(*numbers, size, _step(path, _header_value(text, "samplerate")))


def _bit(data: bytes, index: int) -> int:
    return data[index >> 3] >> (index & 7) & 1 if 0 <= index < 8 * len(data) else 0


@dataclass
class _HeaderPart(InputPartition):
    paths: list[str]


@dataclass
class _BlockPart(InputPartition):
    """Slice ``part`` of ``parts`` of an archive; no channels means all of them."""

    path: str
    channels: list[int] | None
    part: int
    parts: int


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logic_capture"

    def schema(self) -> T.StructType:
        return {"header": RAW_HEADER, "blocks": STORED_BLOCKS, "aligned": RAW_ALIGNED}[self.options.get("table", "blocks")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if self.options.get("table", "blocks") == "header":
            return _HeaderReader(self.options)
        return _BlockReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        if self.options.get("table", "blocks") != "blocks":
            raise CaptureError("only the blocks of archives can be followed")
        return _BlockStream(self.options)


class _HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [path for path, _ in list_files(options["path"])]
        self.root = root_folder(options["path"])

    def partitions(self):
        size = max(1, len(self.paths) // 1000)
        return [_HeaderPart(self.paths[i : i + size]) for i in range(0, len(self.paths), size)] or [_HeaderPart([])]

    def read(self, partition):
        for path in partition.paths:
            with open_file(path) as f, zipfile.ZipFile(f) as archive:
                names = set(archive.namelist())
                if "header" not in names:
                    raise CaptureError(f"{path}: cannot find header")
                text = archive.read("header").decode("utf-8", "replace")
                first = archive.getinfo("L-0/0").file_size if "L-0/0" in names else None
            yield (name_below(path, self.root), path, text, first)


class _BlockReader(DataSourceReader):
    """Options: path, channels ("0,3,9"), max_samples, bytes_per_partition, table, prune."""

    def __init__(self, options):
        self.files = list_files(options["path"])
        self.root = root_folder(options["path"])
        self.aligned = options.get("table") == "aligned"
        wanted = options.get("channels")
        self.channels = sorted({int(c) for c in wanted.split(",")}) if wanted else None
        if self.channels is not None and not 1 <= len(self.channels) <= 16:
            raise CaptureError(f"between 1 and 16 channels, got {len(self.channels)}")
        self.max_samples = int(options["max_samples"]) if options.get("max_samples") else None
        self.per_partition = int(options.get("bytes_per_partition", str(BYTES_PER_PARTITION)))
        self.prune = options.get("prune", "false") == "true"
        self.only: set[int] | None = None

    def pushFilters(self, filters):
        """With option ``prune``, channel equality and IN prune scan partitions.

        Spark keeps one pruned reader per ``load()``, so a table filtered in two ways in
        one query would read the wrong channels. Pruning is therefore asked for, by
        readers that filter once; ``channels`` prunes without that limit. Every filter
        also goes back to Spark, which keeps scans of different channels apart.
        """
        for f in filters:
            if not self.prune:
                pass
            elif isinstance(f, EqualTo) and f.attribute == ("channel",):
                self._restrict({f.value})
            elif isinstance(f, In) and f.attribute == ("channel",):
                self._restrict(set(f.value))
            yield f

    def _restrict(self, channels: set[int]) -> None:
        self.only = channels if self.only is None else self.only & channels

    def partitions(self):
        channels = self.channels
        if self.only is not None:
            channels = sorted(self.only if channels is None else self.only & set(channels))
        groups: list[list[int] | None] = [[c] for c in channels] if channels is not None and not self.aligned else [channels]
        parts = []
        for path, size in self.files:
            slices = max(1, -(-size // self.per_partition))
            parts += [_BlockPart(path, group, k, slices) for group in groups for k in range(slices)]
        return parts or [_BlockPart("", None, 0, 1)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.path:
            return
        capture, schema = name_below(p.path, self.root), self._arrow_schema()
        with open_file(p.path) as f, zipfile.ZipFile(f) as archive:
            facts, names = _facts(p.path, archive), set(archive.namelist())
            asked = list(range(facts.probes)) if self.channels is None else self.channels
            if any(c < 0 or c >= facts.probes for c in asked):
                raise CaptureError(f"{p.path}: has only {facts.probes} channels, asked for {asked}")
            channels = asked if p.channels is None else [c for c in p.channels if c in asked]
            limit = facts.samples if self.max_samples is None else min(self.max_samples, facts.samples)
            size = facts.samples_per_block
            used = min(facts.blocks, -(-limit // size)) if size else 0
            first, last = used * p.part // p.parts, used * (p.part + 1) // p.parts
            # a channel ends at its first missing block, also one of an earlier slice
            ends = {c: next((b for b in range(last) if f"L-{c}/{b}" not in names), last) for c in channels}
            if self.aligned:  # the bus ends with its shortest channel
                last = min([last, *ends.values()])
            before: dict[int, int] = {}
            if self.aligned and 0 < first < last:
                before = {c: _bit(archive.read(f"L-{c}/{first - 1}"), size - 1) for c in channels}
            for block in range(first, last):
                start = block * size
                data = {c: archive.read(f"L-{c}/{block}") for c in channels if block < ends[c]}
                count = {c: min(8 * len(d), limit - start) for c, d in data.items()}
                common = {"start_position": start, "timestamp_step": facts.step, "capture_id": capture, "block_num": block}
                if self.aligned:
                    few = min(count.values(), default=0)
                    rows = [common | {"channels": list(data.items()), "previous": list(before.items()), "num_samples": few}]
                    before = {c: _bit(d, few - 1) for c, d in data.items()}
                else:
                    rows = [
                        common
                        | {"channel": c, "data": d, "num_samples": count[c], "first": _bit(d, 0), "last": _bit(d, count[c] - 1)}
                        for c, d in data.items()
                    ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _arrow_schema(self) -> pa.Schema:
        return _arrow_schema(RAW_ALIGNED if self.aligned else STORED_BLOCKS)


def _arrow_schema(table: T.StructType) -> pa.Schema:
    kinds = {"capture_id": pa.string(), "channel": pa.int32(), "data": pa.binary(), "first": pa.int32(), "last": pa.int32()}
    kinds |= {"channels": pa.map_(pa.int32(), pa.binary()), "previous": pa.map_(pa.int32(), pa.int32())}
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in table.names])


@dataclass
class _StreamRange:
    """Blocks [first, last) of one channel of an archive."""

    path: str
    channel: int
    first: int
    last: int


@dataclass
class _StreamPart(InputPartition):
    """Ranges of a task, those of one archive side by side."""

    ranges: list[_StreamRange]


class _BlockStream(DataSourceStreamReader):
    """Blocks of growing archives. Options: path, channels, max_samples, blocks_per_partition.

    An offset holds, for each file and channel, how many blocks from 0 on have been taken. A look at the files opens the
    directories of those whose size has changed, and no entry but the header. A block counts once it is whole, or the last
    one that the header tells of; a channel waits at its first missing block. A file that cannot be opened yet, or lacks
    its header or first block, is left for the next look. Blocks once taken must not change. A range has up to
    ``blocks_per_partition`` blocks; short ranges share a task, up to ``STREAM_TASK_BYTES``."""

    def __init__(self, options):
        self.options = dict(options)
        wanted = options.get("channels")
        self.channels = sorted({int(c) for c in wanted.split(",")}) if wanted else None
        self.max_samples = int(options["max_samples"]) if options.get("max_samples") else None
        self.per_partition = int(options.get("blocks_per_partition", str(BLOCKS_PER_PARTITION)))
        self.looked_at: dict[str, tuple[int, dict[str, int]]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for path, size in list_files(self.options["path"]):
            if path not in self.looked_at or self.looked_at[path][0] != size:
                try:
                    self.looked_at[path] = size, self._count(path)
                except (zipfile.BadZipFile, CaptureError, OSError):
                    continue
        return {"files": {path: counts for path, (_, counts) in self.looked_at.items()}}

    def _count(self, path: str) -> dict[str, int]:
        with open_file(path) as f, zipfile.ZipFile(f) as archive:
            facts = _facts(path, archive)
            sizes = {e.filename: e.file_size for e in archive.infolist()}
        limit = facts.samples if self.max_samples is None else min(self.max_samples, facts.samples)
        used = min(facts.blocks, -(-limit // facts.samples_per_block)) if facts.samples_per_block else 0

        def whole(channel: int, block: int) -> bool:
            size = sizes.get(f"L-{channel}/{block}")
            return size is not None and (8 * size >= facts.samples_per_block or block == facts.blocks - 1)

        channels = range(facts.probes) if self.channels is None else [c for c in self.channels if c < facts.probes]
        return {str(c): next((b for b in range(used) if not whole(c, b)), used) for c in channels}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        sizes, tasks, bytes_, opened = dict(list_files(self.options["path"])), [[]], 0, None
        for path, counts in sorted(end["files"].items()):
            taken = start["files"].get(path, {})
            block_bytes = sizes.get(path, 0) // max(1, sum(counts.values()))
            for channel, last in sorted(counts.items(), key=lambda x: int(x[0])):
                for first in range(taken.get(channel, 0), last, self.per_partition):
                    own = _StreamRange(path, int(channel), first, min(first + self.per_partition, last))
                    cost = (own.last - first) * block_bytes + (OPEN_BYTES if path != opened else 0)
                    if tasks[-1] and bytes_ + cost > STREAM_TASK_BYTES:
                        tasks.append([])
                        bytes_ = 0
                    tasks[-1].append(own)
                    bytes_, opened = bytes_ + cost, path
        return [_StreamPart(t) for t in tasks if t]

    def read(self, partition: _StreamPart) -> Iterator[pa.RecordBatch]:
        schema, root = _arrow_schema(STORED_BLOCKS), root_folder(self.options["path"])
        rows, bytes_ = [], 0
        for path, ranges in itertools.groupby(partition.ranges, key=lambda r: r.path):
            capture = name_below(path, root)
            with open_file(path) as f, zipfile.ZipFile(f) as archive:
                facts = _facts(path, archive)
                limit = facts.samples if self.max_samples is None else min(self.max_samples, facts.samples)
                for channel, block in ((r.channel, b) for r in ranges for b in range(r.first, r.last)):
                    start, data = block * facts.samples_per_block, archive.read(f"L-{channel}/{block}")
                    count = min(8 * len(data), limit - start)
                    rows.append(
                        {
                            "capture_id": capture, "channel": channel, "block_num": block, "data": data,
                            "start_position": start, "num_samples": count, "timestamp_step": facts.step,
                            "first": _bit(data, 0), "last": _bit(data, count - 1),
                        }
                    )
                    bytes_ += len(data)
                    if bytes_ >= STREAM_TASK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, bytes_ = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def register(spark: SparkSession) -> None:
    """Make the format known and let channel filters reach the scan."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _last_value(text: Column, key: str, value: str) -> Column:
    """Value of the last ``key = value`` line."""
    return F.try_element_at(
        F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*{key} = ({value})[ \t\r]*$"), F.lit(1)), F.lit(-1)
    )


def parse_header(raw: DataFrame) -> DataFrame:
    """Raw header text to the header table; a missing or bad required field fails the job."""
    text = F.col("header")

    def required(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), value).otherwise(
            F.raise_error(F.concat(F.col("path"), F.lit(f": missing field {key}"))).cast(T.StringType())
        )

    def number(key: str) -> Column:
        last = _last_value(text, key, ".*?")
        return required(key, F.when(last.rlike(r"^\+?[0-9]+$"), last)).cast("bigint")

    hz = parse_sample_rate(F.col("samplerate"))
    probe = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*probe([0-9]+) = .*$"), F.lit(1))
    label = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*probe[0-9]+ = (.*?)[ \t\r]*$"), F.lit(1))
    named = F.arrays_zip(probe.alias("n"), label.alias("name"))
    d = raw.select(
        "capture_id",
        number("total probes").cast("int").alias("total_probes"),
        required("samplerate", _last_value(text, "samplerate", ".*?")).alias("samplerate"),
        number("total samples").alias("total_samples"),
        number("total blocks").alias("total_blocks"),
        F.when(F.col("first_block_bytes").isNotNull(), F.col("first_block_bytes") * 8)
        .otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": could not read first block"))).cast("bigint"))
        .alias("samples_per_block"),
        named.alias("named"),
    ).withColumn(
        "samplerate_hz",
        F.when(hz.isNotNull(), hz).otherwise(
            F.raise_error(F.concat(F.lit("invalid sample rate: "), F.col("samplerate"))).cast("double")
        ),
    )
    names = F.transform(
        F.when(F.col("total_probes") > 0, F.sequence(F.lit(0), F.col("total_probes") - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.coalesce(
            F.try_element_at(F.filter("named", lambda x: x["n"].cast("int") == i), F.lit(-1))["name"],
            F.concat(F.lit("Probe"), i.cast("string")),
        ),
    )
    return d.withColumns(
        {"sample_period": F.lit(1.0) / F.col("samplerate_hz"), "probe_names": names}
    ).select(*HEADER.names)


@dataclass
class Capture:
    """``header`` and ``blocks`` of one or many archives."""

    header: DataFrame
    blocks: DataFrame


def read_capture(
    spark: SparkSession,
    path: str,
    channels: list[int] | None = None,
    max_samples: int | None = None,
    bytes_per_partition: int = BYTES_PER_PARTITION,
) -> Capture:
    """Open archives (file, glob or folder) as header and blocks tables."""
    register(spark)
    header = parse_header(spark.read.format("logic_capture").option("table", "header").load(path))
    reader = spark.read.format("logic_capture").option("bytes_per_partition", bytes_per_partition)
    if channels is not None:
        reader = reader.option("channels", ",".join(map(str, channels)))
    if max_samples is not None:
        reader = reader.option("max_samples", max_samples)
    return Capture(header, reader.load(path))


def read_aligned(
    spark: SparkSession,
    path: str,
    channels: list[int],
    max_samples: int | None = None,
    bytes_per_partition: int = BYTES_PER_PARTITION,
) -> DataFrame:
    """One row per block with the bytes of the given channels, and the level of each just before the block. Ends with
    the first block that a channel lacks."""
    register(spark)
    reader = spark.read.format("logic_capture").options(
        table="aligned", channels=",".join(map(str, channels)), bytes_per_partition=bytes_per_partition
    )
    if max_samples is not None:
        reader = reader.option("max_samples", max_samples)
    return reader.load(path)


def stream_capture(
    spark: SparkSession, path: str, channels: list[int] | None = None, blocks_per_partition: int = BLOCKS_PER_PARTITION
) -> DataFrame:
    """Blocks of the archives at ``path`` (file, glob or folder) as a stream that goes on as archives grow or are added."""
    register(spark)
    reader = spark.readStream.format("logic_capture").option("blocks_per_partition", blocks_per_partition)
    if channels is not None:
        reader = reader.option("channels", ",".join(map(str, channels)))
    return reader.load(path)


def save_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as Parquet, one folder per capture and channel, so channel filters prune. First and last bits become
    columns, so that later steps decide on block borders without reading packed bytes."""
    ends = {"first": bit_of(F.col("data"), F.lit(0).cast("bigint")), "last": bit_of(F.col("data"), F.col("num_samples") - 1)}
    stored = blocks.withColumns({k: v for k, v in ends.items() if k not in blocks.columns})
    stored.select(*STORED_BLOCKS.names).write.mode("overwrite").partitionBy("capture_id", "channel").parquet(path)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks written by ``save_blocks``."""
    stored = [f for f in STORED_BLOCKS.fields if f.name not in ("capture_id", "channel")]
    keys = [f for f in STORED_BLOCKS.fields if f.name in ("capture_id", "channel")]
    return spark.read.schema(T.StructType([*stored, *keys])).parquet(path).select(*STORED_BLOCKS.names)


def capture_stats(header: DataFrame) -> DataFrame:
    """Header facts with the capture's duration in seconds."""
    return header.withColumn("duration_s", F.col("total_samples") * F.col("sample_period"))
