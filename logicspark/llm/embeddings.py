"""Near copies among embeddings by product quantisation.

An index of coarse lists (k-means centroids) and codes (k-means in subspaces of the residual) is fitted on a bounded
sample and holds every vector. A query visits each list that can hold a vector at the wanted cosine: of such a vector
the projection on the line from the query's own centroid to the list's is bounded by the cap of the unit sphere around
the query, and it lies in the list only behind their bisector. In a visited list the distance to a member's code is
summed up from tables; as it can be off by no more than the member's own quantisation error, members further than the
wanted distance plus that error drop out, and the exact cosine decides about the rest. All three bounds are exact, so no
link is left out, whatever directions the vectors lie in.

Equal vectors are one node with a weight. Vectors are dealt in list order to blocks of about equal size, and a task
compares two blocks (a cell); it returns counts and a spanning forest of the links, never the pairs. A vector moves once
for each other block that it can have links in, not once for each list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logicspark.llm.components import connected, forest
from logicspark.llm.shared import cut

COSINE = 0.9
#: Vectors that the index is fitted on at most: the first by digest.
SAMPLE = 20_000
MOST_LISTS = 4_096
CODES = 256
SUBSPACE = 4
#: Blocks that vectors are dealt to at least, and bytes of a block's vectors at most.
BLOCKS = 12
BLOCK_BYTES = 1 << 26
#: Queries compared in one go, and entries of the matrix of links at most.
QUERIES = 512
CELLS = 1 << 22
ROUNDS = 10
MOST_DIMENSIONS = 16


def unit(vector: list | None) -> np.ndarray | None:
    """Vector of length 1 in double precision; None for null or zero vectors and null or non-finite components."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.asarray(vector, dtype=np.float64)
    most = np.abs(x).max(initial=0.0)
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most
    return x / np.sqrt(x @ x)


def means(points: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's k-means from the first ``count`` distinct points; a centroid that loses all its points stays."""
    _, first = np.unique(points, axis=0, return_index=True)
    centroids = points[np.sort(first)[:count]].copy()
    for _ in range(ROUNDS):
        own = nearest(points, centroids)
        size = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = np.argmin(half - points[at : at + 4096] @ centroids.T, axis=1)
    return out


@dataclass
class Index:
    """Coarse centroids, and the centroids of each subspace of the residuals."""

    lists: np.ndarray
    codes: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int) -> Index:
        lists = means(sample, min(MOST_LISTS, max(1, round(math.sqrt(rows)))))
        residual = sample - lists[nearest(sample, lists)]
        return cls(lists, [means(residual[:, part], CODES) for part in cls.parts(sample.shape[1])])

    @staticmethod
    def parts(width: int) -> list[slice]:
        return [slice(at, min(width, at + SUBSPACE)) for at in range(0, width, SUBSPACE)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each vector."""
        own = nearest(x, self.lists)
        residual = x - self.lists[own]
        code = np.empty((len(x), len(self.codes)), dtype=np.uint8)
        rest = np.zeros(len(x))
        for k, part in enumerate(self.parts(x.shape[1])):
            code[:, k] = nearest(residual[:, part], self.codes[k])
            rest += ((residual[:, part] - self.codes[k][code[:, k]]) ** 2).sum(axis=1)
        return own, code, np.sqrt(rest)

    def probes(self, x: np.ndarray, own: np.ndarray, cosine: float) -> np.ndarray:
        """Matrix (row, list) of the lists that can hold a unit vector at ``cosine`` or more to a row, its own too."""
        squares = (self.lists**2).sum(axis=1)
        far = squares - 2 * (x @ self.lists.T)
        gap = squares[own][:, None] + squares - 2 * (self.lists[own] @ self.lists.T)
        gap = np.sqrt(np.maximum(gap, 1e-30))
        bisector = (squares - squares[own][:, None]) / (2 * gap)
        along = bisector - (far - far[np.arange(len(x)), own][:, None]) / (2 * gap)
        # No vector of the cap lies further along the line than this; rounding stays far below 1e-7 where gap > 1e-4.
        most = along * cosine + np.sqrt(np.maximum(0, 1 - along**2)) * math.sqrt(max(0, 1 - cosine * cosine))
        return (gap <= 1e-4) | (along >= cosine - 1e-7) | (bisector <= most + 1e-7)

    def distances(self, x: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Distances (queries, members) to the members' codes in list ``at``, summed from one table per subspace."""
        residual = (x - self.lists[at]).astype(np.float32)
        total = np.zeros((len(code), len(x)), dtype=np.float32)
        for k, part in enumerate(self.parts(x.shape[1])):
            own, codes = residual[:, part], self.codes[k].astype(np.float32)
            # A row of the table for each code, so that looking up a member copies one row.
            table = (own**2).sum(axis=1) - 2 * (codes @ own.T)
            table += (codes**2).sum(axis=1)[:, None]
            total += table[code[:, k]]
        return np.sqrt(np.maximum(total, 0)).T


def links(vectors: DataFrame, rows: int, width: int, cosine: float) -> DataFrame:
    """From distinct ``vectors`` (key, weight, x) of one width: (key, n, other), with n further linked vectors of key
    where other is null, else a link."""
    taken = min(SAMPLE, (1 << 26) // (8 * width))
    sample = vectors.orderBy("key").limit(taken).select("x").collect()
    index = Index.fit(np.stack([np.frombuffer(r["x"]) for r in sample]), rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                own, code, error = index.encode(np.stack([np.frombuffer(v) for v in part.column("x").to_pylist()]))
                yield pa.RecordBatch.from_pydict(
                    {c: part.column(c) for c in ("key", "weight", "x")}
                    | {
                        "list": pa.array(own.astype(np.int32)),
                        "code": pa.array([c.tobytes() for c in code], pa.binary()),
                        "error": pa.array(error),
                    }
                )

    entry = "key binary, weight bigint, x binary, list int, code binary, error double"
    placed = cut(vectors.mapInArrow(place, entry))
    # One number for each list: bounded by MOST_LISTS.
    found = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    sizes = np.array([found.get(k, 0) for k in range(len(index.lists))], dtype=np.int64)
    before, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    blocks = min(total, max(BLOCKS, -(-total * 8 * width // BLOCK_BYTES)))
    # A list stretches over the blocks from first_block to last_block; a digest deals its members among them.
    first_block = before * blocks // max(total, 1)
    last_block = (before + np.maximum(sizes, 1) - 1) * blocks // max(total, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                own = np.asarray(part.column("list"))
                x = np.stack([np.frombuffer(v) for v in part.column("x").to_pylist()])
                digest = np.array([int.from_bytes(k[:6], "big") for k in part.column("key").to_pylist()], dtype=np.int64)
                block = (before[own] + digest % sizes[own]) * blocks // total
                visited = index.probes(x, own, cosine)
                visited[:, sizes == 0] = False
                edges = np.zeros((len(x), blocks + 1), dtype=np.int64)
                row, at = np.nonzero(visited)
                np.add.at(edges, (row, first_block[at]), 1)
                np.add.at(edges, (row, last_block[at] + 1), -1)
                row, other = np.nonzero(np.cumsum(edges[:, :-1], axis=1) > 0)
                own_block = block[row]
                where = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "low": pa.array(np.minimum(own_block, other).astype(np.int32)),
                        "high": pa.array(np.maximum(own_block, other).astype(np.int32)),
                        "query": pa.array(own_block < other),
                    }
                    | {c: part.column(c).take(where) for c in ("key", "weight", "x", "list", "code", "error")}
                )

    dealt = placed.mapInArrow(deal, f"low int, high int, query boolean, {entry}")
    dealt = dealt.repartition("low", "high").sortWithinPartitions("low", "high", "query", "list", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[pa.RecordBatch] = []
        members: Members | None = None
        for batch in batches:
            low, high = np.asarray(batch.column("low")), np.asarray(batch.column("high"))
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            change = np.ones(len(batch), dtype=bool)
            change[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (asks[1:] != asks[:-1])
            starts = np.append(np.flatnonzero(change), len(batch))
            for first, last in zip(starts[:-1], starts[1:], strict=True):
                here = (int(low[first]), int(high[first]))
                if here != at:
                    if held and at[0] == at[1]:
                        members = Members(held)
                        yield from members.links(index, members, cosine)
                    at, held, members = here, [], None
                part = batch.slice(first, last - first)
                if not asks[first]:
                    held.append(part)
                elif held:
                    members = members or Members(held)
                    yield from members.links(index, Members([part]), cosine)
        if held and at[0] == at[1]:
            members = Members(held)
            yield from members.links(index, members, cosine)

    return dealt.mapInArrow(compare, "key binary, n bigint, other binary")


class Members:
    """Vectors of a block, sorted by list."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(rows)
        self.keys = table.column("key").to_pylist()
        self.weight = np.asarray(table.column("weight"))
        self.list = np.asarray(table.column("list"))
        self.x = np.stack([np.frombuffer(v) for v in table.column("x").to_pylist()])
        self.code = np.stack([np.frombuffer(c, dtype=np.uint8) for c in table.column("code").to_pylist()])
        self.error = np.asarray(table.column("error"))

    def links(self, index: Index, asked: Members, cosine: float) -> Iterator[pa.RecordBatch]:
        """Counts of both sides and forests of links between ``asked`` and these; if they are the same, of one side."""
        distance = math.sqrt(2 - 2 * cosine)
        same = asked is self
        starts = np.flatnonzero(np.append(True, self.list[1:] != self.list[:-1]))
        ends = np.append(starts[1:], len(self.list))
        counted = np.zeros(len(self.keys), dtype=np.int64)
        step = max(1, min(QUERIES, CELLS // len(self.keys)))
        for begin in range(0, len(asked.keys), step):
            x, weight = asked.x[begin : begin + step], asked.weight[begin : begin + step]
            visited = index.probes(x, asked.list[begin : begin + step], cosine)
            linked = np.zeros((len(x), len(self.keys)), dtype=bool)
            for first, last in zip(starts, ends, strict=True):
                rows = np.flatnonzero(visited[:, self.list[first]])
                if not len(rows):
                    continue
                far = index.distances(x[rows], int(self.list[first]), self.code[first:last])
                row, column = np.nonzero(far <= distance + self.error[None, first:last] + 1e-3)
                exact = np.einsum("ij,ij->i", x[rows[row]], self.x[first + column])
                linked[rows[row], first + column] = exact >= cosine
            if same:
                linked[np.arange(len(x)), begin + np.arange(len(x))] = False
            else:
                counted += weight @ linked
            own = linked @ self.weight
            out = [(asked.keys[begin + i], int(own[i]), None) for i in np.flatnonzero(own)]
            for a, b in forest(linked) if len(out) else ():
                out.append((asked.keys[begin + a] if a >= 0 else self.keys[-1 - a], 0, self.keys[b]))
            yield link_rows(out)
        yield link_rows([(self.keys[j], int(counted[j]), None) for j in np.flatnonzero(counted)])


def link_rows(rows: list[tuple[bytes, int, bytes | None]]) -> pa.RecordBatch:
    key, n, other = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict(
        {"key": pa.array(key, pa.binary()), "n": pa.array(n, pa.int64()), "other": pa.array(other, pa.binary())}
    )


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links at ``cosine`` or more among all vectors of ``table`` (vec_id, embedding; further columns are ignored).

    Returns vec_id, n_links, component_id, kept. Null and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different widths. Each row is a vector of its own, also where ids repeat; a
    null id never names a component unless all its ids are null. No rows give no rows."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit(v) for v in batch.column("embedding").to_pylist()]
            packed = [None if v is None else v.tobytes() for v in found]
            digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in packed]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "width": pa.array([0 if v is None else len(v) for v in found], pa.int32()),
                    "key": pa.array(digest, pa.binary()),
                    "x": pa.array(packed, pa.binary()),
                }
            )

    source = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    rows = source.mapInArrow(normalise, "vec_id bigint, width int, key binary, x binary")
    named = cut(rows.select("vec_id", "width", "key"))
    distinct = cut(
        rows.where("key is not null")
        .groupBy("key", "width")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"), F.first("x").alias("x"))
    )
    widths = {r["width"]: r["count"] for r in distinct.groupBy("width").count().limit(MOST_DIMENSIONS + 1).collect()}
    if len(widths) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} different widths")
    nodes = distinct.select("key", "weight", "least_id")
    found = None
    for width, count in sorted(widths.items()):
        part = links(distinct.where(F.col("width") == width).select("key", "weight", "x"), count, width, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return named.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
    labels = connected(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    nodes = nodes.join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    nodes = cut(nodes.withColumn("label", F.coalesce("label", "key")))
    heads = nodes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    nodes = cut(
        nodes.join(heads, "label").select(
            "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
        )
    )
    # Vectors that link with nothing stay out of the join, where they would share one key.
    alone = named.where("key is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = named.where("key is not null").join(nodes, "key").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
