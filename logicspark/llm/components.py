"""Connected components of an edge table, by rounds of joins; links and labels stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logicspark.llm.shared import cut

MOST_ROUNDS = 200
ROWS_PER_TASK = 100_000


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (query, member) or (member, member) that join what the links of a block join.

    Least labels spread over rows and columns until they settle; each row and column links to its label's member."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part = linked[np.ix_(rows, columns)]
    label = np.arange(len(columns))
    none = len(columns)
    while True:
        by_row = np.where(part, label[None, :], none).min(axis=1, initial=none)
        following = np.minimum(label, np.where(part, by_row[:, None], none).min(axis=0, initial=none))
        if np.array_equal(following, label):
            break
        label = following
    for k, row in enumerate(rows):
        yield int(row), int(columns[by_row[k]])
    for k in range(len(columns)):
        if label[k] != k:
            yield -1 - int(columns[k]), int(columns[label[k]])


def _tasks(rows: int) -> int:
    """Tasks that read a written table: few where it is small, so that rounds do not leave heaps of tiny files."""
    return max(8, -(-rows // ROWS_PER_TASK))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    First every node gives way to the smallest of itself and its neighbours, edges are renamed, and those inside one
    node and repeated ones go, which leaves little of trees and stars. On what is left, each round a node takes the
    least of its neighbours' labels and of its label's own label. Joins read written tables, so that Spark may split a
    node with very many links. No edges give no rows; an edge to itself gives its node. Null ends are ignored."""
    whole = edges.select("a", "b").where("a is not null and b is not null")
    left = cut(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = left.coalesce(_tasks(left.count()))
    # Per task at most one row of a node leaves, so a node with very many links is summed up before it moves.
    heard = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
    way = cut(heard.select(F.col("a").alias("node"), F.least("a", "b").alias("way")))
    way = way.coalesce(_tasks(way.count()))
    one, two = (way.select(F.col("node").alias(f"old_{c}"), F.col("way").alias(f"new_{c}")) for c in "ab")
    renamed = left.join(one, left["a"] == one["old_a"]).join(two, left["b"] == two["old_b"]).where("new_a <> new_b")
    ends = renamed.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
    labels = _settled(cut(ends.distinct())).withColumnRenamed("node", "way")
    return way.join(labels, "way", "left").select("node", F.coalesce("label", "way").alias("label"))


def _settled(left: DataFrame) -> DataFrame:
    """``connected`` of edges without repeats and without edges to oneself, by rounds."""
    both = left.union(left.select("b", "a")).coalesce(_tasks(2 * left.count()))
    labels = cut(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    )
    tasks = _tasks(labels.count())
    labels = labels.coalesce(tasks)
    for _ in range(MOST_ROUNDS):
        known = labels.select(F.col("node").alias("v"), F.col("label").alias("found"))
        jumped = labels.join(known, labels["label"] == known["v"]).select("node", "found", F.col("label").alias("old"))
        heard = both.join(known, both["b"] == known["v"]).select(
            F.col("a").alias("node"), "found", F.lit(None).cast(labels.schema["label"].dataType).alias("old")
        )
        merged = cut(
            jumped.union(heard)
            .groupBy("node")
            .agg(F.min("found").alias("label"), F.max("old").alias("old"))
        )
        done = merged.where("label <> old").isEmpty()
        labels = merged.select("node", "label").coalesce(tasks)
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
