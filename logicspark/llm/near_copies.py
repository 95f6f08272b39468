"""Near copies of documents: Order MinHash candidates, verified by banded alignment.

A text is its sequence of five-word shingles. Shingles are labelled with their number among equal ones and hashed onto
a ring. A key is made of ``TAKEN`` neighbouring labelled shingles on the ring, the minimal ones from some mark on, put
back in text order; texts with a common key are candidates. Short texts make a key from every place of the ring, longer
ones from ``MARKS`` marks. Of two texts at similarity 0.8, at least two in five windows are common even when the
differing shingles lie as badly as can be, so all windows always meet and 24 marks miss at most 0.6 ** 24 = 5e-6 of
pairs (4e-8 on average).

The similarity is that of the best alignment: matched shingles over all shingles, ``L / (n + m - L)`` with the longest
common subsequence L. It is Jaccard similarity of shingles that keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logicspark.llm.components import connected, forest
from logicspark.llm.shared import cut
from logicspark.llm.words import Powers, Words, mix, pieces, segment_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
TAKEN = 3
MARKS = 24
#: Texts up to this many shingles make a key from every place of their ring.
EVERY_PLACE = 48
BITS = 128
#: Differing bits of the two sketches up to which a text is compared with its bucket's first text right away, up to 24,
#: up to 96 and from 97 shingles. This only orders the work: pairs with more bits are compared in candidate groups.
BITS_APART = (64, 44, 30)
#: Classes of shingles that are counted to bound the matches of a pair.
BINS = 256
#: Contents of a bucket, or of a candidate group, that a task compares in one go; more are split into blocks.
BUCKET_BLOCK = 1_024
GROUP_BLOCK = 256
C = np.uint64(0xD6E8FEB86659FD93)


def shingles(found: Words, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles in text order. A text below five words is one shingle of all its words, one
    without words a shingle of its bytes."""
    docs = len(found.bounds) - 1
    counts = found.counts()
    last = np.cumsum(counts)
    first = last - counts
    at = np.arange(max(0, len(found.hash) - SHINGLE + 1))
    at = at[found.doc[at] == found.doc[at + SHINGLE - 1]] if len(at) else at
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    none = np.flatnonzero(counts == 0)
    doc = np.concatenate([found.doc[at], short, none]).astype(np.int64)
    value = np.concatenate(
        [
            segment_hashes(found.hash, at, at + SHINGLE, powers),
            segment_hashes(found.hash, first[short], last[short], powers),
            segment_hashes(found.data.astype(np.uint64) + C, found.bounds[none], found.bounds[none + 1], powers),
        ]
    )
    order = np.argsort(doc, kind="stable")
    assert docs == 0 or np.all(np.bincount(doc, minlength=docs) > 0)
    return doc[order], value[order]


def labelled(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hash of each shingle with its number among equal shingles of its text."""
    own = mix(value + doc.astype(np.uint64) * C)
    order = np.argsort(own, kind="stable")
    place = np.arange(len(own))
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = own[order[1:]] != own[order[:-1]]
    number = np.empty(len(own), dtype=np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return mix(value ^ (number * C))


def signatures(texts: pa.Array, powers: Powers) -> dict[str, object]:
    """Of each text of a piece: content (16 bytes that tell texts apart by their words), shingles, sketch bits, keys."""
    found = words(texts, powers)
    docs = len(texts)
    doc, value = shingles(found, powers)
    count = np.bincount(doc, minlength=docs)
    start = np.cumsum(count) - count
    position = np.arange(len(doc)) - start[doc]
    hashed = labelled(doc, value)
    ring_key = (doc.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20))
    order = np.argsort(ring_key, kind="stable")
    ring_key, ring, ring_position = ring_key[order], hashed[order], position[order]

    def at_marks(marks: int) -> np.ndarray:
        """Ring place of the first shingle at or after each of the equally spaced marks of each text."""
        mark = (np.arange(marks, dtype=np.uint64) * np.uint64((1 << 44) // marks))[None, :]
        wanted = (np.arange(docs, dtype=np.uint64) << np.uint64(44))[:, None] | mark
        place = np.searchsorted(ring_key, wanted.ravel(), side="left").reshape(docs, marks)
        return np.where(place >= (start + count)[:, None], start[:, None], place)

    bits = (mix(ring[at_marks(BITS)]) & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(bits, axis=1).view(">i8").astype(np.int64)

    few = np.flatnonzero(count[doc] <= EVERY_PLACE)
    many = np.flatnonzero(count > EVERY_PLACE)
    marked = at_marks(MARKS)[many]
    begin = np.concatenate([few, marked.ravel()])
    owner = np.concatenate([doc[few], np.repeat(many, MARKS)])
    member = start[owner, None] + (begin[:, None] - start[owner, None] + np.arange(TAKEN)) % count[owner, None]
    in_text = np.argsort(ring_position[member], axis=1, kind="stable")
    tuple_values = ring[np.take_along_axis(member, in_text, axis=1)]
    key = np.zeros(len(owner), dtype=np.uint64)
    for column in range(TAKEN):
        key = mix(key * C + tuple_values[:, column])
    by_doc = np.argsort(owner, kind="stable")
    key, per_doc = key[by_doc].view(np.int64), np.bincount(owner, minlength=docs)

    first = np.cumsum(found.counts()) - found.counts()
    last = first + found.counts()
    one = segment_hashes(found.hash, first, last, powers)
    two = segment_hashes(mix(found.hash ^ C), first, last, powers)
    bare = np.flatnonzero(found.counts() == 0)
    one[bare] = value[start[bare]]
    two[bare] = mix(value[start[bare]] + C)
    content = np.stack([one, two], axis=1).astype(">u8").tobytes()
    return {
        "content": pa.Array.from_buffers(pa.binary(16), docs, [None, pa.py_buffer(content)]).cast(pa.binary()),
        "shingles": pa.array(count.astype(np.int32)),
        "bits1": pa.array(sketch[:, 0]),
        "bits2": pa.array(sketch[:, 1]),
        "keys": pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)), pa.array(key)
        ),
    }


SIGNED = (
    "doc_id bigint, text_key bigint, content binary, shingles int, bits1 bigint, bits2 bigint, keys array<bigint>"
)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for begin, texts in pieces(batch.column("text")):
            columns = {c: batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "text_key")}
            yield pa.RecordBatch.from_pydict(columns | signatures(texts, powers))


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences if it is ``least`` or more, else 0.

    Bit-parallel longest common subsequence in a band: at similarity s an alignment leaves out at most
    (n + m)(1 - s) / (1 + s) shingles, so matches lie no further than that from the diagonal. Bits of the integer are
    the rows in the band, which moves down by one row with each column."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    room = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    mask = (1 << (2 * room + 1)) - 1
    # Bit t is row j - room + t of column j; rows before the first one stay set and never count.
    state, matched = mask, 0
    for j, x in enumerate(b.tolist()):
        if j:
            if not state & 1:
                matched += 1
            state = (state >> 1) | (1 << (2 * room))
        rows = where.get(x)
        if rows is not None:
            rows = (rows >> (j - room) if j >= room else rows << (room - j)) & mask
            hit = state & rows
            state = ((state + hit) | (state - hit)) & mask
    matched += (~state & mask).bit_count()
    similarity = matched / (n + m - matched)
    return similarity if similarity >= least - 1e-12 else 0.0


def most_matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles the two have in common in any order, counted with repeats: no alignment matches more. Both are given
    as distinct values and their counts."""
    place = np.searchsorted(a[0], b[0])
    place[place == len(a[0])] = 0
    same = a[0][place] == b[0]
    return int(np.minimum(a[1][place[same]], b[1][same]).sum())


def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their shingles in order, as packed 32-bit hashes."""
    powers = Powers()
    for batch in batches:
        for begin, texts in pieces(batch.column("text")):
            doc, value = shingles(words(texts, powers), powers)
            packed = (value >> np.uint64(32)).astype(np.uint32)
            parts = np.split(packed, np.searchsorted(doc, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_pydict(
                {
                    "content": batch.column("content").slice(begin, len(texts)),
                    "ordered": pa.array([p.tobytes() for p in parts], pa.binary()),
                }
            )


class Sequences:
    """Shingle sequences and their distinct values, unpacked once."""

    def __init__(self, packed: list[bytes]) -> None:
        self.ordered = [np.frombuffer(x, dtype=np.uint32) for x in packed]
        self.counted = [np.unique(x, return_counts=True) for x in self.ordered]

    def near(self, i: int, j: int) -> bool:
        most = most_matches(self.counted[i], self.counted[j])
        total = len(self.ordered[i]) + len(self.ordered[j])
        return most >= (SIMILARITY - 1e-9) * (total - most) and aligned(self.ordered[i], self.ordered[j]) > 0


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of shingle sequences to pairs of contents; only those at SIMILARITY or more."""
    for batch in batches:
        size = len(batch)
        sides = Sequences(batch.column("ordered_a").to_pylist() + batch.column("ordered_b").to_pylist())
        found = [sides.near(k, size + k) for k in range(size)]
        rows = pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")})
        yield rows.filter(pa.array(found, pa.bool_()))


def close(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of pairs that length does not set apart."""
    n, m = rows["shingles"][left][:, None], rows["shingles"][right][None, :]
    return np.minimum(n, m) >= (SIMILARITY - 1e-9) * np.maximum(n, m)


def may_match(packed: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach SIMILARITY by the bound that no more shingles of a class match than either text has of it."""
    bins = np.stack([np.bincount(np.frombuffer(x, dtype=np.uint32) % BINS, minlength=BINS) for x in packed]).astype(np.int32)
    total = bins.sum(axis=1)
    out = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 4096):
        p, q = i[at : at + 4096], j[at : at + 4096]
        most = np.minimum(bins[p], bins[q]).sum(axis=1)
        out[at : at + 4096] = most >= (SIMILARITY - 1e-9) * (total[p] + total[q] - most)
    return out


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole cells of sorted batches (columns cell, low, high, block): rows, and which are of either block."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None

    def whole() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held)
        block = np.asarray(rows.column("block"))
        return rows, np.flatnonzero(block == at[1]), np.flatnonzero(block == at[2])

    for batch in batches:
        names = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high")), strict=True))
        begin = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[begin]:
                if names[begin] != at:
                    if held:
                        yield whole()
                    held, at = [], names[begin]
                held.append(batch.slice(begin, k - begin))
                begin = k
    if held:
        yield whole()


class Joined:
    """Which names of a task are joined already."""

    def __init__(self) -> None:
        self.root: dict[bytes, bytes] = {}

    def find(self, name: bytes) -> bytes:
        above = self.root.setdefault(name, name)
        while above != name:
            self.root[name] = self.root[above]
            name, above = above, self.root[above]
        return name

    def join(self, x: bytes, y: bytes) -> bool:
        """Whether the two were apart until now."""
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def edges_of(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_pydict({c: pa.array(x, pa.binary()) for c, x in zip("ab", columns, strict=True)})


#: Pairs after which a task forgets what it has joined, so that its memory stays bounded.
FORGET = 200_000


def length_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of labels that close pairs of a bucket's cell join and that the task has not joined before."""
    joined, count = Joined(), 0
    for table, left, right in cells(batches):
        rows = {"shingles": np.asarray(table.column("shingles"))}
        labels = table.column("label").to_pylist()
        found = []
        for i, j in forest(close(rows, left, right)):
            x, y = labels[left[i] if i >= 0 else right[-1 - i]], labels[right[j]]
            if joined.join(x, y):
                found.append((min(x, y), max(x, y)))
        count += len(found)
        if found:
            yield edges_of(found)
        if count > FORGET:
            joined, count = Joined(), 0


def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of labels that links of a candidate group's cell join, looked for among the closest sketches first."""
    for table, left, right in cells(batches):
        rows = {c: np.asarray(table.column(c)) for c in ("shingles", "bits1", "bits2")}
        labels, joined = table.column("label").to_pylist(), Joined()
        i, j = np.nonzero(close(rows, left, right))
        i, j = left[i], right[j]
        if np.array_equal(left, right):
            i, j = i[i < j], j[i < j]
        if len(i):
            near = may_match(table.column("ordered").to_pylist(), i, j)
            i, j = i[near], j[near]
        differing = sum(np.bitwise_count((rows[c][i] ^ rows[c][j]).view(np.uint64)) for c in ("bits1", "bits2"))
        sides: Sequences | None = None
        found = []
        for k in np.argsort(differing, kind="stable"):
            p, q = int(i[k]), int(j[k])
            if joined.find(labels[p]) == joined.find(labels[q]):
                continue
            sides = sides or Sequences(table.column("ordered").to_pylist())
            if sides.near(p, q):
                joined.join(labels[p], labels[q])
                found.append((labels[p], labels[q]))
        yield edges_of(found)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"),
        "text",
    )


def verified(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sequences align. Both sides of each join are written tables, so that
    Spark may split a content with very many pairs."""
    rows = cut(pairs)
    for s in ("a", "b"):
        own = ordered.select(F.col("content").alias(s), F.col("ordered").alias(f"ordered_{s}"))
        rows = rows.join(own, s)
    return rows.select("a", "b", "ordered_a", "ordered_b").mapInArrow(compare, "a binary, b binary")


def apart(s: str, other: str) -> str:
    """SQL of whether length or sketch puts a pair off to the candidate groups."""
    least = f"least({s}shingles, {other}shingles)"
    differing = f"bit_count({s}bits1 ^ {other}bits1) + bit_count({s}bits2 ^ {other}bits2)"
    room = f"case when {least} <= 24 then {BITS_APART[0]} when {least} <= 96 then {BITS_APART[1]} else {BITS_APART[2]} end"
    return f"{least} < {SIMILARITY} * greatest({s}shingles, {other}shingles) or {differing} > {room}"


def with_labels(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    return rows.join(grouped, "content", "left").withColumn("label", F.coalesce("label", "content"))


def in_cells(members: DataFrame, cell: str, block: int) -> DataFrame:
    """Rows of the cells that hold several labels, dealt so that each pair of a cell's blocks is one sorted stretch."""
    sizes = (
        members.groupBy(cell)
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least <> most")
        .select(cell, F.ceil(F.col("n") / block).cast("int").alias("many"))
    )
    dealt = members.join(cut(sizes), cell).withColumnRenamed(cell, "cell")
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(content, 7), many) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, many - 1)")))
    dealt = dealt.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    keys = ("cell", "low", "high")
    return dealt.drop("many", "other").repartition(*keys).sortWithinPartitions(*keys, "block", "content")


def groups(docs: DataFrame) -> DataFrame:
    """Near-copy groups of ``docs`` (doc_id, text; further columns are ignored), one row per row.

    Returns doc_id, text_key (hash of the text, 0 for null), class_id (smallest doc_id of the group), kept
    (doc_id = class_id) and group_key (the same for all rows of a group). Texts of the same words in the same order are
    copies, whatever their case and punctuation; null counts as empty, and all texts without any word are compared by
    their bytes. Rows that repeat an id are rows of their own. A group without any id has class_id null and kept true
    in all its rows. No rows give no rows.

    1. Contents: texts of equal words become one. 2. Buckets of contents with an equal key: each is compared with the
    bucket's content of the smallest id if their sketches are close, and what links makes groups. 3. Contents of a bucket
    that lengths do not set apart are joined to candidate groups, where the bucket holds several groups. 4. In a candidate group
    all pairs that may be near and are not joined yet are compared, block by block, so no link between different texts
    is left out. Tasks return spanning forests of what they find, never all pairs."""
    texts = keyed(docs)
    signed = cut(texts.mapInArrow(sign, SIGNED))
    repeated_rows = signed.count() != signed.select("doc_id", "text_key").distinct().count()
    same_for_all = ("shingles", "bits1", "bits2", "keys")
    contents = cut(
        signed.groupBy("content")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"),
            *[F.first(c).alias(c) for c in same_for_all],
        )
        .select("content", "first.last", "first.doc_id", "first.text_key", *same_for_all)
    )
    by_id = Window.partitionBy("key").orderBy("last", "doc_id", "content")
    sketch = ("content", "shingles", "bits1", "bits2")
    shared = cut(
        contents.select(*sketch, "last", "doc_id", F.explode(F.array_distinct("keys")).alias("key"))
        .select(
            "key",
            *sketch,
            F.first(F.struct(*sketch)).over(by_id).alias("head"),
            F.lead(F.lit(1)).over(by_id).alias("more"),
        )
        .where("more is not null or head.content <> content")
        .select(
            "key",
            *sketch,
            F.expr("head.content").alias("head"),
            F.expr(f"head.content <> content and not ({apart('head.', '')})").alias("near_head"),
        )
    )
    in_buckets = shared.select("content").distinct()
    located = contents.join(in_buckets, "content", "left_semi").select(
        "content", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    fetched = texts.join(located, texts["doc_id"].eqNullSafe(located["_id"]) & (texts["text_key"] == located["_key"]))
    ordered = fetched.select("content", "text").mapInArrow(sequence, "content binary, ordered binary")
    if repeated_rows:  # an equal row would multiply the pairs
        ordered = ordered.dropDuplicates(["content"])
    ordered = cut(ordered)

    first = shared.where("near_head").select(F.col("head").alias("a"), F.col("content").alias("b")).distinct()
    links = cut(verified(first, ordered))

    grouped = connected(links).withColumnRenamed("node", "content")
    members = cut(with_labels(shared.select("key", *sketch), grouped))
    edge = "a binary, b binary"
    may_be = in_cells(members, "key", BUCKET_BLOCK).mapInArrow(length_links, edge)
    candidates = connected(may_be).select(F.col("node").alias("label"), F.col("label").alias("group"))
    # Labels are few where groups are large, so groups that no bucket joins to others end here.
    grown = (
        members.select(*sketch, "label")
        .dropDuplicates(["content"])
        .join(candidates, "label")
        .join(ordered, "content")
    )
    further = connected(in_cells(grown, "group", GROUP_BLOCK).mapInArrow(group_links, edge))
    keyed_rows = signed.select("doc_id", "text_key", "content")
    further = further.select(F.col("node").alias("label"), F.col("label").alias("group_key"))
    heads = with_labels(contents.select("content", "doc_id"), grouped).join(further, "label", "left")
    heads = heads.select("content", "doc_id", F.coalesce("group_key", "label").alias("group_key"))
    classes = heads.groupBy("group_key").agg(F.min("doc_id").alias("class_id"))
    heads = cut(heads.select("content", "group_key").join(classes, "group_key"))
    return keyed_rows.join(heads, "content").select(
        "doc_id",
        "text_key",
        "class_id",
        F.expr("doc_id <=> class_id").alias("kept"),
        "group_key",
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-copy group, that of the smallest id; all columns stay."""
    kept = groups(docs).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"), "group_key"
    )
    kept = kept.groupBy("group_key").agg(F.min(F.struct("_kept_id", "_kept_key")).alias("first")).select("first.*")
    rows = docs.withColumn("_row_key", F.coalesce(F.xxhash64("text"), F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row_key") == F.col("_kept_key"))
    once = rows.join(kept, same).dropDuplicates(["_kept_id", "_kept_key"])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
