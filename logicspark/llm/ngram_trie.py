"""Language-model scores from an n-gram trie of Elias-Fano levels, built and read by many tasks.

Level 1 holds the 64-bit hashes of all training tokens in order, so that a word's id is its place, and their counts as a
rising sequence of sums. Entry of level k is an n-gram of k tokens, child of its first k - 1 tokens; entries stand in the
order of their parents. Its last token is named relative to the context without the first token: by the place of the token
among that context's children in level k - 1 (its id in level 2), which every longer n-gram must have as a suffix. Within
a level these places are made to rise by adding the end of the parent before. Pointers from parents to their first child
rise too. Each entry has a quantised smoothed probability, each parent the quantised weight of its shorter contexts.

A level is cut into shards by ranges of parents (of hashes in level 1): one file each in the shared folder, which tasks
map into memory. A level is made from counts of all training texts and the finished level below: tasks add up the n-grams
of a chunk of texts, look up their parents, and send them packed to the task of the shard.

Smoothing: tokens with 0.5 added to their counts, unknown tokens together counting as one more token; longer n-grams with
absolute discounting, interpolated with the n-gram without the first token.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logicspark.llm.elias_fano import EliasFano, packed, unpacked
from logicspark.llm.shared import shared_folder
from logicspark.llm.words import Powers, mix, pieces, raw_bytes, segment_hashes

ORDER = 3
DISCOUNT = 0.75
#: Codes of a probability per decade.
QUANTUM = 4096
#: Bytes of training text for each shard of a level.
SHARD_BYTES = 16 << 20
#: Tokens whose n-grams are added up at a time; a longer text makes a chunk of its own.
CHUNK_TOKENS = 1 << 19
#: Pending entries at which the task of a shard adds up what it has.
PENDING = 1 << 22

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
END = mix(np.array([1], dtype=np.uint64))[0]


@dataclass
class Tokens:
    """Token hashes of some texts, each text's words and its end; ``bounds`` tells where each text begins."""

    hashes: np.ndarray
    bounds: np.ndarray

    def since(self) -> np.ndarray:
        """Place of each token in its text."""
        return np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))


def tokenised(texts: pa.Array, powers: Powers) -> Tokens:
    data, bounds = raw_bytes(texts)
    data = LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~SPACE[data]
    edge, before = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    hashes = segment_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, powers)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    out = np.full(len(hashes) + len(texts), END, dtype=np.uint64)
    out[np.arange(len(hashes)) + doc] = hashes
    stops = np.cumsum(np.bincount(doc, minlength=len(texts)) + 1) if len(texts) else []
    return Tokens(out, np.concatenate([[0], stops]).astype(np.int64))


def chunks(batches: Iterator[pa.RecordBatch], powers: Powers) -> Iterator[tuple[Tokens, pa.Table]]:
    """Tokens of about CHUNK_TOKENS and the rows they come from."""
    waiting, rows, size = [], [], 0
    for batch in batches:
        for begin, texts in pieces(batch.column("text")):
            waiting.append(tokenised(texts, powers))
            rows.append(batch.slice(begin, len(texts)))
            size += len(waiting[-1].hashes)
            if size >= CHUNK_TOKENS:
                yield joined(waiting), pa.Table.from_batches(rows)
                waiting, rows, size = [], [], 0
    if waiting:
        yield joined(waiting), pa.Table.from_batches(rows)


def joined(parts: list[Tokens]) -> Tokens:
    sizes = np.concatenate([[0], *(np.diff(p.bounds) for p in parts)])
    return Tokens(np.concatenate([p.hashes for p in parts]), np.cumsum(sizes))


def local_path(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def publish(folder: str, name: str, content: bytes) -> None:
    """Writes a file whole or not at all; a repeated task writes the same one again."""
    path, attempt = local_path(folder), f"{name}.{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{attempt}", "wb") as file:
            file.write(content)
        os.replace(f"{path}/{attempt}", f"{path}/{name}")
    else:
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(folder)
        there.create_dir(path, recursive=True)
        with there.open_output_stream(f"{path}/{attempt}") as file:
            file.write(content)
        there.move(f"{path}/{attempt}", f"{path}/{name}")


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """Arrays of a file: mapped where the shared folder is a mounted one, else read."""
    path = local_path(folder)
    if path is not None:
        return unpacked(np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r"))
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    with there.open_input_file(f"{path}/{name}") as file:
        return unpacked(np.frombuffer(file.read(), dtype=np.uint8))


def coded(log_p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(log_p * -QUANTUM), 65_535).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -QUANTUM


@dataclass
class Model:
    """Where the levels are, how they are cut and how many entries lie before each shard."""

    folder: str
    shards: int
    order: int
    tokens: int = 0
    known: int = 0
    before: list[np.ndarray] = field(default_factory=list)

    def log_token(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.known + 1)))

    def parents(self, level: int) -> np.ndarray:
        """First parent of each shard of a level from 2 on, and the end."""
        return np.arange(self.shards + 1) * int(self.before[level - 2][-1]) // self.shards


class Shard:
    """One file of a level from 2 on."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.places, self.pointers = (EliasFano.from_arrays(arrays, n) for n in ("places", "pointers"))
        self.codes, self.weights = arrays["codes"], arrays["weights"]


class Trie:
    """The levels as one task sees them. Entries have places from 0 on in each level; -1 stands for none."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.opened: dict[tuple[int, int], object] = {}

    def shard(self, level: int, number: int) -> object:
        if (level, number) not in self.opened:
            arrays = mapped(f"{self.model.folder}/{level}", str(number))
            kind = (lambda a: [EliasFano.from_arrays(a, n) for n in ("hashes", "sums")]) if level == 1 else Shard
            self.opened[level, number] = kind(arrays)
        return self.opened[level, number]

    def by_shard(self, level: int, shard: np.ndarray) -> Iterator[tuple[object, int, np.ndarray]]:
        """Shards that are asked for, entries before them, and where the questions are."""
        order = np.argsort(shard, kind="stable")
        numbers, begins = np.unique(shard[order], return_index=True)
        for number, begin, stop in zip(numbers, begins, [*begins, len(order)][1:], strict=True):
            yield self.shard(level, int(number)), int(self.model.before[level - 1][number]), order[begin:stop]

    def tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each token."""
        different, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(different), -1, dtype=np.int64), np.zeros(len(different), dtype=np.int64)
        shift = 64 - (self.model.shards.bit_length() - 1)
        shard = different >> np.uint64(shift)
        for (known, sums), before, here in self.by_shard(1, shard.astype(np.int64)):
            if not known.n:
                continue
            wanted = different[here] - (shard[here] << np.uint64(shift))
            at, there = known.find(wanted, np.zeros(len(here), dtype=np.int64), np.full(len(here), known.n))
            at, here = at[there], here[there]
            upto = sums.at(np.concatenate([at, np.maximum(at - 1, 0)])).astype(np.int64)
            ids[here] = before + at
            counts[here] = upto[: len(at)] - np.where(at > 0, upto[len(at) :], 0)
        return ids[back], counts[back]

    def children(
        self, level: int, parents: np.ndarray, last: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entry of a level below each parent whose last token has this relative name, its place among the children of
        the parent, its log probability, and the parent's log weight. Parents are not -1; a last token may be."""
        out, nth = np.full((2, len(parents)), -1, dtype=np.int64)
        log_p, weight = np.zeros(len(parents)), np.zeros(len(parents))
        bounds = self.model.parents(level)
        order = np.argsort(parents)
        in_order = parents[order]
        begins = np.flatnonzero(np.diff(in_order, prepend=-1))
        different, stops = in_order[begins], np.append(begins, len(order))[1:]
        number = np.searchsorted(bounds, different, side="right") - 1
        for shard, before, here in self.by_shard(level, number):
            own = different[here] - bounds[number[here[0]]]
            begin, end = shard.pointers.at(np.concatenate([own, own + 1])).astype(np.int64).reshape(2, -1)
            base = np.zeros(len(own), dtype=np.int64)
            after = np.flatnonzero(begin > 0)
            base[after] = shard.places.at(begin[after] - 1).astype(np.int64) + 1
            # Parents rise within a shard, and so do the questions that ask for them.
            asked = order[begins[here[0]] : stops[here[-1]]]
            which = np.repeat(np.arange(len(here)), stops[here] - begins[here])
            weight[asked] = decoded(shard.weights[own])[which]
            use = (last[asked] >= 0) & (begin < end)[which]
            asked, which = asked[use], which[use]
            wanted = last[asked] + base[which]
            at, there = shard.places.find(wanted, begin[which], end[which])
            out[asked[there]] = before + at[there]
            nth[asked[there]] = (at - begin[which])[there]
            log_p[asked[there]] = decoded(shard.codes[at[there]])
        return out, nth, log_p, weight


@dataclass
class Walk:
    """All tokens of a chunk on one level: entries, their log probability as far as this level goes, relative names."""

    place: np.ndarray
    log_p: np.ndarray
    last: np.ndarray


def walked(trie: Trie, tokens: Tokens, upto: int) -> tuple[np.ndarray, list[Walk]]:
    """Counts of all tokens, and the levels up to one."""
    ids, counts = trie.tokens(tokens.hashes)
    levels = [Walk(ids, trie.model.log_token(counts), ids)]
    since = tokens.since()
    for level in range(2, upto + 1):
        below = levels[-1]
        parent = np.concatenate([[-1], below.place[:-1]])
        use = np.flatnonzero((since >= level - 1) & (parent >= 0))
        place, log_p = np.full(len(ids), -1, dtype=np.int64), below.log_p.copy()
        last = place.copy()
        place[use], last[use], own, weight = trie.children(level, parent[use], below.last[use])
        log_p[use] = np.where(place[use] >= 0, own, log_p[use] + weight)
        levels.append(Walk(place, log_p, last))
    return counts, levels



def planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by weight, which packs small numbers well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def blob(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(planes, columns)))


def unblob(data: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.array(raw.reshape(columns, 8, -1).transpose(0, 2, 1), order="C").view("<i8")[:, :, 0]


def added_up(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different keys in order, the sum of their counts, and where each of them stood first."""
    if not len(counts):
        return keys, counts, np.zeros(0, dtype=np.int64)
    spans = [int(k.max()) + 1 for k in keys]
    if math.prod(spans) < 1 << 62:
        code = keys[0]
        for key, span in zip(keys[1:], spans[1:], strict=True):
            code = code * span + key
        order = np.argsort(code)
    else:
        order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts[order], first), order[first]


PACKED, PACKED_SQL = pa.schema([("shard", pa.int32()), ("data", pa.binary())]), "shard int, data binary"


def by_shard(shard: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One packed row for each shard; rows come in the order of shards and keys. The first column goes as differences."""
    numbers, begins = np.unique(shard, return_index=True)
    stops = [*begins, len(shard)][1:]
    rows = []
    for begin, stop in zip(begins, stops, strict=True):
        first, *rest = (c[begin:stop] for c in columns)
        rows.append(blob(np.diff(first, prepend=0), *rest))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(rows, pa.binary())], schema=PACKED)


def merged(
    batches: Iterator[pa.RecordBatch], keys: int, columns: int
) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[np.ndarray]]]:
    """(shard, keys, counts, further columns) of rows sorted by shard: keys, count, further columns that keys determine.

    Holds the different keys of one shard and at most PENDING entries more."""
    own: int | None = None
    held: np.ndarray = np.zeros((columns, 0), dtype=np.int64)
    pending: list[np.ndarray] = []
    size = 0

    def settle() -> None:
        nonlocal held, pending, size
        every = np.concatenate([held, *pending], axis=1)
        found, counts, first = added_up(list(every[:keys]), every[keys])
        held, pending, size = np.stack([*found, counts, *every[keys + 1 :, first]]), [], 0

    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
            if own is not None and shard != own:
                settle()
                yield own, list(held[:keys]), held[keys], list(held[keys + 1 :])
                held = held[:, :0]
            own = shard
            rows = unblob(data.as_py(), columns)
            rows[0] = np.cumsum(rows[0])
            pending.append(rows)
            size += rows.shape[1]
            if size >= PENDING:
                settle()
    if own is not None:
        settle()
        yield own, list(held[:keys]), held[keys], list(held[keys + 1 :])


def built(
    rows: DataFrame, model: Model, level: int, keys: int, columns: int, arrays: Callable[..., dict[str, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Writes the shards of a level from packed rows; entries and counts of each shard come back, a row a shard."""
    folder = f"{model.folder}/{level}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, key, counts, rest in merged(batches, keys, columns):
            publish(folder, str(shard), packed(arrays(shard, key, counts, rest)))
            done = {"shard": [shard], "n": [len(counts)], "total": [int(counts.sum())]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in done.items()})

    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    sizes, totals = np.zeros(model.shards, dtype=np.int64), np.zeros(model.shards, dtype=np.int64)
    for row in dealt.mapInArrow(run, "shard bigint, n bigint, total bigint").collect():
        sizes[row["shard"]], totals[row["shard"]] = row["n"], row["total"]
    for shard in np.flatnonzero(sizes == 0):
        none = np.zeros(0, dtype=np.int64)
        publish(folder, str(shard), packed(arrays(int(shard), [none] * keys, none, [none] * (columns - keys - 1))))
    return sizes, totals


def level_one(docs: DataFrame, model: Model) -> None:
    shift = 64 - (model.shards.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in chunks(batches, Powers()):
            hashes, counts = np.unique(tokens.hashes, return_counts=True)
            shard = (hashes >> np.uint64(shift)).astype(np.int64)
            inside = (hashes - (hashes >> np.uint64(shift) << np.uint64(shift))).astype(np.int64)
            yield by_shard(shard, [inside, counts])

    def arrays(_: int, keys: list[np.ndarray], counts: np.ndarray, __: list[np.ndarray]) -> dict[str, np.ndarray]:
        hashes = EliasFano.of(keys[0], 1 << shift)
        sums = EliasFano.of(np.cumsum(counts), int(counts.sum()) + 1)
        return hashes.arrays("hashes") | sums.arrays("sums")

    sizes, totals = built(docs.mapInArrow(run, PACKED_SQL), model, 1, 1, 2, arrays)
    model.before.append(np.concatenate([[0], np.cumsum(sizes)]))
    model.tokens, model.known = int(totals.sum()), int(sizes.sum())


def next_level(docs: DataFrame, model: Model, level: int) -> None:
    """Level from 2 on, from the finished levels below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bounds = Trie(model), model.parents(level)
        for tokens, _ in chunks(batches, Powers()):
            below = walked(trie, tokens, level - 1)[1][-1]
            use = np.flatnonzero(tokens.since() >= level - 1)
            keys, counts, first = added_up([below.place[use - 1], below.last[use]], np.ones(len(use), dtype=np.int64))
            shorter = coded(below.log_p[use[first]]).astype(np.int64)
            shard = np.searchsorted(bounds, keys[0], side="right") - 1
            yield by_shard(shard, [keys[0] - bounds[shard], keys[1], counts, shorter])

    def arrays(shard: int, keys: list[np.ndarray], counts: np.ndarray, rest: list[np.ndarray]) -> dict[str, np.ndarray]:
        (parent, last), (shorter,) = keys, rest
        bounds = model.parents(level)
        size = int(bounds[shard + 1] - bounds[shard])
        children = np.bincount(parent, minlength=size)
        pointers = np.concatenate([[0], np.cumsum(children)])
        total = np.bincount(parent, weights=counts, minlength=size)
        weight = np.where(children > 0, DISCOUNT * children / np.maximum(total, 1), 1.0)
        p = (counts - DISCOUNT) / total[parent] + weight[parent] * 10 ** decoded(shorter)
        group_end = np.where(children > 0, last[np.maximum(pointers[1:] - 1, 0)] + 1, 0) if len(last) else children
        base = np.cumsum(group_end) - group_end
        places = EliasFano.of(last + base[parent], int(group_end.sum()) + 1)
        out = places.arrays("places") | EliasFano.of(pointers, len(last) + 1).arrays("pointers")
        return out | {"codes": coded(np.log10(p)), "weights": coded(np.log10(weight))}

    sizes, _ = built(docs.mapInArrow(run, PACKED_SQL), model, level, 2, 4, arrays)
    model.before.append(np.concatenate([[0], np.cumsum(sizes)]))


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Trie of all texts of ``docs`` (column text; a null text counts as empty, which is one end).

    The files stay below ``spark.checkpoint.dir``; ``Model.folder`` names them. What comes back to the driver is a row for
    each shard, of which there is one for every SHARD_BYTES of text. A shard's task holds its different n-grams: those
    below one parent are no more than there are different tokens."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(1, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    model = Model(f"{shared_folder(docs.sparkSession)}/trie-{uuid.uuid4().hex}", shards, order)
    texts = docs.select("text")
    level_one(texts, model)
    for level in range(2, order + 1):
        next_level(texts, model, level)
    return model


SCORES = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every whole text of ``docs`` (doc_id, text, further columns): all columns but text, and n_tokens, n_known
    (tokens seen in training), base_score and score, log10 probabilities by tokens alone and by the trie. They replace
    columns of these names.

    A null text counts as empty, whose only token is the end. Every row gives a row. No row is shuffled."""
    kept = [c for c in docs.columns if c.lower() not in ("text", *SCORES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for tokens, rows in chunks(batches, Powers()):
            counts, levels = walked(trie, tokens, model.order)
            begins = tokens.bounds[:-1]
            columns = {c: rows.column(c).combine_chunks() for c in kept}
            columns["n_tokens"] = pa.array(np.diff(tokens.bounds))
            columns["n_known"] = pa.array(np.add.reduceat((counts > 0).astype(np.int64), begins))
            columns["base_score"] = pa.array(np.add.reduceat(levels[0].log_p, begins))
            columns["score"] = pa.array(np.add.reduceat(levels[-1].log_p, begins))
            yield from pa.Table.from_pydict(columns).to_batches()

    schema = ", ".join([f"`{c}` {kind}" for c, kind in docs.dtypes if c in kept] + [f"{c} {k}" for c, k in SCORES.items()])
    return docs.mapInArrow(run, schema)
