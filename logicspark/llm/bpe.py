"""Byte-level BPE by monoid tree reduction.

Each match of the split pattern is encoded by itself: its bytes are halved down to single bytes, and neighbours are
joined up the tree. A join re-encodes a window of tokens around the seam and doubles it until the tokens outside are
proven to stay: a sequence is the BPE encoding of its bytes exactly if every neighbouring pair is the encoding of the
pair's bytes, so it is enough that the window's first and last token pair up with the tokens next to the window. Both
sides were encodings before, so all other pairs hold already. Joining is associative; results of small subtrees and
seams repeat and are remembered. Decoding concatenates bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries at which a task forgets what it remembers, so that its memory stays bounded.
REMEMBERED = 150_000
#: Bytes of the largest subtree worth remembering.
SMALL = 48
DECODE_LEAF = 4096

Tokens = tuple[int, ...]


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a rank file: base64 token, blank, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Remembered(dict):
    """A dictionary that works out what it lacks, and starts anew when it is full."""

    def __init__(self, work: Callable) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, key: object) -> object:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self.work(key)
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one rank table; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.text = [str(k) for k in range(len(self.token))]
        self.split = regex.compile(pattern).findall
        self.small = Remembered(self._tree)
        self.seam = Remembered(lambda pair: self.merged(self.token[pair[0]] + self.token[pair[1]]))
        self.piece = Remembered(lambda piece: self.tree(piece.encode()))

    def merged(self, data: bytes) -> Tokens:
        """The definition: merge the neighbours of least rank, leftmost first, until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 64:
            return self._merged_by_heap(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _merged_by_heap(self, parts: list[bytes]) -> Tokens:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        alive = [True] * len(parts)
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], alive[j], after[i] = both, False, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return tuple(self.ranks[p] for p, here in zip(parts, alive, strict=True) if here)

    def stays(self, left: int, right: int) -> bool:
        return self.seam[left, right] == (left, right)

    def join(self, a: Tokens, b: Tokens) -> Tokens:
        """Encoding of the concatenated bytes of two encodings."""
        if not a or not b:
            return a or b
        width = 1
        while True:
            left, right = a[-width:], b[:width]
            window = (
                self.seam[left[0], right[0]]
                if width == 1
                else self.merged(b"".join(self.token[t] for t in left + right))
            )
            if (len(a) <= width or self.stays(a[-width - 1], window[0])) and (
                len(b) <= width or self.stays(window[-1], b[width])
            ):
                return a[:-width] + window + b[width:]
            width *= 2

    def tree(self, data: bytes) -> Tokens:
        if len(data) <= SMALL:
            return self.small[data]
        return self._tree(data)

    def _tree(self, data: bytes) -> Tokens:
        if len(data) < 2:
            return (self.ranks[data],) if data else ()
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for tokens in map(self.piece.__getitem__, self.split(text)):
            ids += tokens
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text; further columns are ignored) by the rank file at ``path``.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (bytes decoded from the ids)
    and, with ``keep_ids``, ids. A null text is encoded as the empty one, which has no tokens. Every row gives a row.
    The rank table is read on the driver and sent to the executors once; it does not grow with the documents."""
    with open(path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            texts = batch.column("text")
            for begin in range(0, len(texts), 256):
                rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
                for scalar in texts.slice(begin, 256):
                    ids = codec.encode(scalar.as_py() or "")
                    rows["n_tokens"].append(len(ids))
                    listed = " ".join(map(codec.text.__getitem__, ids))
                    rows["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        rows["ids"].append(ids)
                columns = {"doc_id": batch.column("doc_id").slice(begin, 256)}
                columns |= {
                    "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
                    "ids_sha256": pa.array(rows["ids_sha256"], pa.string()),
                    "decoded_sha256": pa.array(rows["decoded_sha256"], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(encode, schema + (", ids array<int>" if keep_ids else ""))
