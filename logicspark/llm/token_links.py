"""Alignment of two tokenizers' tokens on the same bytes, by lockstep merging.

A text is encoded twice: with a blank before it by a byte-level BPE file (A), and by a piece model (B) that puts the
blank there itself. Token ends are byte offsets of the joined texts of a batch. One NumPy state vector holds an A and a B
pointer for every document of the batch; in each step the pointer with the smaller end moves on, at equal ends both do,
which is a cut and a link of the two tokens. Finished entries are compacted away. Long documents have several entries,
one for every ``SEGMENT`` tokens of A, so that no document runs on alone.

Two tokens that end together hold the same last bytes, so the shorter one is a suffix of the longer one. The two
vocabularies alone thus bound how many different pairs can be linked (fewer than the bytes of all their tokens), and
corpus-wide counts are one vector over these pairs, however large the corpus is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logicspark.llm.shared import cut

#: Tokens of A that one entry of the state vector works off.
SEGMENT = 512
#: Characters of text encoded and merged at a time.
BATCH_CHARS = 1 << 20
#: Both tokenizers start a token at a blank inside prose, if ``Vocabularies.cuttable``. Texts are encoded in parts that
#: such blanks divide, equal parts once.
SAFE_CUT = re.compile(r"(?<=\w) (?=\w)")
#: Parts and characters of them that a task remembers at most before it forgets them all.
REMEMBERED_PARTS, REMEMBERED_CHARS = 400_000, 8_000_000


def byte_of_letter() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


def bytes_of_a(tokenizer: Tokenizer) -> list[bytes]:
    letters = byte_of_letter()
    size = 1 + max(tokenizer.get_vocab(with_added_tokens=True).values())
    tokens = (tokenizer.id_to_token(k) or "" for k in range(size))
    return [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]


def bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes ``A << 32 | B`` of all pairs of which one is a suffix of the other."""
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for side, tokens in enumerate((a, b)):
        for k, token in enumerate(tokens):
            by_bytes[side].setdefault(token, []).append(k)
    codes = {
        i << 32 | j
        for i, token in enumerate(a)
        for at in range(len(token))
        for j in by_bytes[1].get(token[at:], ())
    }
    codes |= {
        i << 32 | j
        for j, token in enumerate(b)
        for at in range(len(token))
        for i in by_bytes[0].get(token[at:], ())
    }
    return np.array(sorted(codes), dtype=np.int64)


@dataclass
class Vocabularies:
    """Files of both tokenizers and what follows from them; of fixed size, sent to every executor once."""

    a_file: str
    b_file: bytes
    a_tokens: list[bytes]
    b_tokens: list[bytes]
    pairs: np.ndarray
    cuttable: bool

    @staticmethod
    def read(a_path: str, b_path: str) -> Vocabularies:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            a_file, b_file = a.read(), b.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        a_tokens, b_tokens = bytes_of_a(Tokenizer.from_str(a_file)), bytes_of_b(model)
        # Parts may be cut off at blanks if A splits there anyway and no piece of B goes on across a blank.
        byte_level = json.loads(a_file).get("pre_tokenizer") or {}
        split = byte_level.get("type") == "ByteLevel" and byte_level.get("use_regex", True)
        cuttable = split and not any(b" " in token.lstrip(b" ") for token in b_tokens)
        return Vocabularies(a_file, b_file, a_tokens, b_tokens, possible_pairs(a_tokens, b_tokens), cuttable)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of A and B tokens with equal ends, in order. Documents are the ranges [a_from, a_to) of A tokens.

    Ends rise over the whole batch; both sides have a token end at the end of every document."""
    counts = (a_to - a_from + SEGMENT - 1) // SEGMENT
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at_a = np.repeat(a_from, counts) + nth * SEGMENT
    end_a = np.minimum(at_a + SEGMENT, np.repeat(a_to, counts))
    before = np.where(at_a > 0, a_ends[at_a - 1], 0)
    at_b = np.searchsorted(b_ends, before, side="right")
    end_b = np.searchsorted(b_ends, a_ends[end_a - 1], side="right")
    links_a, links_b = [], []
    while len(at_a):
        a, b = a_ends[at_a], b_ends[at_b]
        same = a == b
        links_a.append(at_a[same])
        links_b.append(at_b[same])
        at_a, at_b = at_a + (a <= b), at_b + (b <= a)
        alive = (at_a < end_a) & (at_b < end_b)
        if not alive.all():
            at_a, at_b, end_a, end_b = at_a[alive], at_b[alive], end_a[alive], end_b[alive]
    if not links_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def listed(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids of all groups, ``a1,a2|b1;a3|b2,b3;``, and the end of each token's text in it.

    ``last_a`` and ``last_b`` are the last tokens of the groups. Tokens are numbered group by group, A before B."""
    place, mark = np.zeros(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids = np.zeros(len(a) + len(b), dtype=np.int32)
    group_of_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
    group_of_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
    b_before = np.concatenate([[0], last_b[:-1] + 1]) if len(last_b) else last_b
    place_a = np.arange(len(a)) + (b_before[group_of_a] if len(a) else 0)
    place_b = np.arange(len(b)) + (last_a[group_of_b] + 1 if len(b) else 0)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    digits = np.ones(len(ids), dtype=np.uint8)
    for k in range(1, len(str(ids.max(initial=0)))):
        digits += ids >= 10**k
    place = np.cumsum(digits + np.uint8(1), dtype=np.int64)
    text = np.zeros(place[-1] if len(place) else 0, dtype=np.uint8)
    text[place - 1] = mark
    for k in range(int(digits.max()) if len(digits) else 0):
        here = digits > k
        text[place[here] - 2 - k] = ord("0") + ids[here] % 10
        ids //= 10
    return text, place


def given_back(
    ids: np.ndarray, ends: np.ndarray, whole: list[bytes], tokens: np.ndarray, start: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Which of the texts ``whole`` their own ids give back; a text's ids end at its place of ``ends``.

    ``tokens`` holds the bytes of all tokens on end, from ``start`` on and ``length`` long."""
    sizes = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
    own = length[ids]
    stop = np.cumsum(own)
    upto = np.concatenate([[0], stop])[ends]
    right = np.diff(upto, prepend=0) == sizes
    at = np.repeat(start[ids] - (stop - own), own) + np.arange(upto[-1] if len(upto) else 0)
    made, wanted = tokens[at], np.frombuffer(b"".join(whole), dtype=np.uint8)
    if right.all():
        differs = np.flatnonzero(made != wanted)
        right[np.searchsorted(upto, differs, side="right")] = False
        return right
    texts, begin = made.tobytes(), upto - np.diff(upto, prepend=0)
    return np.array([texts[i:j] == w for i, j, w in zip(begin.tolist(), upto.tolist(), whole, strict=True)], dtype=bool)


class Aligner:
    """Both tokenizers of one task."""

    def __init__(self, own: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = own
        self.a = Tokenizer.from_str(own.a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=own.b_file)
        self.known: dict[str, tuple[bytes, ...] | None] = {}
        self.chars = 0
        self.a_length = np.array([len(t) for t in own.a_tokens], dtype=np.int64)
        self.b_length = np.array([len(t) for t in own.b_tokens], dtype=np.int64)
        self.a_start, self.b_start = np.cumsum(self.a_length) - self.a_length, np.cumsum(self.b_length) - self.b_length
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(t), dtype=np.uint8) for t in (own.a_tokens, own.b_tokens))

    def remember(self, wanted: set[str]) -> None:
        """Encodes the parts not known yet; None for one that either tokenizer does not give back."""
        fresh = [p for p in wanted if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED_PARTS or self.chars > REMEMBERED_CHARS:
            self.known, self.chars, fresh = {}, 0, list(wanted)
        if not fresh:
            return
        self.chars += sum(map(len, fresh))
        every_a = self.a.encode_batch_fast([" " + p for p in fresh], add_special_tokens=False)
        ids = [[e.ids for e in every_a], self.b.encode(fresh, num_threads=1)]
        whole = [b" " + p.encode() for p in fresh]
        right, packed = np.ones(len(fresh), dtype=bool), []
        for own, tokens, start, length in zip(
            ids, (self.a_bytes, self.b_bytes), (self.a_start, self.b_start), (self.a_length, self.b_length), strict=True
        ):
            every = np.fromiter(chain.from_iterable(own), dtype=np.int32)
            ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
            right &= given_back(every, ends, whole, tokens, start, length)
            raw, bounds = every.tobytes(), (4 * ends).tolist()
            packed.append([raw[i:j] for i, j in zip([0, *bounds[:-1]], bounds, strict=True)])
        self.known.update(zip(fresh, zip(*packed, strict=True), strict=True))
        self.known.update((fresh[k], None) for k in np.flatnonzero(~right).tolist())

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer the ids of all texts on end and how many each text has; a text that either of them does not
        give back has none.

        Each part is encoded with a blank before it, which stands for the blank that divides it from the one before."""
        divide = SAFE_CUT.split if self.own.cuttable else lambda text: [text]
        cut_up = [divide(t) if t else [] for t in texts]
        self.remember(set(chain.from_iterable(cut_up)))
        found = [[self.known[p] for p in some] for some in cut_up]
        found = [some if None not in some else [] for some in found]
        out = []
        for side in (0, 1):
            packed = [b"".join([x[side] for x in some]) for some in found]
            sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            out.append((np.frombuffer(b"".join(packed), dtype=np.int32).astype(np.int64), sizes))
        return out

    def aligned(self, texts: list[str], keep: bool) -> dict[str, pa.Array]:
        (a, sizes_a), (b, sizes_b) = self.encoded(texts)
        stop_a, stop_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        here = sizes_a > 0
        last_a, last_b = lockstep(a_ends, b_ends, (stop_a - sizes_a)[here], stop_a[here])
        codes = np.searchsorted(self.own.pairs, a[last_a] << 32 | b[last_b]).astype(np.int32)
        stop_link = np.searchsorted(last_a, stop_a)
        n_links = np.diff(stop_link, prepend=0)
        text, place = listed(a, b, last_a, last_b)
        bounds = np.concatenate([[0], place])[np.concatenate([[0], stop_a + stop_b])]
        groups = [bytes(text[i : max(i, j - 1)]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        offsets = pa.array(np.concatenate([[0], stop_link]), pa.int32())
        out = {
            "n_a": pa.array(sizes_a),
            "n_b": pa.array(sizes_b),
            "n_groups": pa.array(n_links),
            "n_links": pa.array(n_links),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(codes)),
        }
        if keep:
            before = np.concatenate([[0], a_ends])[np.repeat(stop_a - sizes_a, n_links)]
            out["groups"] = pa.array([g.decode() for g in groups], pa.string())
            out["cuts"] = pa.ListArray.from_arrays(offsets, pa.array(a_ends[last_a] - before))
        return out


def aligned(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Both encodings of every whole text of ``docs`` (doc_id, text; further columns are ignored), cut into groups.

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, groups_sha256 and pairs, the numbers of the linked id pairs in
    ``Vocabularies.pairs``; with ``keep_groups`` also groups (``a1,a2|b1;a3|b2,b3``) and cuts (byte offsets in blank and
    text at which both have a token end). Each cut ends one token of either side, so there are as many links as groups.
    A text that is null, empty or not given back by a tokenizer has no tokens: zeros and empty values. Every row gives a
    row. The files at both paths are read on the driver and sent out once."""
    own = docs.sparkSession.sparkContext.broadcast(Vocabularies.read(a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(own.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            begin, waiting, chars = 0, [], 0
            for k, scalar in enumerate(texts):
                waiting.append(scalar.as_py() or "")
                chars += len(waiting[-1])
                if chars >= BATCH_CHARS or k == len(texts) - 1:
                    columns = {"doc_id": ids.slice(begin, len(waiting))} | aligner.aligned(waiting, keep_groups)
                    yield pa.RecordBatch.from_pydict(columns)
                    begin, waiting, chars = k + 1, [], 0

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>"
    schema += ", groups string, cuts array<bigint>" if keep_groups else ""
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """Links of each id pair over all rows of ``aligned``: pair, n. Every batch adds its links up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            counted = np.bincount(batch.column("pairs").flatten().to_numpy(zero_copy_only=False))
            if len(counted) > len(total):
                total, counted = counted, total
            total[: len(counted)] += counted
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair, pa.int32()), "n": pa.array(total[pair], pa.int64())})

    return links.select("pairs").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def link_scores(links: DataFrame, pairs: np.ndarray) -> DataFrame:
    """Rows of ``aligned`` with n_best (links whose pair is their B id's most frequent one, ties included) and count_sum
    (corpus-wide links of the pairs of all links), without pairs.

    ``links`` is read twice, so it should be a table. The counts that go through the driver are one number for each pair
    that the vocabularies allow."""
    found = pair_counts(links).toArrow()
    counts = np.zeros(len(pairs), dtype=np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    b_id = pairs & 0xFFFFFFFF
    most = np.zeros(int(b_id.max()) + 1, dtype=np.int64)
    np.maximum.at(most, b_id, counts)
    shared = links.sparkSession.sparkContext.broadcast((counts, counts == most[b_id]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
            columns = {c: batch.column(c) for c in kept}
            for name, values in (("n_best", best), ("count_sum", n)):
                sums = np.concatenate([[0], np.cumsum(values[flat].astype(np.int64))])
                columns[name] = pa.array(np.diff(sums[ends]))
            yield pa.RecordBatch.from_pydict(columns)

    kept = [c for c in links.columns if c != "pairs"]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in links.dtypes if c != "pairs")
    return links.mapInArrow(run, f"{schema}, n_best bigint, count_sum bigint")


def linked(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """``aligned`` and ``link_scores`` over all rows of ``docs``; the aligned rows are written to the shared folder."""
    table = cut(aligned(docs, a_path, b_path, keep_groups))
    return link_scores(table, Vocabularies.read(a_path, b_path).pairs)
