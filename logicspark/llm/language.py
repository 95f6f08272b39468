"""Language of documents by a bidirectional gated recurrent network over UTF-8 bytes, trained here in NumPy.

A text is cut into segments of ``SEGMENT`` bytes. In both directions a gated recurrent unit reads the bytes of a
segment; at each position the two states together give a probability for each language. A document's probabilities are
the means over all of its positions. Gates use x / (1 + |x|) in place of the logistic curve and tanh, which NumPy works
out several times faster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logicspark.llm.quality import held_out
from logicspark.llm.words import pieces, raw_bytes

HIDDEN = 8
SEGMENT = 128
#: Segments worked on at once when scoring.
WIDTH = 4_096
#: Texts of a language that the fit reads at most, about, and bytes of one; longer texts are not picked.
SAMPLE = 300
SAMPLE_BYTES = 32_768
#: Languages at most; more of them fail the fit.
MOST_LANGUAGES = 200
STEPS = 160
BATCH = 384
TRAIN_LENGTH = 64
UNKNOWN = "und"


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def slope(x: np.ndarray) -> np.ndarray:
    return 1 / np.square(1 + np.abs(x))


@dataclass
class Network:
    """Weights: for each direction a row of gate inputs for each byte and the state's weights; the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str]) -> Network:
        rng, h = np.random.default_rng(7), HIDDEN
        shapes = {"bytes_f": (256, 3 * h), "bytes_b": (256, 3 * h), "state_f": (h, 3 * h), "state_b": (h, 3 * h)}
        shapes |= {"out": (2 * h, len(languages)), "bias": (len(languages),)}
        return cls(
            languages,
            {k: (rng.standard_normal(s) * (0.0 if k == "bias" else 0.4)).astype(np.float32) for k, s in shapes.items()},
        )

    def run(self, data: np.ndarray, side: str, memory: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """States (HIDDEN, segments) of one direction, step by step, over ``data`` (length, segments); ``memory`` gets
        what training needs to go back. Segments lie along the last axis, so each operation runs over long rows."""
        n = HIDDEN
        table = np.ascontiguousarray(self.weights["bytes_" + side].T)
        state_weights = np.ascontiguousarray(self.weights["state_" + side].T)
        state = np.zeros((n, data.shape[1]), dtype=np.float32)
        order = range(len(data)) if side == "f" else range(len(data) - 1, -1, -1)
        for t in order:
            given, own = np.take(table, data[t], axis=1), state_weights @ state
            gate_in = given[: 2 * n] + own[: 2 * n]
            gates = squash(gate_in)
            gates *= 0.5
            gates += 0.5
            keep, reset = gates[:n], gates[n:]
            new_in = reset * own[2 * n :]
            new_in += given[2 * n :]
            new = squash(new_in)
            following = state - new
            following *= keep
            following += new
            if memory is not None:
                memory.append((t, state, gate_in, gates, own[2 * n :], new_in, new))
            state = following
            yield t, state

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(length, languages, segments) of ``data`` (length, segments)."""
        n, bias = HIDDEN, self.weights["bias"][:, None]
        front, back = (np.ascontiguousarray(part.T) for part in np.split(self.weights["out"], [n]))
        logits = np.empty((len(data), len(self.languages), data.shape[1]), dtype=np.float32)
        for t, state in self.run(data, "f"):
            np.matmul(front, state, out=logits[t])
        # States lie between -1 and 1, which bounds every logit.
        most = float((np.abs(front).sum(axis=1) + np.abs(back).sum(axis=1) + np.abs(bias[:, 0])).max())
        for t, state in self.run(data, "b"):
            here = logits[t]
            here += back @ state
            here += bias
            if most > 80:
                here -= here.max(axis=0)
            np.exp(here, out=here)
            here /= here.sum(axis=0)
        return logits

    def gradients(self, data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions that hold a byte, by backpropagation through time."""
        n, out = HIDDEN, self.weights["out"]
        length, width = data.shape
        states = np.empty((length, 2 * n, width), dtype=np.float32)
        memories: dict[str, list] = {"f": [], "b": []}
        for s, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            for t, state in self.run(data, s, memories[s]):
                states[t, part] = state
        p = out.T @ states + self.weights["bias"][:, None]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(width)] -= 1
        p *= (data > 0)[:, None, :] / max(1, int((data > 0).sum()))
        found = {"out": np.einsum("tib,tjb->ij", states, p, optimize=True), "bias": p.sum(axis=(0, 2))}
        towards = out @ p
        for s, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            weights, later = self.weights["state_" + s], np.zeros((n, width), dtype=np.float32)
            given = np.empty((3 * n, length, width), dtype=np.float32)
            found["state_" + s] = np.zeros_like(weights)
            for t, state, gate_in, gates, own_new, new_in, new in reversed(memories[s]):
                d = towards[t, part] + later
                keep, reset = gates[:n], gates[n:]
                d_new = d * (1 - keep) * slope(new_in)
                d_gates = np.concatenate([d * (state - new), d_new * own_new]) * (0.5 * slope(gate_in))
                given[: 2 * n, t], given[2 * n :, t] = d_gates, d_new
                own = np.concatenate([d_gates, d_new * reset])
                found["state_" + s] += state @ own.T
                later = d * keep + weights @ own
            flat = data.ravel()
            order = np.argsort(flat, kind="stable")
            values, starts = np.unique(flat[order], return_index=True)
            table = np.zeros((256, 3 * n), dtype=np.float32)
            table[values] = np.add.reduceat(given.reshape(3 * n, -1)[:, order], starts, axis=1).T
            found["bytes_" + s] = table
        return found

    def train(self, segments: np.ndarray, label: np.ndarray) -> None:
        """Adam over batches in a fixed order; ``segments`` (count, length)."""
        rng = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            own = rng.integers(0, len(segments), BATCH)
            rate = 0.03 * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in self.gradients(np.ascontiguousarray(segments[own].T), label[own]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                scaled = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] -= (rate * scaled).astype(np.float32)

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(documents, languages): means over all positions of each document. No segment spans two documents."""
        sizes = np.diff(bounds)
        counts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), counts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = bounds[owner] + inner * SEGMENT
        filled = np.minimum(SEGMENT, bounds[owner + 1] - start)
        sums = np.zeros((len(owner), len(self.languages)))
        padded = np.concatenate([data, np.zeros(SEGMENT, dtype=np.uint8)])
        steps = np.arange(SEGMENT)[:, None]
        for at in range(0, len(owner), WIDTH):
            part = slice(at, at + WIDTH)
            inside = steps < filled[None, part]
            segment = np.where(inside, padded[start[None, part] + steps], 0)
            sums[part] = (self.probabilities(segment) * inside[:, None, :]).sum(axis=0, dtype=np.float64).T
        total = np.zeros((len(sizes), len(self.languages)))
        np.add.at(total, owner, sums)
        return total / np.maximum(1, sizes)[:, None]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Network for the non-null values of lang, from texts of ids whose CRC mod 4 is not 2, about ``sample`` of each
    language, picked by hash of the id. No such rows give a network without languages."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select(
        "lang", "text", F.md5(F.concat_ws(":", F.lit("fit"), "doc_id").cast("binary")).alias("at")
    )
    usable = usable.where(f"octet_length(text) between 16 and {SAMPLE_BYTES}")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Network([])
    place = F.conv(F.substring("at", 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 1.2 * sample / c))])
    rows = (
        usable.where(place < share[F.col("lang")])
        .orderBy("at", F.md5("text"))
        .limit(2 * sample * len(languages))
        .select("lang", "text")
        .collect()
    )
    segments, label = [], []
    for row in rows:
        raw = np.frombuffer(row["text"].encode(), dtype=np.uint8)
        for start in np.unique(np.linspace(0, max(0, len(raw) - TRAIN_LENGTH), 12).astype(int)):
            piece = np.zeros(TRAIN_LENGTH, dtype=np.uint8)
            piece[: len(raw[start : start + TRAIN_LENGTH])] = raw[start : start + TRAIN_LENGTH]
            segments.append(piece)
            label.append(languages.index(row["lang"]))
    of_class = np.bincount(label, minlength=len(languages))
    # Each language is drawn about as often as any other.
    most = of_class.max()
    own = np.concatenate([np.resize(np.flatnonzero(np.array(label) == k), most) for k in range(len(languages)) if of_class[k]])
    network = Network.fresh(languages)
    network.train(np.stack(segments)[own], np.array(label)[own])
    return network


def predicted(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred and score (pooled probability of that language) for every whole text of ``docs`` (doc_id,
    text). A text that is null or has no letter gets 'und' and score 0, as does every text if nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in pieces(batch.column("text")):
                letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if network.languages:
                    mean = network.pooled(*raw_bytes(texts))
                    best = mean.argmax(axis=1)
                    names = [network.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                    scores = np.where(letters, np.minimum(1.0, mean[np.arange(len(best)), best]), 0.0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(begin, len(texts)),
                        "lang_pred": pa.array(names, pa.string()),
                        "score": pa.array(scores, pa.float64()),
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
