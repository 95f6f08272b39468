"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, packs a text better.

Both dictionaries come from labelled texts. A whole text is packed in blocks of ``BLOCK`` bytes, so that a dictionary
counts all along long texts too. The difference of packed sizes over their sum, mean over the text, goes through a
logistic curve fitted on other labelled texts, with each class weighted by its share of all labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logicspark.llm.shared import id_digest

#: Labelled texts of each class that the fit reads at most: the first by the digest of their id. Half of them make the
#: dictionary, half the curve.
SAMPLE = 2_000
#: Bytes of a text that the fit may read at most; longer texts are not picked for it. Scoring reads whole texts.
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 131_072
BLOCK = 256
LEVEL = 7
THRESHOLD = 0.3


def held_out(doc_id: Column, modulus: int = 5, rest: int = 0) -> Column:
    """Whether the CRC of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def packer(content: bytes) -> zstandard.ZstdCompressor:
    prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=prepared, write_content_size=False, write_dict_id=False
    )


@dataclass
class Model:
    """Dictionaries of good and bad text and the curve; with one class or none, the share of good labels."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: list[bytes]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        packers = [packer(self.good), packer(self.bad)]
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            sizes = [0, 0]
            for at in range(0, len(text), BLOCK):
                block = text[at : at + BLOCK]
                for side in (0, 1):
                    sizes[side] += len(packers[side].compress(block))
            if text:
                out[k] = (sizes[1] - sizes[0]) / (sizes[1] + sizes[0])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -700, 700)))


def dictionary(texts: list[bytes]) -> bytes:
    """Content of DICTIONARY_BYTES: an equal piece from each text, from places that move on from text to text."""
    texts = [t for t in texts if t]
    if not texts:
        return b""
    piece = max(64, DICTIONARY_BYTES // len(texts))
    parts = []
    for k, text in enumerate(texts):
        start = (k * 2_654_435_761 % (1 << 32)) * max(0, len(text) - piece) >> 32
        parts.append(text[start : start + piece])
    return b"".join(parts)[:DICTIONARY_BYTES]


def curve(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of ``good`` on ``x``, with a weak prior on the slope."""
    scale = float(np.std(x)) or 1.0
    features = np.stack([x / scale, np.ones(len(x))], axis=1)
    coefficients, prior = np.zeros(2), np.diag([1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-features @ coefficients))
        gradient = features.T @ (weight * (good - p)) - prior @ coefficients
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + prior
        step = np.linalg.solve(hessian, gradient)
        coefficients += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(coefficients[0] / scale), float(coefficients[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of labels.quality (0 or 1; others and nulls are left out) on texts of ``docs``, from bounded samples.

    Rows of ids whose CRC mod 5 is 0 are never read. Only text and label enter the model."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"), id_digest(F.col("doc_id")).alias("_at")
    )
    shares = {r["_quality"]: r["count"] for r in usable.groupBy("_quality").count().collect()}
    total = sum(shares.values())
    # At most 4 times the sample, so that texts that are missing or too long leave enough: a bounded table.
    picked = usable.where("_quality = 1").orderBy("_at", "_id").limit(4 * sample)
    picked = picked.union(usable.where("_quality = 0").orderBy("_at", "_id").limit(4 * sample))
    texts = docs.select("doc_id", "text").where(f"octet_length(text) between 1 and {SAMPLE_BYTES}")
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    sides: dict[int, list[bytes]] = {}
    for quality in (0, 1):
        rows = found.where(F.col("_quality") == quality).orderBy("_at", "doc_id", F.md5("text")).limit(sample)
        sides[quality] = [r["text"].encode() for r in rows.select("text").collect()]
    if not sides[0] or not sides[1]:
        prior = (shares.get(1, 0) + 1) / (total + 2)
        return Model(b"", b"", 0.0, math.log(prior / (1 - prior)))
    model = Model(dictionary(sides[1][::2]), dictionary(sides[0][::2]), 0.0, 0.0)
    rest = {q: texts[1::2] or texts for q, texts in sides.items()}
    x = model.differences(rest[0] + rest[1])
    good = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(good == 1, shares[1] / len(rest[1]), shares[0] / len(rest[0])) * len(good) / total
    model.slope, model.offset = curve(x, good, weight)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` as column row (a struct of all columns) with double column score, 0 to 1: how likely label 1 is.

    A null text counts as the empty one, whose sizes do not differ. Every row gives a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(s.as_py() or "").encode() for s in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(model.scores(texts), pa.float64())], names=["row", "score"]
            )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
