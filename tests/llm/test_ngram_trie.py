"""Elias-Fano sequences against sorted arrays, and the trie against dictionaries of counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logicspark.llm import ngram_trie, queries
from logicspark.llm.elias_fano import EliasFano, packed, unpacked
from tests.conftest import SF

STEP = 0.5 / ngram_trie.QUANTUM


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40)), st.sampled_from((1, 300, 2**20, 2**41)), st.data())
def test_elias_fano(numbers, universe, data):
    values = np.sort(np.array([x % universe for x in numbers], dtype=np.uint64))
    n = len(values)
    file = np.frombuffer(packed(EliasFano.of(values, universe).arrays("x")), dtype=np.uint8)
    got = EliasFano.from_arrays(unpacked(file), "x")
    assert got.at(np.arange(n)).tolist() == values.tolist()
    asked = np.array([*values, *data.draw(st.lists(st.integers(0, 2 * universe), max_size=20))], dtype=np.uint64)
    begin = np.array([data.draw(st.integers(0, n)) for _ in asked], dtype=np.int64)
    end = np.array([data.draw(st.integers(int(b), n)) for b in begin], dtype=np.int64)
    place, exact = got.find(asked, begin, end)
    assert place.tolist() == np.clip(np.searchsorted(values, asked), begin, end).tolist()
    assert exact.tolist() == [int(x) in values[b:e].tolist() for x, b, e in zip(asked, begin, end, strict=True)]


def plain_tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    """Interpolated absolute discounting over dictionaries, nothing quantised."""

    def __init__(self, texts, order):
        self.order = order
        self.grams = Counter()
        for text in texts:
            tokens = plain_tokens(text)
            for k in range(1, order + 1):
                self.grams.update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
        self.total, self.kinds = Counter(), Counter()
        for gram, n in self.grams.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1

    def p(self, gram):
        if len(gram) == 1:
            return (self.grams[gram] + 0.5) / (self.total[()] + 0.5 * (self.kinds[()] + 1))
        context, shorter = gram[:-1], self.p(gram[1:])
        if not self.total[context]:
            return shorter
        more = max(0, self.grams[gram] - ngram_trie.DISCOUNT) / self.total[context]
        return more + ngram_trie.DISCOUNT * self.kinds[context] / self.total[context] * shorter

    def score(self, text, order):
        tokens = plain_tokens(text)
        return sum(math.log10(self.p(tuple(tokens[max(0, i - order + 1) : i + 1]))) for i in range(len(tokens)))


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "Straße", "日本", "UPPER", "Upper", "a b"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n)]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("order,shard_bytes,chunk", [(1, 100, 50), (2, 500, 1 << 20), (3, 100, 50), (4, 1 << 20, 700)])
def test_scores(spark, monkeypatch, order, shard_bytes, chunk):
    monkeypatch.setattr(ngram_trie, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ngram_trie, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_trie, "PENDING", chunk)
    train = [*texts_of(1), "", None, "\x0b one\x0cONE \t\n", "the " * 2_000]
    test = [*texts_of(2, 20), *train, "never seen words", "w1 never w2 w3", None]
    plain = Plain(train, order)
    model = ngram_trie.fit(rows_of(spark, train), order)
    assert (model.tokens, model.known) == (plain.total[()], plain.kinds[()])
    for row in ngram_trie.scored(rows_of(spark, test), model).collect():
        text = test[row["doc_id"]]
        tokens = plain_tokens(text)
        assert row["n_tokens"] == len(tokens)
        assert row["n_known"] == sum(plain.grams[(t,)] > 0 for t in tokens)
        assert row["base_score"] == pytest.approx(plain.score(text, 1), rel=1e-12)
        assert abs(row["score"] - plain.score(text, order)) <= 2 * order * STEP * len(tokens) + 1e-9


def test_chances_sum_to_one(spark):
    texts = texts_of(4, 30)
    vocabulary = sorted({t for x in texts for t in plain_tokens(x) if t})
    model = ngram_trie.fit(rows_of(spark, texts))
    plain = Plain(texts, ngram_trie.ORDER)
    for context in (["w1", "w2"], ["w3"], ["unseen", "w4"]):
        # What follows the context and a word is the same chance in both, so the difference is that of the word.
        asked = [" ".join([*context, w]) for w in [*vocabulary, "unseentoo"]] + [" ".join(context)]
        scores = {r["doc_id"]: r["score"] for r in ngram_trie.scored(rows_of(spark, asked), model).collect()}
        end = math.log10(plain.p((*context, None)[-3:]))
        before = scores[len(asked) - 1] - end
        rest = [math.log10(plain.p((*context, w, None)[-3:])) for w in [*vocabulary, "unseentoo"]]
        total = 10**end + sum(10 ** (scores[k] - before - rest[k]) for k in range(len(rest)))
        assert total == pytest.approx(1, abs=5e-3)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    plain = Plain([t for k, t in docs.items() if not out[k]], ngram_trie.ORDER)
    rows = queries.op13_trie_scores(spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        text = docs[row["doc_id"]]
        assert row["held_out"] == out[row["doc_id"]] and row["train_tokens"] == plain.total[()]
        assert row["base_score"] == pytest.approx(plain.score(text, 1), rel=1e-12)
        assert row["score"] == pytest.approx(plain.score(text, ngram_trie.ORDER), abs=1e-3 * row["n_tokens"])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_cases(spark):
    rows = [(None, "a null id", 1), (4, None, 1), (4, "a tie", 1), (4, "a tie", 1), (5, "x" * 70_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").withColumn("score", F.lit("old"))
    model = ngram_trie.fit(docs)
    out = ngram_trie.scored(docs, model).collect()
    assert sorted(r["n_tokens"] for r in out) == [1, 2, 3, 3, 4] and all(r["shard"] == 1 for r in out)
    assert ngram_trie.scored(docs.where("false"), model).collect() == []
    empty = ngram_trie.fit(docs.where("false"))
    assert {(r["n_known"], r["base_score"], r["score"]) for r in ngram_trie.scored(docs, empty).collect()} == {(0, 0, 0)}
