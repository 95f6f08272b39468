"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logicspark.llm import bpe, chat, embeddings, fingerprints, language, mixing, near_copies, passages, quality, sharding

LONG = " ".join(f"word{k % 97} of{k}" for k in range(6_000))
CASES = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "  \n ", None, "a"),
    (4, "the quick brown fox jumps over the lazy dog today", "en", "b"),
    (4, "the quick brown fox jumps over the lazy dog today", "en", "b"),
    (4, "another text of the same id, which is a tie", "de", "b"),
    (None, "a text without an id and with some words", "en", "c"),
    (None, "a text without an id and with some words", "en", "c"),
    (7, LONG, "de", "c"),
    (8, "x" * 30_000, "de", "c"),
    (9, "!!! ???", None, ""),
    (-5, "é ü 日本 😀 \\ < |", "fr", "b"),
]
EXTRA = ("key", "label", "score", "removed", "position", "bucket", "digest", "content", "row", "text_key", "window")


@pytest.fixture(scope="module")
def cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("bigint"))
    for k, name in enumerate(EXTRA):
        docs = docs.withColumn(name, F.lit(k))
    return docs


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (7, 1), (8, 0), (-5, 0), (1, 0), (9, None), (None, 1)], "doc_id bigint, quality int")


def encode(docs):
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


PER_ROW = {
    "fingerprints": fingerprints.fingerprints,
    "repeats": passages.without_repeats,
    "bpe": encode,
    "language": lambda d: language.predicted(d, language.fit(d)),
    "curriculum": mixing.curriculum,
    "shards": sharding.shards,
    "groups": near_copies.groups,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_gives_a_row(cases, name):
    out = PER_ROW[name](cases).collect()
    assert len(out) == len(CASES)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted(
        (c[0] is None, c[0] or 0) for c in CASES
    )


@pytest.mark.parametrize("name", PER_ROW)
def test_no_rows_give_no_rows(cases, name):
    assert PER_ROW[name](cases.where("false")).collect() == []


def test_quality_of_cases(cases, labels):
    out = quality.scored(cases, quality.fit(cases, labels)).select("row.*", F.col("score").alias("own")).collect()
    assert len(out) == len(CASES) and all(0 <= r["own"] <= 1 for r in out)
    for no_labels in (labels.where("false"), labels.where("quality = 1")):
        scores = {r["score"] for r in quality.scored(cases, quality.fit(cases, no_labels)).collect()}
        assert len(scores) == 1
    assert quality.scored(cases.where("false"), quality.fit(cases, labels)).collect() == []


def test_stages_of_cases(spark, cases, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (cases, cases.where("false")):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        read = spark.read.parquet(str(tmp_path / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES:
            before = read.columns
            read = stage(spark, read, str(tmp_path))
            read = spark.createDataFrame(read.collect(), read.schema)
            assert read.columns == before or stage is corpus_pipeline.encode
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == read.count()


def test_near_copies_keep_one_of_each_group(cases):
    kept = [(r["doc_id"], r["text"]) for r in near_copies.without_near_copies(cases).collect()]
    assert len(kept) == len(set(kept)) == 9
    assert (None, CASES[6][1]) in kept and kept.count((4, CASES[3][1])) == 1


def test_mix_numbers_equal_rows_one_to_one(spark):
    text = "one two three four"
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, text, "t"), (3, None, "u")], "doc_id long, text string, source string")
    plan = mixing.curriculum(docs)
    taken = plan.agg(F.sum("taken")).collect()[0][0]
    assert mixing.mix(docs).where("text is not null").count() * 4 == taken
    assert mixing.mix(docs).where("text is null").count() == 1


def test_chat_cases(spark):
    rows = [
        (1, 0, "system", "be brief", 5),
        (1, 1, "user", None, 5),
        (1, 2, "assistant", "", 5),
        (1, 2, None, "tie <|end|>\n</s>", 5),
        (1, None, "user\nx%0A", "[INST]", 5),
        (None, 1, "assistant", LONG, 5),
        (None, 1, "assistant", LONG, 5),
        (2, 0, "system", "only a system turn", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 5, None: 2, 2: 1}
    assert out[None]["loss_chars"] == 2 * len(LONG) and out[1]["loss_chars"] == 0
    assert chat.read_back(chat.formatted(turns.where("false"))).collect() == []


def test_embedding_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one),
        (2, [2.0, 0.0, 0.0]),
        (2, one),
        (None, one),
        (5, None),
        (6, [0.0, 0.0, 0.0]),
        (7, [1.0, None, 0.0]),
        (8, [float("nan"), 1.0, 0.0]),
        (9, [float("inf"), 1.0, 0.0]),
        (10, []),
        (11, [1.0, 0.0]),
        (12, [1e-30, 0.0, 0.0]),
        (13, [0.0, 1.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))
    out = [tuple(r) for r in embeddings.near_vectors(table).collect()]
    linked = [r for r in out if r[1]]
    assert sorted(linked, key=str) == sorted(
        [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (12, 4, 1, False)], key=str
    )
    assert all(r[3] and r[0] == r[2] for r in out if not r[1])
    assert embeddings.near_vectors(table.where("false")).collect() == []
    assert embeddings.near_vectors(table.where("vec_id = 5")).count() == 1
