"""Links between two tokenizers' tokens, against sets of offsets and plain counts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logicspark.llm import queries, token_links
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return token_links.Vocabularies.read(A, B)


@pytest.fixture(scope="module")
def plain(own):
    """Ids, groups, links and cuts of one text, by sets of the ends of whole encodings."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def read(text):
        whole = b" " + (text or "").encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        tokens_a, tokens_b = [own.a_tokens[k] for k in ids_a], [own.b_tokens[k] for k in ids_b]
        if not text or b"".join(tokens_a) != whole or b"".join(tokens_b) != whole:
            return 0, 0, "", [], []
        ends = [np.cumsum([len(t) for t in tokens]).tolist() for tokens in (tokens_a, tokens_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, begin = [], [], (0, 0)
        for at in cuts:
            end = ends[0].index(at, begin[0]) + 1, ends[1].index(at, begin[1]) + 1
            sides = ids_a[begin[0] : end[0]], ids_b[begin[1] : end[1]]
            groups.append("|".join(",".join(map(str, side)) for side in sides))
            links.append((sides[0][-1], sides[1][-1]))
            begin = end
        return len(ids_a), len(ids_b), ";".join(groups), links, cuts

    return read


SPECIAL = [
    None,
    "",
    " ",
    "  two  blanks ",
    "a▁b is not given back",
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain",
    "x" * 5_000,
    "日本語 テスト　é\n\n\tü 😀",
    "\x00 zero",
    "it's 1st_2nd ½ ² x²y",
    " ".join(f"wörd{k % 700} of{k}," for k in range(4_000)),
]


def check(own, plain, texts):
    got = token_links.Aligner(own).aligned([t or "" for t in texts], keep=True)
    for k, text in enumerate(texts):
        n_a, n_b, groups, links, cuts = plain(text)
        assert (got["n_a"][k].as_py(), got["n_b"][k].as_py(), got["groups"][k].as_py()) == (n_a, n_b, groups)
        assert [(own.pairs[x] >> 32, own.pairs[x] & 0xFFFFFFFF) for x in got["pairs"][k].as_py()] == links
        assert got["cuts"][k].as_py() == cuts
        assert got["n_links"][k].as_py() == got["n_groups"][k].as_py() == len(links)


@pytest.mark.parametrize("segment", (1, 7, 512))
def test_groups_of_texts(own, plain, monkeypatch, segment):
    monkeypatch.setattr(token_links, "SEGMENT", segment)
    check(own, plain, SPECIAL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aétT 1_'.▁\n²日 ,", max_size=40), max_size=6))
def test_groups_of_any_text(own, plain, texts):
    check(own, plain, texts)


def test_remembered_parts_start_anew(own, plain, monkeypatch):
    monkeypatch.setattr(token_links, "REMEMBERED_PARTS", 5)
    aligner = token_links.Aligner(own)
    for text in ("one two three four", "three four five six seven", "one two"):
        assert aligner.aligned([text], keep=True)["groups"][0].as_py() == plain(text)[2]


def test_counts_over_the_corpus(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    read = {k: plain(t) for k, t in texts.items()}
    counts = Counter(link for r in read.values() for link in r[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = queries.op12_token_links(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_a, n_b, groups, links, _ = read[row["doc_id"]]
        assert (row["n_a"], row["n_b"], row["n_links"], row["n_groups"]) == (n_a, n_b, len(links), len(links))
        assert row["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert row["count_sum"] == sum(counts[x] for x in links)
        assert row["n_best"] == sum(counts[x] == most[x[1]] for x in links)


def test_cases(spark):
    rows = [(None, "a null id", 1), (4, None, 1), (4, "a tie", 1), (4, "a tie", 1), (5, "", 1), (6, SPECIAL[-1], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs int")
    out = sorted(tuple(r) for r in token_links.linked(docs.drop("n_a"), A, B).fillna(-1).collect())
    assert [r[0] for r in out] == [-1, 4, 4, 4, 5, 6]
    assert out[1][1:] == out[4][1:] == (0, 0, 0, 0, "", 0, 0)
    assert out[2] == out[3] and out[2][4] == 2
    assert token_links.linked(docs.where("false"), A, B).collect() == []


def test_texts_given_back_are_found_for_a_whole_batch_at_once():
    tokens = [b" ", b"a", b"bc", b"", b"\xc3\xa9"]
    length = np.array([len(t) for t in tokens])
    table = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(length) - length, length

    def found(texts, ids):
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        return token_links.given_back(np.array([k for x in ids for k in x], dtype=np.int32), ends, texts, *table).tolist()

    assert found([b" a", b" bc", b" \xc3\xa9"], [[0, 1], [0, 3, 2], [0, 4]]) == [True, True, True]
    assert found([b" a", b" cb", b" \xc3\xa9"], [[0, 1], [0, 2], [0, 4]]) == [True, False, True]
    assert found([b" aa", b" bc", b" "], [[0, 1], [0, 2], []]) == [False, True, False]
    assert found([], []) == []
