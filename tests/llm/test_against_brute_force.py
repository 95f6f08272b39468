"""Operators against plain versions of their rules, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zlib
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logicspark.llm import bpe, chat, fingerprints, language, near_copies, passages, queries, sharding
from logicspark.llm.components import connected
from logicspark.llm.words import Powers, pieces, words
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["doc_id"])


def spark_hash(*values):
    """xxhash64 of Spark for strings, longs (q) and ints (i), chained."""
    seed = 42
    for value in values:
        raw = value.encode() if isinstance(value, str) else struct.pack("<" + value[1], value[0])
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text):
    tokens = re.split(r"[ \t\n\r\f]+", text)
    if len(text) > 32 * len(tokens):
        tokens = [text[i : i + 8] for i in range(0, len(text), 8)]
    hashes = [spark_hash(t) for t in tokens]
    low = (1 << 24) - 1
    seen, ring = {}, []
    for i in range(max(1, len(hashes) - 2)):
        kmer = spark_hash(*[(h, "q") for h in hashes[i : i + 3]]) >> 24
        nth = seen[kmer] = seen.get(kmer, -1) + 1
        ring.append((spark_hash((kmer, "q"), (nth, "i")) & ~low) | i)
    ring.sort()
    out = []
    for mark in range(64):
        at = next((k for k, x in enumerate(ring) if x >= ((mark - 32) << 58)), 0)
        pair = sorted((ring[at], ring[(at + 1) % len(ring)]), key=lambda x: x & low)
        out.append(spark_hash(*[(x >> 24, "q") for x in pair]) >> 32)
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in out)


def test_fingerprints(spark, documents):
    found = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, SF).collect()}
    assert len(found) == len(documents)
    for k, doc in enumerate(documents[:60]):
        text, following = doc["text"] or "", documents[(k + 1) % len(documents)]["text"] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = found[doc["doc_id"]]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = (plain_fingerprint(t) for t in (text, edited, following))
        assert (row["fingerprint"], row["edited_fingerprint"]) == (own, other)
        for name, b in (("near_edited", other), ("near_next", after)):
            same = sum(own[i : i + 8] == b[i : i + 8] for i in range(0, 512, 8))
            assert row[name] == same / 64


def test_fingerprints_show_order_and_edits(spark):
    base = [f"w{k}" for k in range(300)]
    swapped = base[150:] + base[:150]
    edited = [w if k % 50 else "other" for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(swapped)), (4, " ".join(f"v{k}" for k in range(300)))]
    prints = fingerprints.fingerprint(spark.createDataFrame(rows, "id int, text string"), "text", "p")
    got = {r["id"]: r["p"] for r in prints.collect()}
    near = {k: np.mean(np.array(got[1]) == np.array(got[k])) for k in (2, 3, 4)}
    assert near[2] > 0.75 and near[3] < near[2] and near[4] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=6))
def test_banded_alignment(a, edits):
    b = list(a)
    for at, value in edits:
        if value == 6:
            b[at % len(b) : at % len(b) + 1] = [] if len(b) > 1 else [0]
        else:
            b.insert(at % (len(b) + 1), value)
    row = [0] * (len(b) + 1)
    for x in a:
        following = [0]
        for j, y in enumerate(b):
            following.append(row[j] + 1 if x == y else max(row[j + 1], following[-1]))
        row = following
    similarity = row[-1] / (len(a) + len(b) - row[-1])
    expected = similarity if similarity >= 0.8 - 1e-12 else 0.0
    assert near_copies.aligned(np.array(a), np.array(b)) == pytest.approx(expected)


def plain_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def planted(seed=5):
    """Bases, near and exact copies, a chain of copies, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((12, 40, 90, 400)))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            base = list(base) if rng.random() < 0.4 else list(texts[-1])
            for _ in range(len(base) // 90):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(base)
    texts += [[rng.choice(vocabulary) for _ in range(60)] for _ in range(40)]
    return [(k, " ".join(t) if k % 3 else ", ".join(t).upper()) for k, t in enumerate(texts)]


def test_near_copies_lose_no_link(spark):
    rows = planted()
    found = {r["doc_id"]: r["class_id"] for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sequences = []
    for _, text in rows:
        w = plain_words(text)
        sequences.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sequences[i], sequences[j]
            names = {s: k for k, s in enumerate(dict.fromkeys(a + b))}
            if near_copies.aligned(np.array([names[s] for s in a]), np.array([names[s] for s in b])):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert found == dict(enumerate(root))
    assert len(set(root)) < len(rows) - 10


def test_near_copies_at_the_bound(spark):
    """Pairs at exactly 0.8 whose sketches differ in more bits than four deviations: n / 9 of n shingles are their own."""
    lost = {9: (41, 440, 633, 722), 18: (2922,), 27: (144, 840, 954), 36: (2451, 2761), 99: (50, 109, 1135), 117: (1413, 2833)}
    rows, pairs = [], {}
    for n, numbers in lost.items():
        for k in numbers:
            base = [f"u{n}k{k}x{i}" for i in range(n + 4)]
            copy = base[: n + 4 - n // 9] + [f"c{n}k{k}x{i}" for i in range(n // 9)]
            pairs[len(rows) + 1] = len(rows)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: found[k] for k in pairs} == pairs


def test_near_copies_leave_other_texts_alone(spark, documents):
    found = near_copies.groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by_class = {}
    for r in found:
        by_class.setdefault(r["class_id"], []).append(r["doc_id"])
    texts = {}
    for d in documents:
        w = plain_words(d["text"])
        texts[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for members in by_class.values():
        for one in members[1:]:
            assert max(len(texts[one] & texts[o]) / max(1, len(texts[one] | texts[o])) for o in members if o != one) > 0.6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab É日\n.!x", max_size=40), min_size=1, max_size=6))
def test_words_do_not_depend_on_neighbours(texts):
    powers = Powers()
    together = words(next(pieces(pa.array(texts)))[1], powers)
    for k, text in enumerate(texts):
        own = words(next(pieces(pa.array([text])))[1], powers)
        mine = together.doc == k
        assert own.hash.tolist() == together.hash[mine].tolist()
        assert own.start.tolist() == together.start[mine].tolist()
        low = text.lower() if len(text.lower().encode()) == len(text.encode()) else text
        spelled = [low.encode()[a:b] for a, b in zip(own.start, own.end)]
        assert spelled == re.findall(rb"[A-Za-z0-9\x80-\xff]+", low.encode())


def test_repeats_are_cut_once(spark):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    own = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    texts = []
    for k, w in enumerate(own):
        at = 17 * k + 5
        texts.append(" ".join(w[:at] + (passage if k != 5 else []) + w[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in passages.without_repeats(docs).collect()}
    assert out[0]["text"] == texts[0] and out[5]["text"] == texts[5]
    for k in range(1, 5):
        row, rebuilt, at = out[k], "", 0
        for span in row["removed"]:
            rebuilt += texts[k][at : span["start"]]
            at = span["start"] + span["length"]
        assert rebuilt + texts[k][at:] == row["text"]
        left = row["text"].split()
        assert sum(w in set(passage) - set(own[k]) for w in left) < 4
        assert sum(w in set(own[k]) for w in left) >= 118


def pieced(text, row):
    """Text put together again from what is left and the removed ranges, and the removed words."""
    rebuilt, at, gone = "", 0, []
    for span in row["removed"]:
        rebuilt += text[at : span["start"]]
        at = span["start"] + span["length"]
        gone += text[span["start"] : at].split()
    assert rebuilt + text[at:] == row["text"]
    return gone


@pytest.mark.parametrize("length", [51, 60, 75])
def test_passages_inside_longer_lines_go_to_their_ends(spark, length):
    rng, texts = random.Random(length), []
    for k in range(400):
        passage = [f"p{rng.randrange(5000)}" for _ in range(length)]
        for side in "ab":
            own = [f"{side}{k}x{n}" for n in range(90)]
            at = rng.randrange(5, 80)
            texts.append((" ".join(own[:at] + passage + own[at:]), set(passage)))
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in passages.without_repeats(docs).collect()}
    whole = 0
    for k, (text, passage) in enumerate(texts):
        gone = pieced(text, out[k])
        if k % 2 == 0:
            assert not gone
            continue
        assert all(w in passage for w in gone)
        whole += len(gone) >= 0.95 * length
    assert whole >= 396


def test_repeated_lines_of_any_length_go(spark):
    lines = [" ".join(f"L{n}w{k}" for k in range(n)) for n in range(1, 8)]
    texts = ["\n".join(f"{side}{k} {side}own\n{line}" for k, line in enumerate(lines)) + f"\n{side} end" for side in "xyz"]
    texts.append("L4w0 L4w1 L4w2 stand beside other words here\n---\n---")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in passages.without_repeats(docs).collect()}
    assert out[0]["text"] == texts[0] and out[3]["text"] == texts[3]
    for k in (1, 2):
        pieced(texts[k], out[k])
        assert out[k]["text"] == "\n".join(f"{'xyz'[k]}{n} {'xyz'[k]}own" for n in range(7)) + f"\n{'xyz'[k]} end"


def plain_words(text):
    """(hash, first byte, byte after) of each word, from the column reader that an own test holds against a pattern."""
    found = words(next(pieces(pa.array([text])))[1], Powers())
    return list(zip(found.hash.tolist(), found.start.tolist(), found.end.tolist()))


def plain_units(text, own):
    """Units of a text, word by word: [begin, end, is a line]."""
    raw, out, begin = text.encode(), [], 0
    while begin < len(own):
        stop = begin + 1
        while stop < len(own) and b"\n" not in raw[own[stop - 1][2] : own[stop][1]]:
            stop += 1
        line, at, same = [w[0] for w in own[begin:stop]], 0, 0
        out.append((begin, stop, True))
        for k, value in enumerate(line):
            same = same + 1 if k and line[k - 1] == value else 0
            follows = raw[own[begin + k][2] :][:2] + b"  "
            again = k + 1 < len(line) and line[k + 1] == value
            ends = follows[:1] in (b".", b"!", b"?") and follows[1:2] in (b" ", b"\t", b"\n", b"\r") and not again
            least = all(value < v for v in line[max(0, k - 4) : k]) and all(value <= v for v in line[k + 1 : k + 5])
            if ends or least or same % 4 == 3 or k == len(line) - 1:
                if k + 1 - at >= 4 and (at, k) != (0, len(line) - 1):
                    out.append((begin + at, begin + k + 1, False))
                at = k + 1
        begin = stop
    return out


def plain_removals(texts):
    """Byte ranges that go from each text, by loops over words; texts rank in the order given."""
    read = [plain_words(t) for t in texts]
    first, later = {}, []
    for d, own in enumerate(read):
        for begin, end, line in sorted(plain_units(texts[d], own), key=lambda u: (u[0], u[1] - u[0], u[2])):
            key = tuple(w[0] for w in own[begin:end])
            if key in first:
                later.append((d, begin, end, line, *first[key]))
            else:
                first[key] = (d, begin)
    covered, lines = [set() for _ in texts], [set() for _ in texts]
    for d, begin, end, line, fd, fbegin in later:
        covered[d] |= set(range(begin, end))
        lines[d] |= set(range(begin, end)) if line else set()
    units_only = [set(c) for c in covered]
    for d, begin, end, line, fd, fbegin in later:
        if begin - 1 not in units_only[d]:
            for k in range(1, 49):
                if k > begin or k > fbegin or read[d][begin - k][0] != read[fd][fbegin - k][0]:
                    break
                covered[d].add(begin - k)
        if end not in units_only[d]:
            for k in range(48):
                fk = fbegin + end - begin + k
                if end + k >= len(read[d]) or fk >= len(read[fd]) or read[d][end + k][0] != read[fd][fk][0]:
                    break
                covered[d].add(end + k)
    out = []
    for d, own in enumerate(read):
        gone, k = [], 0
        while k < len(own):
            stop = k
            while stop in covered[d]:
                stop += 1
            gone += [n for n in range(k, stop) if stop - k >= 8 or n in lines[d]]
            k = stop + 1
        ranges, limits = [], [w[1] for w in own] + [len(texts[d].encode())]
        for n in gone:
            if ranges and ranges[-1][1] == limits[n]:
                ranges[-1][1] = limits[n + 1]
            else:
                ranges.append([limits[n], limits[n + 1]])
        out.append(ranges)
    return out


def test_repeats_brute_force(spark, documents):
    found = {r["doc_id"]: r["removed"] for r in passages.without_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    ranked = sorted(documents, key=lambda d: d["doc_id"])
    changed = 0
    for doc, ranges in zip(ranked, plain_removals([d["text"] or "" for d in ranked])):
        raw = (doc["text"] or "").encode()
        spans = [(len(raw[:a].decode()), len(raw[a:b].decode())) for a, b in ranges]
        assert [(s["start"], s["length"]) for s in found[doc["doc_id"]]] == spans
        changed += bool(spans)
    assert changed


def test_repeated_word_windows_go(spark, documents):
    """Without units: words of any 51 that stood at an earlier place go, nearly all, and no others do but in lines."""
    found = {r["doc_id"]: r["removed"] for r in passages.without_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    seen, repeated, missed = set(), 0, 0
    for doc in sorted(documents, key=lambda d: d["doc_id"]):
        raw = (doc["text"] or "").encode()
        own = plain_words(doc["text"] or "")
        again = set()
        for k in range(len(own) - 50):
            window = tuple(w[0] for w in own[k : k + 51])
            again |= set(range(k, k + 51)) if window in seen else set()
            seen.add(window)
        chars = [len(raw[: w[1]].decode()) for w in own]
        spans = [(s["start"], s["start"] + s["length"]) for s in found[doc["doc_id"]]]
        repeated += len(again)
        missed += sum(not any(a <= chars[k] < b for a, b in spans) for k in again)
    assert repeated > 500 and missed <= 0.02 * repeated


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        ranks = bpe.read_ranks(file)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(ranks, public_tokenizers.PATTERN), own


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab \n'stée日!", max_size=300))
def test_tree_encoding(codec, text):
    tree, direct = codec
    ids = tree.encode(text)
    assert ids == direct.encode_ordinary(text) and tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2500, "=" * 4097, "日本" * 900, "abcdefgh1" * 500, " " * 777])
def test_tree_encoding_of_long_matches(codec, text):
    assert codec[0].encode(text) == codec[1].encode_ordinary(text)
    assert codec[0]._merged_by_heap([text.encode()[i : i + 1] for i in range(len(text.encode()))]) == codec[0].tree(text.encode())


def test_encoded_documents(spark, documents, codec):
    found = {r["doc_id"]: r for r in queries.op5_bpe(spark, SF).collect()}
    for doc in documents:
        ids = codec[1].encode_ordinary(doc["text"] or "")
        row = found[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, label = rng.integers(1, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.probabilities(data).astype(np.float64)[:, label, np.arange(4)]).mean()

    for name, gradient in net.gradients(data, label).items():
        weight = net.weights[name]
        for _ in range(5):
            at = tuple(rng.integers(1, 5) if name.startswith("bytes") and k == 0 else rng.integers(0, s) for k, s in enumerate(weight.shape))
            old = weight[at]
            weight[at] = old + 1e-2
            above = loss()
            weight[at] = old - 1e-2
            below = loss()
            weight[at] = old
            assert (above - below) / 2e-2 == pytest.approx(gradient[at], abs=3e-3)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op6_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op4_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    good = np.array([r["score"] for r in found if r["quality"] == 1])
    bad = np.array([r["score"] for r in found if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert np.mean(good >= 0.3) > 0.95 and np.mean(bad < 0.3) > 0.6


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 100, 1601])
def test_feistel_is_one_to_one(spark, rows):
    placed = spark.range(rows).select(sharding.permuted("id", rows).alias("p"), "id").collect()
    assert sorted(r["p"] for r in placed) == list(range(rows))
    if rows > 100:
        assert sum(abs(r["p"] - r["id"]) < rows / 20 for r in placed) < rows / 4


def test_shards(spark, documents):
    found = queries.op8_sharding(spark, SF).collect()
    assert sorted(r["row_number"] for r in found) == list(range(len(documents)))
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in found)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_embeddings(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])[:400]
    rng = np.random.default_rng(1)
    base = np.array([r["embedding"] for r in rows], dtype=np.float64)
    near = base[:120] + rng.normal(0, 0.04, (120, base.shape[1]))
    near = np.concatenate([near, near[:30] + rng.normal(0, 0.04, (30, base.shape[1])), np.repeat(near[:1], 40, axis=0)])
    every = np.concatenate([base, near])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    from logicspark.llm import embeddings

    found = sorted(embeddings.near_vectors(table).collect(), key=lambda r: r["vec_id"])
    unit = every / np.linalg.norm(every, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(every))
    for _ in range(len(every)):
        label = np.minimum(label, np.where(linked, label[None, :], len(every)).min(axis=1))
    assert [r["n_links"] for r in found] == linked.sum(axis=1).tolist()
    assert [r["component_id"] for r in found] == label.tolist()


@pytest.mark.parametrize("width, rank", [(64, 8), (256, 16)])
def test_embeddings_of_few_directions(spark, width, rank):
    from logicspark.llm import embeddings

    rng = np.random.default_rng(width)
    base = rng.normal(size=(1500, rank))
    base /= np.linalg.norm(base, axis=1)[:, None]
    offset = rng.normal(size=base.shape)
    offset -= (offset * base).sum(axis=1)[:, None] * base
    offset /= np.linalg.norm(offset, axis=1)[:, None]
    cosine = rng.uniform(0.9, 0.95, len(base))[:, None]
    small = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * offset])
    every = small @ np.linalg.qr(rng.normal(size=(width, rank)))[0].T
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    found = sorted(embeddings.near_vectors(table).collect(), key=lambda r: r["vec_id"])
    linked = every @ every.T >= 0.9
    np.fill_diagonal(linked, False)
    assert [r["n_links"] for r in found] == linked.sum(axis=1).tolist()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in found.collect()} == root


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\[]/>sINTSYinst turned%0A\n", max_size=40))
def test_escape_is_reversible(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text
    for control in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in written
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_reads_back(spark):
    found = {r["conv_id"]: r for r in queries.op10_chat(spark, SF).collect()}
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert found.keys() == turns.keys()
    for conv_id, own in turns.items():
        row, learnt = found[conv_id], "".join(t for role, t in own if role == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_windows(spark):
    turns = [(1, 0, "system", "rules")] + [(1, k, ("user", "assistant")[k % 2 == 0], f"turn {k} " + "x " * 40) for k in range(1, 120)]
    windows = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 300, 100).collect()
    windows.sort(key=lambda w: w["window"])
    assert all(w["tokens"] <= 300 and w["formatted"].startswith("<|turn|>=system\nrules") for w in windows)
    learnt = [w["formatted"][s["start"] : s["start"] + s["length"]] for w in windows for s in w["loss"]]
    assert learnt == [t for _, _, role, t in turns if role == "assistant"]
    assert all(w["new_from"] == 3 for w in windows[1:])


def test_mixing_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    key = lambda r: r[0]
    columns = ("doc_id", "source", "size", "source_size", "target", "taken", "first_position")
    own = sorted((tuple(r[c] for c in columns) for r in queries.op7_mixing(spark, SF).collect()), key=key)
    assert own == sorted(con.sql(queries.ORACLES["op7_mixing"]).fetchall(), key=key)


def test_mixing_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op7_mixing(spark, SF)
    assert all(r["taken"] <= 3 * r["size"] for r in found.collect())
    by_source = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"))
    rows = by_source.collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in rows)
    words_in_all = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect())
    assert sum(r["target"] for r in rows) == pytest.approx(words_in_all)
