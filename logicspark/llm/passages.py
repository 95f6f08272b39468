"""Substring dedup by hashing of normalised lines and parts of lines: of every passage that repeats, the earliest
occurrence stays.

Every line with words is a unit of its own. A longer line is also cut into parts, after a sentence mark before white
space, after a word whose hash is the least among ``REACH`` words on either side in its line, and after REACH equal
words. The cuts depend on the words near them alone, so a passage gets the same cuts inside wherever it stands. Letter
case, punctuation and white space do not count. Parts below ``UNIT_WORDS`` words have no digest of their own.

Of units whose digests are equal all over the table the first by (doc_id, text, place) stays. A later one grows word by
word to both sides as long as its neighbours equal those of the first one, so a passage goes up to its last word although
the cuts at its ends differ. Whole lines go at any length; other words go where ``PASSAGE_WORDS`` of them or more stand
together. Each word that goes stands for an equal word of an earlier place, so no passage loses all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logicspark.llm.shared import cut
from logicspark.llm.words import Powers, Words, mix, pieces, segment_hashes, words

#: A power of two.
REACH = 4
UNIT_WORDS = 4
PASSAGE_WORDS = 8
#: Words that a unit may grow at either end. A repeated stretch of this length holds cuts, hence units, of its own.
GROWTH = 48
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[[ord(c) for c in ".!?"]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[ord(c) for c in " \t\n\r"]] = True
C = np.uint64(0xA24BAED4963EE407)


def anchors(values: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Where a value is below the REACH values before it and not above the REACH after it, inside its line."""
    most = np.iinfo(np.uint64).max
    place = REACH + np.arange(len(values)) + REACH * line
    padded = np.full(REACH + (place[-1] + REACH + 1 if len(place) else 0), most, dtype=np.uint64)
    padded[place] = values
    least, width = padded, 1
    while width < REACH:  # least[i] covers the values i to i + width - 1
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (values < least[place - REACH]) & (values <= least[place + 1])


def steps(values: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Every REACH-th word of a stretch of one repeated word, which has no least word."""
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (line[1:] != line[:-1])
    place = np.arange(len(values))
    return (place - np.maximum.accumulate(np.where(fresh, place, 0))) % REACH == REACH - 1


def units(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last one, and whether it is a whole line, of each unit of a piece."""
    n = len(found.hash)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    start, end = found.start + found.bounds[found.doc], found.end + found.bounds[found.doc]
    breaks = np.zeros(len(found.data) + 1, dtype=np.int64)
    np.cumsum(found.data == ord("\n"), out=breaks[1:])
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (found.doc[1:] != found.doc[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
    line = np.cumsum(fresh) - 1
    line_from = np.flatnonzero(fresh)
    line_to = np.append(line_from[1:], n)
    after = np.append(found.data, np.full(2, ord(" "), dtype=np.uint8))
    same_again = np.append(found.hash[1:] == found.hash[:-1], False)
    last = SENTENCE_END[after[end]] & SPACE[after[end + 1]] & ~same_again
    last |= anchors(found.hash, line) | steps(found.hash, line)
    last[line_to - 1] = True
    to = np.flatnonzero(last) + 1
    begin = np.append(0, to[:-1])
    part = (to - begin >= UNIT_WORDS) & ~(fresh[begin] & (line_to[line[begin]] == to))
    whole = np.append(np.ones(len(line_from), dtype=bool), np.zeros(part.sum(), dtype=bool))
    return np.append(line_from, begin[part]), np.append(line_to, to[part]), whole


#: ``span`` is the number of the unit's first word in its text, its number of words and whether it is a line, in 31, 31
#: and 1 bits.
DIGESTS = "doc_id bigint, text_key bigint, span bigint, one bigint, two bigint"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unit."""
    powers = Powers()
    for batch in batches:
        for first, texts in pieces(batch.column("text")):
            found = words(texts, powers)
            begin, end, whole = units(found)
            doc = found.doc[begin]
            place = begin - np.searchsorted(found.doc, doc)
            rows = pa.array(doc + first)
            one = segment_hashes(found.hash, begin, end, powers)
            two = segment_hashes(mix(found.hash ^ C), begin, end, powers)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(rows),
                    "text_key": batch.column("text_key").take(rows),
                    "span": pa.array((place << 32) | ((end - begin) << 1) | whole),
                    "one": pa.array(one.view(np.int64)),
                    "two": pa.array(two.view(np.int64)),
                }
            )


EDGES = "doc_id bigint, text_key bigint, at bigint, right boolean, first_id bigint, first_key bigint, first_at bigint"


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later units at either end of a stretch that later units cover without a gap, with the same end of the first one."""
    for batch in batches:
        marks = batch.column("_marks")
        row = np.repeat(np.arange(len(marks)), np.asarray(marks.value_lengths()))
        flat = marks.flatten()
        span, first_span = (flat.field(name).to_numpy() for name in ("span", "first_span"))
        order = np.lexsort((span, row))
        row, span, first_span = row[order], span[order], first_span[order]
        size = (span >> 1) & 0x7FFFFFFF
        begin = (row.astype(np.int64) << 32) + (span >> 32)
        reach = np.maximum.accumulate(begin + size)
        fresh = np.ones(len(begin), dtype=bool)
        fresh[1:] = (begin[1:] > reach[:-1]) | (row[1:] != row[:-1])
        stretch = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        ends = reach[np.append(starts[1:], len(begin)) - 1] if len(begin) else reach
        for right in (False, True):
            limit = ends[stretch] == begin + size if right else begin[starts][stretch] == begin
            chosen = np.flatnonzero(limit)
            add = size[chosen] if right else 0
            take, unit = pa.array(row[chosen]), pa.array(order[chosen])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("_id").take(take),
                    "text_key": batch.column("_key").take(take),
                    "at": pa.array((span[chosen] >> 32) + add),
                    "right": pa.array(np.full(len(chosen), right)),
                    "first_id": flat.field("first_id").take(unit),
                    "first_key": flat.field("first_key").take(unit),
                    "first_at": pa.array((first_span[chosen] >> 32) + add),
                }
            )


ANSWERS = "first_id bigint, first_key bigint, first_at bigint, right boolean, near array<int>"


def neighbours(hashes: np.ndarray, at: int, right: bool) -> np.ndarray:
    """32 bits of each of the GROWTH words from a place on, the nearest first."""
    near = hashes[at : at + GROWTH] if right else hashes[max(0, at - GROWTH) : at][::-1]
    return near.astype(np.uint32).view(np.int32)


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside the asked places of a text, once a task for rows equal in id and text."""
    powers, told = Powers(), set()
    for batch in batches:
        asked = batch.column("_asked")
        for first, texts in pieces(batch.column("text")):
            found = words(texts, powers)
            bounds = np.searchsorted(found.doc, np.arange(len(texts) + 1))
            out: dict[str, list] = {"row": [], "first_at": [], "right": [], "near": []}
            for k in range(len(texts)):
                name = (batch.column("doc_id")[first + k].as_py(), batch.column("text_key")[first + k].as_py())
                if name in told:
                    continue
                told.add(name)
                hashes = found.hash[bounds[k] : bounds[k + 1]]
                for place in asked[first + k].as_py():
                    out["row"].append(first + k)
                    out["first_at"].append(place["first_at"])
                    out["right"].append(place["right"])
                    out["near"].append(neighbours(hashes, place["first_at"], place["right"]))
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "first_id": batch.column("doc_id").take(rows),
                    "first_key": batch.column("text_key").take(rows),
                    "first_at": pa.array(out["first_at"], pa.int64()),
                    "right": pa.array(out["right"], pa.bool_()),
                    "near": pa.array(out["near"], pa.list_(pa.int32())),
                }
            )


def removed_words(hashes: np.ndarray, marks: list[dict], grown: list[dict]) -> list[tuple[int, int]]:
    """Ranges of words of a text that go: whole lines, and stretches of PASSAGE_WORDS later words or more."""
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    lines = np.zeros(len(hashes) + 1, dtype=np.int64)
    for mark in marks:
        begin, size = mark["span"] >> 32, (mark["span"] >> 1) & 0x7FFFFFFF
        for counts in (change, lines) if mark["span"] & 1 else (change,):
            counts[begin] += 1
            counts[begin + size] -= 1
    for edge in grown:
        at, right = edge["at"], edge["right"]
        own = neighbours(hashes, at, right)
        near = np.asarray(edge["near"], dtype=np.int32)[: len(own)]
        equal = own[: len(near)] == near
        length = len(equal) if equal.all() else int(equal.argmin())
        change[at if right else at - length] += 1
        change[at + length if right else at] -= 1
    covered, in_line = np.cumsum(change)[:-1] > 0, np.cumsum(lines)[:-1] > 0
    flips = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    for begin, end in flips.reshape(-1, 2):
        if end - begin < PASSAGE_WORDS:
            covered[begin:end] = in_line[begin:end]
    flips = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in flips.reshape(-1, 2)]


REMOVED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with columns _marks (later units) and _grown (words beside their firsts) to texts without what repeats and
    the removed ranges, which count code points of the original text. A null text stays null."""
    powers = Powers()
    for batch in batches:
        text_out: list[str | None] = []
        spans_out: list[list[dict[str, int]]] = []
        marks, grown = batch.column("_marks"), batch.column("_grown")
        for begin, texts in pieces(batch.column("text")):
            found = words(texts, powers)
            bounds = np.searchsorted(found.doc, np.arange(len(texts) + 1))
            originals = batch.column("text").slice(begin, len(texts)).to_pylist()
            for k, original in enumerate(originals):
                own = slice(bounds[k], bounds[k + 1])
                later = marks[begin + k].as_py()
                ranges = removed_words(found.hash[own], later, grown[begin + k].as_py() or []) if later else []
                if not ranges:
                    text_out.append(original)
                    spans_out.append([])
                    continue
                raw, left, at, chars, spans = original.encode(), [], 0, 0, []
                starts = np.append(found.start[own], len(raw))
                for a, b in ranges:
                    start, end = int(starts[a]), int(starts[b])
                    left.append(raw[at:start])
                    chars += len(left[-1].decode())
                    length = len(raw[start:end].decode())
                    spans.append({"start": chars, "length": length})
                    chars, at = chars + length, end
                left.append(raw[at:])
                text_out.append(b"".join(left).decode())
                spans_out.append(spans)
        spans = pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        columns = {"row": batch.column("row"), "text": pa.array(text_out, pa.string()), "removed": spans}
        yield pa.RecordBatch.from_pydict(columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns, which stay) with repeated passages cut out of text.

    Adds column removed, in place of one that is there: ranges (start, length) of the original text in code points.
    Every row stays; a text that repeats wholly becomes empty, a null text stays null. Null ids rank last. Rows equal in
    id and text are one document: they are cut alike. Lines without words stay. No rows give no rows.

    Digests are counted first, by 64 of their 128 bits and without places; only those met twice or more carry their
    places. Each table that a join may have to split by a frequent key is written before it. Of the words beside first
    occurrences only those travel at which a repeated stretch ends."""
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("text_key"), "text")
    found = texts.mapInArrow(digests, DIGESTS)
    often = cut(found.groupBy("one").count().where("count > 1").select(F.col("one").alias("_one")))
    again = cut(found.join(often, found["one"] == often["_one"], "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "span")
    repeated = cut(
        again.groupBy("one", "two")
        .agg(F.min(place).alias("first"), F.max(place).alias("final"))
        .where("first <> final")
        .select(F.col("one").alias("_one"), F.col("two").alias("_two"), "first")
    )
    later = again.join(repeated, (again["one"] == repeated["_one"]) & (again["two"] == repeated["_two"])).where(
        place != F.col("first")
    )
    mark = F.struct(
        "span",
        F.col("first.doc_id").alias("first_id"),
        F.col("first.text_key").alias("first_key"),
        F.col("first.span").alias("first_span"),
    )
    marks = cut(
        later.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
            F.collect_set(mark).alias("_marks")
        )
    )
    open_ends = marks.mapInArrow(edges, EDGES)
    asked = open_ends.groupBy(F.col("first_id").alias("_id"), F.col("first_key").alias("_key")).agg(
        F.collect_set(F.struct("first_at", "right")).alias("_asked")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "removed")]
    rows = docs.select(
        F.struct(*others).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", key.alias("text_key")
    )
    # All columns go into this join as into the last one, so that both read one shuffle of the texts. Tasks that split
    # equal rows between them answer alike; the hash among the keys leaves the next join a shuffle that it may split.
    told = (
        rows.join(asked, same)
        .select("row", "doc_id", "text", "text_key", "_asked")
        .mapInArrow(answers, ANSWERS)
        .groupBy(F.xxhash64("first_key", "first_at").alias("_hash"), "first_id", "first_key", "first_at", "right")
        .agg(F.first("near").alias("near"))
        .drop("_hash")
        .toDF("_first_id", "_first_key", "_first_at", "_right", "near")
    )
    met = (
        F.col("first_id").eqNullSafe(F.col("_first_id"))
        & (F.col("first_key") == F.col("_first_key"))
        & (F.col("first_at") == F.col("_first_at"))
        & (F.col("right") == F.col("_right"))
    )
    grown = (
        open_ends.join(told, met)
        .groupBy(F.col("doc_id").alias("_grown_id"), F.col("text_key").alias("_grown_key"))
        .agg(F.collect_list(F.struct("at", "right", "near")).alias("_grown"))
    )
    of_mark = F.col("_id").eqNullSafe(F.col("_grown_id")) & (F.col("_key") == F.col("_grown_key"))
    work = marks.join(grown, of_mark, "left").select(
        "_id", "_key", F.transform("_marks", lambda m: F.struct(m["span"].alias("span"))).alias("_marks"), "_grown"
    )
    marked = rows.join(work, same, "left").select("row", "text", "_marks", "_grown")
    schema = T.StructType([marked.schema["row"], marked.schema["text"], T.StructField("removed", REMOVED)])
    cleaned = marked.mapInArrow(remove, schema)
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "removed"]
    return cleaned.select(*kept, "removed")
