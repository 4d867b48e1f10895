"""Duplicate word passages by Relative Lempel-Ziv parsing.

Every window of `window` words is anchored at the smallest hash among its
`anchor`-word sequences, so equal windows have equal anchors wherever they stand.
Consecutive windows with one anchor form a phrase. The reference is the set of
distinct phrases whose anchor occurs more than once, cut into blocks by anchor: a
factor of `window` words or more lies in the block of its anchor and in no other, so
a document that meets the blocks of its anchors has met every block.

A phrase that the reference holds a second time is a factor as a whole. Another one
is parsed against its block, greedily from the left: the places of the window that
begins at a word are looked up in the block's index, the factor grows word by word
while one of these places agrees, the words themselves being compared, and the
longest one counts. The windows that begin in a factor and end behind it, at the
factor's boundary, are looked up in turn. Factors of at least `window` words are the
duplicate spans. Anchors with more than BLOCK_PHRASES distinct phrases are not kept
together in one block. Their distinct phrases are cut again, at an anchor of more words
(`finer`), into pieces. A piece that occurs twice is a factor as a whole, one whose anchor
no other piece has holds no factor, and of each distinct one of the others the windows are
counted by hash: this finds the same, as equal windows have equal finer anchors too.

Whole phrases and pieces are named by 128 bits of hash (anchor and words), counted
windows by 128 bits. Null text: no words. Fewer words than a window: nothing is removed.
Repeated rows are duplicates of each other. Null ids are kept. Words may be of any
length. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calstack.llm.common import small_batches, stored, with_row
from calstack.llm.wordhash import Sequences, chunks, hashed

#: Distinct phrases of one anchor that are parsed in a block, and phrases of a block.
BLOCK_PHRASES, BLOCK_ROWS = 256, 40_000
#: What a document is told of a phrase: it is a factor as a whole, it stands in a block
#: for others or to be parsed itself, or the same by pieces and counted windows.
WHOLE, REFERENCE, PENDING, COUNTED = 0, 1, 2, 4
#: A phrase of a document as one long: first window times 64, plus the number of windows.
PACK = 64


def encoded(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def phrases(texts: list[bytes], window: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window, number of windows, anchor hash, phrase hash) arrays."""
    span = window - anchor + 1
    for first, part in chunks(texts):
        hashes, at = hashed(part)
        n = len(hashes) - window + 1
        if n <= 0:
            continue
        seq = Sequences(hashes)
        grams = seq.runs(np.arange(len(hashes) - anchor + 1), anchor)
        place = np.empty(n, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, span)
        for i in range(0, n, 1 << 14):
            place[i : i + (1 << 14)] = view[i : i + (1 << 14)].argmin(axis=1)
        place += np.arange(n)
        owner = np.repeat(np.arange(len(part)), np.diff(at))
        valid = owner[:n] == owner[window - 1 :]
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:n] != owner[: n - 1])
        begin = np.flatnonzero(new & valid)
        if not len(begin):
            continue
        run = np.cumsum(new) - 1
        count = np.bincount(run[valid], minlength=int(run[-1]) + 1)[run[begin]]
        yield first + owner[begin], begin - at[owner[begin]], count, grams[place[begin]], seq.runs(begin, count + window - 1)


def reference(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, phrase, row, at): every phrase of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for text, begin, count, a, phrase in phrases(encoded(batch.column(1)), window, anchor):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(rows[text]), pa.array(begin * PACK + count)], ["a", "phrase", "row", "at"])

    return docs.select("row", "text").mapInArrow(run, "a long, phrase long, row long, at long")


def finer(window: int, anchor: int) -> int:
    """Words of the anchor at which phrases of too frequent an anchor are cut again: with
    fewer, more pieces share one and more windows are counted; with more, there are more
    pieces."""
    return anchor + 3 * (window - anchor) // 4


def cut_again(hashes: np.ndarray, hot: list[tuple[int, int, bool]], window: int, anchor: int) -> list[dict]:
    """The pieces of phrases (first window, number of windows, whether to be parsed) of a
    text: consecutive windows with one anchor, in `at` as phrases (-1 if not to be parsed)."""
    one, two = (Sequences(hashes, k) for k in (0, 1))
    out = []
    for begin, count, pending in hot:
        grams = one.runs(np.arange(begin, begin + count + window - anchor), anchor)
        place = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(axis=1) + np.arange(count)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        number = np.diff(np.append(first, count))
        at = (begin + first) * PACK + number if pending else np.full(len(first), -1)
        w1, w2 = (k.runs(np.arange(begin, begin + count), window).view(np.int64).tolist() for k in (one, two))
        a, phrase = grams[place[first]].view(np.int64), two.runs(begin + first, number + window - 1).view(np.int64)
        for x, y, z, i, n in zip(a.tolist(), phrase.tolist(), at.tolist(), first.tolist(), number.tolist(), strict=True):
            out.append({"a": x, "phrase": y, "at": z, "windows": [{"w1": u, "w2": v} for u, v in zip(w1[i : i + n], w2[i : i + n], strict=True)]})
    return out


def covered(n: int, starts: list[int], stops: list[int]) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:n]) > 0


def kept(text: bytes, drop: np.ndarray) -> tuple[int, str]:
    """Number of words removed, digest of the others."""
    words = text.split()
    if drop.any():
        words = [words[i] for i in np.flatnonzero(~drop).tolist()]
    return int(drop.sum()), hashlib.sha256(b" ".join(words)).hexdigest()


def spans(starts: np.ndarray) -> list[list[int]]:
    """Maximal [first, stop) of the words marked."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], starts.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


RESULT = "row long, id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>"


def parse(joined: DataFrame, kind: str, window: int, anchor: int) -> DataFrame:
    """Marks the whole factors of each document (row, id, text, factors); a document
    with phrases to be parsed keeps its text. Lists the words of phrases for the
    blocks, and the pieces of those whose windows are counted."""
    schema = RESULT.format(kind=kind) + ", text string, known array<long>, phrases array<struct<a:long,at:long,words:binary>>, pieces array<struct<a:long,phrase:long,at:long,windows:array<struct<w1:long,w2:long>>>>"
    windows_type = pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64())]))
    pieces_type = pa.struct([("a", pa.int64()), ("phrase", pa.int64()), ("at", pa.int64()), ("windows", windows_type)])
    phrases_type = pa.struct([("a", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text, told in zip(encoded(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words, whole, wait, sent, hot = text.split(), [], False, [], []
                for item in told or []:
                    at, told_kind, a = item["at"] >> 3, item["at"] & 7, item["a"]
                    begin, count = at // PACK, at % PACK
                    wait |= bool(told_kind & PENDING)
                    if told_kind == WHOLE:
                        whole.append(at)
                    elif told_kind & COUNTED:
                        hot.append((begin, count, bool(told_kind & PENDING)))
                    else:
                        sent.append({"a": a, "at": at if told_kind == PENDING else -1, "words": b" ".join(words[begin : begin + count + window - 1])})
                pieces = cut_again(hashed([text])[0], hot, window, finer(window, anchor)) if hot else []
                known = np.array(whole, np.int64)
                drop = covered(len(words), known // PACK, known // PACK + known % PACK + window - 1)
                done = (None, None) if wait else kept(text, drop)
                row = (len(words), *done, None if wait else spans(drop), text.decode("utf-8", "surrogatepass") if wait else None, whole if wait else None, sent, pieces)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.string(), pa.list_(pa.int64()), pa.list_(phrases_type), pa.list_(pieces_type)]
            names = ["row", "id", "n_words", "n_removed", "kept_sha256", "spans", "text", "known", "phrases", "pieces"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names)

    return joined.mapInArrow(run, schema)


def greedy(block: list[bytes], window: int, parsed: list[bool]) -> Iterator[tuple[int, int, int]]:
    """(phrase, first window, number of windows) of the factors of the phrases that are
    `parsed`, each the longest from where it begins; a phrase is not its own reference
    at the same place."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    windows: list[list[bytes]] = []
    for p, text in enumerate(block):
        starts = [0]
        for word in text.split(b" "):
            starts.append(starts[-1] + len(word) + 1)
        windows.append([text[a : b - 1] for a, b in zip(starts, starts[window:], strict=False)])
        for i, key in enumerate(windows[-1]):
            index.setdefault(key, []).append((p, i))
    for p, own in enumerate(windows):
        i = 0 if parsed[p] else len(own)
        while i < len(own):
            first, places = i, [x for x in index[own[i]] if x != (p, i)]
            while places:
                i += 1
                if i == len(own):
                    break
                places = [(q, j + 1) for q, j in places if j + 1 < len(windows[q]) and windows[q][j + 1] == own[i]]
            if i > first:
                yield p, first, i - first
            else:
                i += 1


def in_blocks(phrases_: DataFrame, window: int) -> DataFrame:
    """(row, at): the factors of (row, a, at, words), block by block; at as in phrases."""
    blocks = max(1, -(-phrases_.count() // BLOCK_ROWS))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("a").combine_chunks()
        anchors = table.column("a").to_numpy()
        edges = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])) if len(anchors) else []
        rows, places = [], []
        for a, b in zip(edges, [*edges[1:], len(anchors)], strict=True):
            part = table.slice(int(a), int(b - a))
            row, at = part.column("row").to_pylist(), part.column("at").to_pylist()
            for p, first, count in greedy(part.column("words").to_pylist(), window, [x >= 0 for x in at]):
                rows.append(row[p])
                places.append((at[p] // PACK + first) * PACK + count)
        return pa.table({"row": pa.array(rows, pa.int64()), "at": pa.array(places, pa.int64())})

    block = F.pmod(F.xxhash64("a"), F.lit(blocks))
    return phrases_.groupBy(block.alias("block")).applyInArrow(search, "row long, at long")


def in_pieces(pieces: DataFrame) -> DataFrame:
    """(row, at): the factors of pieces (row, a, phrase, at, windows); at as in phrases."""
    # stored, as in duplicate_passages
    named = pieces.groupBy("a", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first"), F.first("windows").alias("windows"))
    named = stored(named, "pieces")
    several = stored(named.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a"), "several_pieces")
    whole = pieces.where("at >= 0").join(named.where("n > 1").select("a", "phrase"), ["a", "phrase"]).select("row", "at")
    listed = named.join(several, "a").select(F.col("first.row").alias("row"), F.when(F.col("n") == 1, F.col("first.at")).otherwise(-1).alias("at"), F.posexplode("windows").alias("i", "w"))
    windows = stored(listed.selectExpr("row", "w.w1", "w.w2", f"if(at < 0, -1, (at div {PACK} + i) * {PACK} + 1) AS at"), "windows")
    again = stored(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "again")
    return whole.union(windows.where("at >= 0").join(again, ["w1", "w2"]).select("row", "at"))


def finish(waiting: DataFrame, kind: str, window: int) -> DataFrame:
    """The documents that waited for the factors of their phrases (row, id, n_words, text,
    known, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, marked = [], [], []
            for text, known, hits in zip(encoded(batch.column(3)), batch.column(4), batch.column(5), strict=True):
                at = np.array([*(known.as_py() or []), *(hits.as_py() or [])], np.int64)
                drop = covered(len(text.split()), at // PACK, at // PACK + at % PACK + window - 1)
                n, digest = kept(text, drop)
                removed.append(n)
                digests.append(digest)
                marked.append(spans(drop))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(marked, pa.list_(pa.list_(pa.int32())))], ["row", "id", "n_words", "n_removed", "kept_sha256", "spans"])

    return waiting.mapInArrow(run, RESULT.format(kind=kind))


def duplicate_passages(docs: DataFrame, window: int = 35, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, n_removed, kept_sha256, spans): spans are the [first, stop)
    words covered by a window that starts anywhere else too, kept_sha256 the
    digest of the other words joined by one space."""
    if window - anchor + 1 >= PACK or anchor < 1 or anchor > window:
        raise ValueError("anchor must leave 1 to 63 sequences in a window")
    small_batches(docs.sparkSession)
    rows = with_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "row").select("row", "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    pieces = reference(rows, window, anchor)
    # stored, so that the join has exchanges of its own and a hot anchor can be split
    twice = stored(pieces.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors")
    known = stored(pieces.join(twice, "a"), "phrases")
    distinct = stored(known.groupBy("a", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first")), "distinct")
    whole = known.join(distinct.where("n > 1").select("a", "phrase"), ["a", "phrase"]).selectExpr("row", f"at * 8 + {WHOLE} AS at", "0L AS a")
    several = stored(distinct.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "several")
    told = F.expr(f"first.at * 8 + if(n > 1, {REFERENCE}, {PENDING}) + if(m > {BLOCK_PHRASES}, {COUNTED}, 0)")
    parts = distinct.join(several, "a").select("first.row", told.alias("at"), "a")
    per_doc = whole.union(parts).groupBy("row").agg(F.collect_list(F.struct("at", "a")).alias("factors"))
    parsed = stored(parse(rows.join(per_doc, "row", "left"), kind, window, anchor), "parsed")
    blocked = stored(in_blocks(parsed.select("row", F.explode("phrases").alias("p")).select("row", "p.*"), window), "factors")
    counted = in_pieces(parsed.select("row", F.explode("pieces").alias("p")).select("row", "p.*"))
    hits = blocked.union(counted).groupBy("row").agg(F.collect_list("at").alias("hits"))
    waiting = parsed.where("text IS NOT NULL").select("row", "id", "n_words", "text", "known").join(hits, "row", "left")
    done = parsed.where("text IS NULL").select("row", "id", "n_words", "n_removed", "kept_sha256", "spans")
    return done.union(finish(waiting.select("row", "id", "n_words", "text", "known", "hits"), kind, window))
