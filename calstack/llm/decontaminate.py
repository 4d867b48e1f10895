"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the word windows of the benchmark items. Tasks cut the benchmark into
blocks of bounded size and write for each the search tables, packed into arrays: for
every pattern length a table of shifts over blocks of two words (one, for patterns of
one word), which says how far the search may skip, and the patterns in buckets by the
hash of their last words, within a bucket by the hash of all. The documents are read
once: a task searches some megabytes of them with each block's tables in turn, skips by
the shifts, looks up the bucket where the shift is zero, and confirms an occurrence by
comparing the words themselves. Only the hits are carried.

Null text: no words. Items without words: no windows. Items with equal windows:
each is reported. Empty benchmark: nothing is hit. Null ids are kept; a null item
id is not reported. Repeated rows: equal rows. Empty table: no rows. Texts and words of
any length are searched whole.
"""

from __future__ import annotations

import io
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calstack.llm.common import fresh, new_path, small_batches
from calstack.llm.wordhash import Sequences, U, chunks, word_hashes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Benchmark bytes in a block, whose tables take about five times as many, and bytes of
#: documents that are searched with one block after another.
BLOCK_BYTES, GROUP_BYTES = 8_000_000, 8_000_000
#: Of a byte: whether it belongs to a word, after A-Z have become a-z.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Words:
    """The words of some texts: their bytes, places and hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.bytes = b"\n".join(texts).lower()
        buf = np.frombuffer(self.bytes, np.uint8)
        inside = np.concatenate(([False], IN_WORD[buf], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.stops = edge[::2], edge[1::2]
        self.hashes = word_hashes(buf, self.starts, self.stops)
        self.sequences = Sequences(self.hashes)
        #: The first word of each text, and the end.
        self.bounds = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))

    def of(self, first: int, count: int) -> list[bytes]:
        return [self.bytes[a:b] for a, b in zip(self.starts[first : first + count].tolist(), self.stops[first : first + count].tolist(), strict=True)]


def tables(items: list[tuple[str | None, bytes]], window: int) -> dict[str, np.ndarray]:
    """The packed search tables of some items (id, text)."""
    words = Words([t for _, t in items])
    counts = np.diff(words.bounds)
    made = {
        "names": np.frombuffer(json.dumps([i for i, _ in items]).encode(), np.uint8),
        "bytes": np.frombuffer(words.bytes, np.uint8),
        "starts": words.starts.astype(np.int32 if len(words.bytes) < 1 << 31 else np.int64),
        "sizes": (words.stops - words.starts).astype(np.int32),
    }
    sizes = np.minimum(counts, window)
    made["lengths"] = np.unique(sizes[sizes > 0]).astype(np.int64)
    for m in made["lengths"].tolist():
        own = np.flatnonzero(sizes == m)
        many = counts[own] - m + 1
        first = np.arange(int(many.sum())) + np.repeat(words.bounds[own] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        item = np.repeat(own, many).astype(np.int32)
        whole = words.sequences.runs(first, m)
        block = min(2, m)
        suffix = words.sequences.runs(first + m - block, block)
        order = np.lexsort((item, whole, suffix))
        new = np.ones(len(order), bool)  # a window that an item repeats is there once
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (item[order][1:] != item[order][:-1]) | (suffix[order][1:] != suffix[order][:-1])
        order = order[new]
        bits = max(10, math.ceil(math.log2(4 * len(first) + 1)))
        shifts = np.full(1 << bits, m - block + 1, np.uint8)
        for end in range(block, m + 1):  # the largest shifts first, so that the least stays
            np.minimum.at(shifts, (words.sequences.runs(first + end - block, block) >> U(64 - bits)).astype(np.int64), m - end)
        made |= {f"shifts{m}": shifts, f"suffix{m}": suffix[order], f"whole{m}": whole[order], f"first{m}": first[order].astype(np.int32), f"item{m}": item[order]}
    return made


class Searcher:
    """The search with the tables of one block."""

    def __init__(self, made: dict[str, np.ndarray]) -> None:
        self.made = made
        self.names = json.loads(made["names"].tobytes())
        self.bytes = made["bytes"].tobytes()

    def words(self, first: int, count: int) -> list[bytes]:
        starts, sizes = self.made["starts"][first : first + count].tolist(), self.made["sizes"][first : first + count].tolist()
        return [self.bytes[a : a + n] for a, n in zip(starts, sizes, strict=True)]

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, int, list[str]]]:
        """(text, first word in it, length, ids of the items) of every occurrence."""
        bounds = words.bounds.tolist()
        for m in self.made["lengths"].tolist():
            block, n = min(2, m), len(words.hashes)
            if n < m:
                continue
            table, suffixes = self.made[f"shifts{m}"], words.sequences.runs(np.arange(n - block + 1), block)
            shifts = [0] * (block - 1) + table[(suffixes >> U(65 - len(table).bit_length())).astype(np.int64)].tolist()
            texts, ends = [], []
            for text, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                at = a + m - 1
                while at < b:
                    if step := shifts[at]:
                        at += step
                    else:
                        texts.append(text)
                        ends.append(at)
                        at += 1
            if not ends:
                continue
            first = np.array(ends) - m + 1
            whole, suffix = words.sequences.runs(first, m), suffixes[first + m - block]
            low, high = (np.searchsorted(self.made[f"suffix{m}"], suffix, side) for side in ("left", "right"))
            for k in np.flatnonzero(high > low).tolist():
                bucket = self.made[f"whole{m}"][low[k] : high[k]]
                a, b = np.searchsorted(bucket, whole[k], "left"), np.searchsorted(bucket, whole[k], "right")
                if a == b:
                    continue
                here, found, equal = words.of(int(first[k]), m), [], {}
                for x in range(int(low[k] + a), int(low[k] + b)):
                    at = int(self.made[f"first{m}"][x])
                    if equal.setdefault(at, self.words(at, m) == here):
                        found.append(self.names[int(self.made[f"item{m}"][x])])
                if found:
                    yield texts[k], int(first[k]) - bounds[texts[k]], m, found


def searchers(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Writes the search tables of the benchmark, block by block, into the shared folder;
    their paths."""
    spark = benchmark.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("string")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text.alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    path = new_path(spark, "searchers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context, held, size, names = TaskContext.get(), [], 0, []

        def flush() -> None:
            own, out = f"{root}/{context.partitionId():06d}-{len(names):05d}.npz", io.BytesIO()
            np.savez(out, **tables(held, window))
            with store.open_output_stream(f"{own}.{context.taskAttemptId()}") as file:
                file.write(out.getvalue())
            if store.get_file_info(own).is_file:
                store.delete_file(own)
            store.move(f"{own}.{context.taskAttemptId()}", own)
            names.append(own.rsplit("/", 1)[-1])

        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((item, t.encode("utf-8", "surrogatepass")))
                size += len(held[-1][1]) + 64
                if size >= block_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    made = items.repartition(max(1, math.ceil(size / block_bytes))).mapInArrow(run, "name string").collect()
    return [f"{path}/{r.name}" for r in made]


def marked(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with three columns more at its end: the number of words, the positions of
    the words inside an occurrence of a window, and the ids, as strings in order, of the
    items whose windows occur (n_words, hits and items, if free)."""
    if not 0 < window < 256:
        raise ValueError("windows are of 1 to 255 words")
    paths = searchers(benchmark, window, item_col, item_text_col, block_bytes)
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    own = [fresh(docs, c) for c in ("n_words", "hits", "items")]
    names = [*docs.columns, *own]

    def load(path: str) -> Searcher:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as file, np.load(io.BytesIO(file.read())) as made:
            return Searcher(dict(made))

    def search(group: list[pa.RecordBatch], loaded: list[Searcher]) -> Iterator[pa.RecordBatch]:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for batch in group for t in batch.column(place)]
        parts = [(first, Words(part)) for first, part in chunks(texts)]
        hits: list[set[int]] = [set() for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for path in paths:
            searcher = loaded[0] if loaded else load(path)
            for first, words in parts:
                for text, at, m, found in searcher.occurrences(words):
                    hits[first + text].update(range(at, at + m))
                    items[first + text].update(x for x in found if x is not None)
        counts = np.concatenate([np.diff(words.bounds) for _, words in parts]) if parts else np.zeros(0, np.int64)
        at = 0
        for batch in group:
            stop = at + batch.num_rows
            more = [pa.array(counts[at:stop], pa.int64()), pa.array([sorted(x) for x in hits[at:stop]], pa.list_(pa.int32())), pa.array([sorted(x) for x in items[at:stop]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [load(path) for path in paths] if len(paths) == 1 else []
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if len(paths) <= 1 or size >= GROUP_BYTES:
                yield from search(group, loaded)
                group, size = [], 0
        yield from search(group, loaded)

    schema = T.StructType([*docs.schema.fields, T.StructField(own[0], T.LongType()), T.StructField(own[1], T.ArrayType(T.IntegerType())), T.StructField(own[2], T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, hits, items) of every document; see `marked`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return marked(rows, benchmark, window, "text", item_col, item_text_col, block_bytes).drop("text")
