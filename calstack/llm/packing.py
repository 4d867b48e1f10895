"""Token ids packed into rows of fixed width, written as binary files.

A task collects documents until it holds `shard_tokens` ids, cuts documents longer
than a row into pieces, and packs the pieces best fit decreasing: each goes into the
open row with the least room that still holds it, found with a segment tree over
the rooms. A shard is written as three little-endian files: the id matrix, the
cumulative segment lengths of its rows, and the position resets, which say where a
segment starts and how far into its document. Files are moved to their names when
complete, and a task that runs again writes the same ones.

Null text: no segment. Empty text: a segment of the end mark alone. Null ids: a
segment like others, its id null. Repeated rows: a segment each. Empty table: no
files, no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calstack.llm.common import small_batches, stored

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to those ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
WIDTH, SHARD_TOKENS = 2048, 1 << 21


class Rooms:
    """Open rows by the room they have left, in a segment tree: the smallest room of
    at least some size is found in as many steps as the tree is high."""

    def __init__(self, width: int) -> None:
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def change(self, room: int, by: int) -> None:
        at, count = room + self.size, self.count
        while at:
            count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self.change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of at least `least`, the one
        last put there; it is taken out."""
        at, count, size = least + self.size, self.count, self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - size
        row = self.rows[room].pop()
        self.change(room, -1)
        return room, row


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers: longest pieces first, equal ones in order."""
    rooms, rows = Rooms(width), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[piece])
        if found is None:
            room, row = width, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > lengths[piece]:
            rooms.put(room - lengths[piece], row)
    return rows


def pieces(lengths: list[int], width: int) -> list[tuple[int, int, int]]:
    """(document, first token, stop) of pieces of at most a row, covering all."""
    return [(doc, a, min(a + width, n)) for doc, n in enumerate(lengths) for a in range(0, n, width)]


def tokenizer(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


RESULT = "file string, row_no int, n_tokens int, doc_ids array<{kind}>, first_tokens array<int>, cu_seqlens array<int>, ids_sha256 string"


def write(docs: DataFrame, path: str, ranks_path: str = RANKS, width: int = WIDTH, shard_tokens: int = SHARD_TOKENS, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, packs and writes every document under `path`, a folder that all
    executors share; a row for each packed row: its file and number, the documents
    of its segments and the token each begins at, cumulative lengths, and the digest
    of its ids (padding, which is `end` too, left out). The files are complete when
    the frame is returned: it reads the rows again that their task stored, so acting
    on it writes nothing. Ids are 16 bits wide if all of the vocabulary fit, else 32."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        merges = f.read()
    ranks = spark.sparkContext.broadcast(merges)
    largest = max([end, *(int(line.split()[1]) for line in merges.splitlines() if line)])
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(root: str, store, name: str, ids: list, tokens: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        parts = pieces([len(t) for t in tokens], width)
        packed = best_fit([b - a for _, a, b in parts], width)
        matrix = np.full((len(packed), width), end, dtype)
        sums, resets, digests = [], [], []
        for r, row in enumerate(packed):
            at, sums_here = 0, [0]
            for doc, a, b in (parts[p] for p in row):
                matrix[r, at : at + b - a] = tokens[doc][a:b]
                resets.append((r, at, a))
                at += b - a
                sums_here.append(at)
            sums.append(sums_here)
            digests.append(hashlib.sha256(matrix[r, :at].astype("<u4").tobytes()).hexdigest())
        flat = np.concatenate([np.array([len(s), *s], "<i4") for s in sums])
        for suffix, data in (("ids", matrix), ("cu", flat), ("resets", np.array(resets, "<i4"))):
            own = f"{root}/{name}.{suffix}.bin"
            with store.open_output_stream(f"{own}.{TaskContext.get().taskAttemptId()}") as out:
                out.write(data.tobytes())
            if store.get_file_info(own).is_file:
                store.delete_file(own)
            store.move(f"{own}.{TaskContext.get().taskAttemptId()}", own)
        columns = [
            pa.array([name] * len(packed)),
            pa.array(range(len(packed)), pa.int32()),
            pa.array([s[-1] for s in sums], pa.int32()),
            pa.array([[ids[parts[p][0]] for p in row] for row in packed], pa.list_(id_type)),
            pa.array([[parts[p][1] for p in row] for row in packed], pa.list_(pa.int32())),
            pa.array(sums, pa.list_(pa.int32())),
            pa.array(digests),
        ]
        return pa.RecordBatch.from_arrays(columns, ["file", "row_no", "n_tokens", "doc_ids", "first_tokens", "cu_seqlens", "ids_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        encode = tokenizer(ranks.value).encode_to_numpy
        part, number, ids, tokens, held = TaskContext.get().partitionId(), 0, [], [], 0
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                ids.append(i)
                tokens.append(np.append(encode(text, disallowed_special=()).astype(np.uint32), np.uint32(end)))
                held += len(tokens[-1])
                if held >= shard_tokens:
                    yield pack(root, store, f"part-{part:06d}-{number:04d}", ids, tokens, id_type)
                    number, ids, tokens, held = number + 1, [], [], 0
        if ids:
            yield pack(root, store, f"part-{part:06d}-{number:04d}", ids, tokens, id_type)

    return stored(rows.mapInArrow(run, RESULT.format(kind=kind)), "packed-rows")


READ = pa.schema([("file", pa.string()), ("row_no", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("first_tokens", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])


def read(spark, path: str, width: int = WIDTH) -> DataFrame:
    """(file, row_no, cu_seqlens, first_tokens, ids): the rows of the files again, which
    tasks open by themselves."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids.bin").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                own = at.removesuffix(".ids.bin")
                ids, cu, resets = (store.open_input_file(f"{own}.{part}.bin").read() for part in ("ids", "cu", "resets"))
                flat, starts, at = np.frombuffer(cu, "<i4"), np.frombuffer(resets, "<i4").reshape(-1, 3), 0
                n = int(starts[-1, 0]) + 1
                matrix = np.frombuffer(ids, "<u2" if len(ids) == 2 * n * width else "<u4").reshape(n, width)
                bounds = np.searchsorted(starts[:, 0], np.arange(n + 1))
                out = []
                for r in range(n):
                    sums = flat[at + 1 : at + 1 + flat[at]]
                    at += 1 + flat[at]
                    out.append({"file": own.rsplit("/", 1)[-1], "row_no": r, "cu_seqlens": sums.tolist(), "first_tokens": starts[bounds[r] : bounds[r + 1], 2].tolist(), "ids": matrix[r, : sums[-1]].tolist()})
                yield pa.RecordBatch.from_pylist(out, schema=READ)

    return files.mapInArrow(run, "file string, row_no int, cu_seqlens array<int>, first_tokens array<int>, ids array<int>")
