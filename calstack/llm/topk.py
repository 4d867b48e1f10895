"""Exact top-k inner products by No-Random-Access aggregation.

The queries are written as blocks of bounded size into the shared folder; every task
holds a bounded part of the candidates and reads the query blocks one after another,
so nothing passes the driver. A part keeps one list per dimension, sorted by
component. A query reads each list in turn from the end that its own component's sign
prefers, step by step. For every vector a running score of the components read so far
is kept; what is unread lies between the list's other end and the value last read from
it, which bounds the whole score from below and above. Vectors whose upper bound is
under the k-th best lower bound cannot qualify and are dropped; when few are left, or
all is read, the final scores of those left are resolved. A step adds the newly read
entries of many queries and vectors with one product of matrices.

Vectors that are null or hold null or non-finite components, and rows without an id,
take no part. Vectors of other dimensions than a query's are not its candidates; those
without components score 0 with each other. Ties go to the smaller id. Rows that share
a query's id are its own; a repeated query row is answered for each row. A score beyond
64 bits is ranked as it is and returned as null. Empty table: no rows. Only the two
named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calstack.llm.common import is_scan, new_path, small_batches, stored

#: Rows of a part of the candidates, of a block of queries, and queries read for at once.
PART_ROWS, QUERY_ROWS, AT_ONCE = 16_384, 4096, 256
#: How far the lists are read by each step, as parts of their length.
STEPS = (0.125, 0.25, 0.5, 0.75, 1.0)
#: A query is resolved when so many vectors can still qualify.
FEW = 64


def quantised(vector: list[float] | np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as doubles that are whole numbers."""
    return np.floor(float(scale) * np.asarray(vector, np.float64))


def exact(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Inner products of the rows of a and b, whatever their size."""
    if not a.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return [int(s) for s in np.einsum("ij,ij->i", a, b)]
    return [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]


class Lists:
    """The sorted lists of a part of the vectors (n x d)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, float, list[tuple[int, int]]]]:
        """(number of the query, part of the lists read for it, [(score, id), best first])."""
        for i in range(0, len(queries), AT_ONCE):
            yield from self.read(np.arange(i, min(i + AT_ONCE, len(queries))), query_ids, queries, k)

    def read(self, left: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, float, list[tuple[int, int]]]]:
        n, alive, before = len(self.ids), np.arange(len(self.ids)), 0
        up, down = np.maximum(queries[left], 0), np.minimum(queries[left], 0)
        running = np.zeros((len(left), n))  # score of the components read so far
        size = np.abs(queries[left]).sum(axis=1) * float(np.abs(self.vectors).max(initial=1.0))
        slack = 1e-12 * np.maximum(1.0, size)
        for part in STEPS:
            depth = max(1, math.ceil(n * part))
            v, rank = self.vectors[alive], self.rank[alive]
            high, low = rank >= n - depth, rank < depth  # read from the upper or the lower end
            running += up @ np.where(high & (rank < n - before), v, 0).T + down @ np.where(low & (rank >= before), v, 0).T
            # of the unread: at worst the list's other end, at best the value last read
            unread_up, unread_down = (~high).T.astype(np.float64), (~low).T.astype(np.float64)
            lower = running + (up * self.sorted[0]) @ unread_up + (down * self.sorted[-1]) @ unread_down
            upper = running + (up * self.sorted[n - depth]) @ unread_up + (down * self.sorted[depth - 1]) @ unread_down
            own = query_ids[left][:, None] == self.ids[alive][None, :]
            lower[own] = -np.inf
            best = np.partition(lower, len(alive) - k, axis=1)[:, len(alive) - k] if len(alive) > k else np.full(len(left), -np.inf)
            able = (upper >= (best - slack)[:, None]) & ~own
            done = (able.sum(axis=1) <= max(FEW, k)) | (depth >= n)
            for row in np.flatnonzero(done).tolist():
                at = alive[able[row]]
                scores = exact(self.vectors[at], np.broadcast_to(queries[left[row]], (len(at), queries.shape[1])))
                found = sorted(zip([-s for s in scores], self.ids[at].tolist(), strict=True))[:k]
                yield int(left[row]), depth / n, [(-s, x) for s, x in found]
            stay = able[~done].any(axis=0)  # outsiders of all queries left are not read on
            left, up, down, slack, running = left[~done], up[~done], down[~done], slack[~done], running[~done][:, stay]
            alive, before = alive[stay], depth
            if not len(left):
                return


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(finite)


def ordered(score: int) -> str:
    """A text that sorts as the whole numbers do, of whatever size."""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if score >= 0 else "0" + text.translate(str.maketrans("0123456789", "9876543210"))


ANSWER = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("key", pa.string()), ("score", pa.string()), ("lists_read", pa.float64())])


def answers(rows: DataFrame, queries: str, k: int, scale: int, query_rows: int) -> DataFrame:
    """The best k of every part of the candidates, for each row of the query files at a
    path: (query, query_id, id, key, score, lists_read)."""
    path = re.sub(r"^file:/+", "file:///", queries)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
        for file in files:
            with store.open_input_file(file) as handle:
                for batch in pq.ParquetFile(handle).iter_batches(query_rows, columns=["query", "id", "v"]):
                    yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), [quantised(v.values.to_numpy(zero_copy_only=False), scale) for v in batch.column(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, quantised(v.values.to_numpy(zero_copy_only=False), scale)) for batch in batches for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        lists = {}
        for size in sorted({len(v) for _, v in held}):
            own = [(i, v) for i, v in held if len(v) == size]
            lists[size] = Lists(np.array([i for i, _ in own], np.int64), np.array([v for _, v in own]).reshape(len(own), size))
        del held
        for numbers, ids, asked in blocks() if lists else ():
            out = []
            for size, own in lists.items():
                which = [j for j, v in enumerate(asked) if len(v) == size]
                if which:
                    for j, depth, found in own.search(ids[which], np.array([asked[j] for j in which]).reshape(len(which), size), k):
                        out += [{"query": int(numbers[which[j]]), "query_id": int(ids[which[j]]), "id": x, "key": ordered(s), "score": str(s), "lists_read": depth} for s, x in found]
            yield pa.RecordBatch.from_pylist(out, schema=ANSWER)

    return rows.mapInArrow(run, "query long, query_id long, id long, key string, score string, lists_read double")


def search(vectors: DataFrame, is_query: str = "id % 50 = 0", k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score, lists_read): for each row that `is_query` (SQL over
    id) selects, its k rows of highest inner product of quantised vectors, and how much
    of the lists was read to find the row, from 0 to 1."""
    spark = vectors.sparkSession
    small_batches(spark)
    if not is_scan(vectors):
        vectors = stored(vectors.select(id_col, vector_col), "vectors")
    rows = usable(vectors, id_col, vector_col)
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    path = new_path(spark, "queries")
    rows.where(is_query).withColumn("query", F.monotonically_increasing_id()).write.parquet(path)
    # dealt by a hash of all, so that rows of one id are not one task's
    dealt = rows.repartition(max(parts, spark.sparkContext.defaultParallelism), "id", F.col("v"))
    found = answers(dealt, path, k, scale, query_rows)
    order = Window.partitionBy("query").orderBy(F.desc("key"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", F.expr("try_cast(score AS BIGINT)").alias("score"), "lists_read")
