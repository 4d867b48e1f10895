"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints of equal bits are contracted first. Two fingerprints with at most
`distance` differing bits differ in at most distance // 3 bits of one of three
disjoint bit masks, so each mask gets a forest of its own, searched with that
smaller radius: vantage points cut the fingerprints into shards by their masked
Hamming distance, a fingerprint near a cut also goes to the shard behind it, and
within a shard a vantage-point tree prunes every branch that the triangle
inequality excludes. Shards emit a spanning forest of their exact links, never
all pairs; components come from star contraction over those links.

Null text and text without words: fingerprint 0, linked like any other. Null
ids: a row gets its component, but never names one. Repeated rows: equal rows.
Empty table: no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calstack.llm.common import batches_of, small_batches, stored

SEED = 42
MASKS = 3
#: Distinct fingerprints that a shard is meant to hold: few, for as many shards as
#: there are shuffle partitions, and otherwise at most so many.
FEW_ROWS, SHARD_ROWS = 20_000, 1_000_000
LEAF = 48
#: Edges that a task turns into stars at once, at first and when it gathers those of
#: several tasks.
CHUNK_EDGES, LAST_EDGES = 65_536, 1 << 19


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
        np.uint64,
        n,
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.nonzero(2 * ones > n)[0].tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per document, fp the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def masks() -> list[int]:
    """Three disjoint masks over the 64 bits, each bit in one of them by turns."""
    return [sum(1 << b for b in range(64) if b % MASKS == m) for m in range(MASKS)]


def vantage_points(mask: int, count: int) -> np.ndarray:
    """Fixed points, the same on every executor and in every run."""
    rng = np.random.default_rng([SEED, mask % (1 << 32)])
    return rng.integers(0, 1 << 63, count, np.int64).view(np.uint64) * np.uint64(2) & np.uint64(mask)


def shards_of(fps: np.ndarray, cuts: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): each fingerprint's own shard of each mask and those behind a
    cut that a fingerprint within `radius` of it may lie behind."""
    rows, codes = [], []
    for m, mask in enumerate(masks()):
        middle = bin(mask).count("1") // 2
        row, code = np.arange(len(fps)), np.full(len(fps), m, np.int64)
        for v in vantage_points(mask, cuts):
            d = np.bitwise_count((fps[row] ^ v) & np.uint64(mask)).astype(np.int64)
            above = d > middle
            near = ~above & (d > middle - radius)
            row = np.concatenate((row, row[near]))
            code = np.concatenate((code * 2 + above, code[near] * 2 + 1))
        rows.append(row)
        codes.append(code + (m << 40))
    return np.concatenate(rows), np.concatenate(codes)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def tree_pairs(keys: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of distinct masked values within `radius` bits: all
    of them as queries to a vantage-point tree over them. A node's children hold
    the points at one distance from its vantage point; a query visits those whose
    distance differs from its own by at most the radius."""
    todo = [(np.arange(len(keys)), np.arange(len(keys)))]
    while todo:
        points, queries = todo.pop()
        if len(points) <= LEAF or len(queries) <= 8:
            for i in range(0, len(queries), 8192):
                q = queries[i : i + 8192]
                near = np.bitwise_count(keys[q][:, None] ^ keys[points][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b = q[a], points[b]
                yield a[a < b], b[a < b]
            continue
        vantage = keys[points[len(points) // 2]]
        dp = np.bitwise_count(keys[points] ^ vantage)
        dq = np.bitwise_count(keys[queries] ^ vantage).astype(np.int64)
        for band in np.unique(dp).tolist():
            ask = queries[np.abs(dq - band) <= radius]
            if len(ask):
                todo.append((points[dp == band], ask))


def shard_links(fps: np.ndarray, mask: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `fps` (distinct, uint64) that differ in
    at most distance // 3 bits of the mask: pairs of positions."""
    radius = distance // MASKS
    order = np.argsort(fps & np.uint64(mask), kind="stable")
    sorted_fps = fps[order]
    keys, start = np.unique(sorted_fps & np.uint64(mask), return_index=True)
    stop = np.append(start[1:], len(fps))
    forest, linked = Forest(len(fps)), []

    def link(x: int, y: int) -> None:
        if forest.find(x) != forest.find(y):
            forest.join(x, y)
            linked.append((x, y))

    for g in np.nonzero(stop - start > 1)[0].tolist():  # of equal masked bits: grow, taking out what is reached
        left = np.arange(start[g], stop[g])
        while len(left) > 1:
            reached, left = [int(left[0])], left[1:]
            while reached and len(left):
                p = reached.pop()
                near = np.bitwise_count(sorted_fps[left] ^ sorted_fps[p]) <= distance
                for x in left[near].tolist():
                    link(p, x)
                    reached.append(x)
                left = left[~near]
    single = stop - start == 1
    for a, b in tree_pairs(keys, np.uint64(mask), radius):
        alone = single[a] & single[b]
        x, y = start[a[alone]], start[b[alone]]
        near = np.bitwise_count(sorted_fps[x] ^ sorted_fps[y]) <= distance
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            link(i, j)
        for g, h in zip(a[~alone].tolist(), b[~alone].tolist(), strict=True):
            if stop[g] - start[g] > stop[h] - start[h]:
                g, h = h, g
            many = np.arange(start[h], stop[h])
            for x in range(int(start[g]), int(stop[g])):
                mine = forest.find(x)
                near = many[np.bitwise_count(sorted_fps[many] ^ sorted_fps[x]) <= distance]
                for y in near.tolist():
                    if forest.find(y) != mine:
                        link(x, y)
                        mine = forest.find(x)
    return [(int(order[x]), int(order[y])) for x, y in linked]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (column fp) of each
    component of "at most `distance` differing bits"."""
    count, partitions = max(1, fps.count()), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(count / SHARD_ROWS, min(count / FEW_ROWS, partitions / MASKS))
    cuts = max(0, math.ceil(math.log2(shards)))
    all_masks = masks()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, shard = shards_of(fp.view(np.uint64), cuts, distance // MASKS)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[row])], ["shard", "fp"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        found = shard_links(fp.view(np.uint64), all_masks[int(key[0].as_py()) >> 40], distance)
        a, b = (np.array([fp[p[i]] for p in found], np.int64) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    dealt = fps.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes: each node with the smallest that it reaches,
    itself left out. A round hangs every root on a smaller one next to it, if there is
    one, so that at least half of those that can go do."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(root[u], root[v]), root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new, root):
            hangs = root != np.arange(len(nodes))
            return nodes[hangs], nodes[root[hangs]]
        root = new


def contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """`edges` (a, b) with every `chunk` or so of a partition turned into stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rows += batch.num_rows
            if rows >= chunk or (batch is None and rows):
                made = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, rows = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of `edges` (a, b; no nulls) with the smallest node that
    it is connected to. Tasks turn bounded chunks of edges into stars first, then larger
    chunks of what several of them have left, as long as that halves the edges. If one
    chunk is left, its stars are the result. Otherwise alternating star contraction: each
    round hangs a node's larger, then its smaller neighbours on the smallest; it ends
    when nothing changes. A round is several jobs, which the driver keeps account of."""
    spark = edges.sparkSession
    with batches_of(spark, CHUNK_EDGES):
        now = stored(contracted(edges.where("a <> b"), CHUNK_EDGES), "edges")
        left, before = now.count(), math.inf
        while 2 * left <= before:
            tasks = max(1, math.ceil(left / LAST_EDGES))
            now = stored(contracted(now.coalesce(tasks), LAST_EDGES + 1), "edges", now)
            if tasks == 1:
                return now.selectExpr("a AS node", "b AS root")
            left, before = now.count(), left
        now = stored(now.distinct(), "edges", now)

    def seen_in(now: DataFrame):
        return now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()

    state = seen_in(now)
    for _ in range(rounds):
        both = now.union(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.selectExpr("b AS a", "m AS b").union(joined.selectExpr("a", "m AS b"))
        now = stored(small.where("a <> b").distinct(), "edges", now)
        seen = seen_in(now)
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.selectExpr("a AS node", "b AS root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that the document
    reaches over links of at most `distance` differing bits, its own included."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct, distance))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = labelled.join(named, "root").select("fp", "component_id")
    return fps.join(per_fp, "fp").select("id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """The 16 lower-case hex digits of a signed fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
