"""A sorted set over a DataFrame: distinct elements in order of (score, element)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "element string, score double"


def lexical_bound(element: Column, bound: str, upper: bool) -> Column:
    """- and + are open ends; [x includes x, (x does not."""
    if bound in ("-", "+"):
        return F.lit((bound == "+") == upper)
    if bound[:1] not in ("[", "("):
        raise ValueError(f"{bound!r} begins with neither [ nor (")
    x, closed = F.lit(bound[1:]), bound[0] == "["
    if upper:
        return element <= x if closed else element < x
    return element >= x if closed else element > x


class SortedSet:
    """Every change gives a new set; nothing is computed before it is asked for."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    @classmethod
    def of(cls, spark: SparkSession, scores: dict[str, float] | None = None) -> SortedSet:
        return cls(spark.createDataFrame([(k, float(v)) for k, v in (scores or {}).items()], SCHEMA))

    def new(self, scores: dict[str, float]) -> DataFrame:
        return self.frame.sparkSession.createDataFrame([(k, float(v)) for k, v in scores.items()], SCHEMA)

    def add(self, **scores: float) -> SortedSet:
        """Elements get these scores, whether they were there or not."""
        new = self.new(scores)
        return SortedSet(self.frame.join(F.broadcast(new), "element", "left_anti").unionByName(new))

    def increment(self, element: str, by: float = 1.0) -> SortedSet:
        """Adds to an element's score, from 0 if it is new."""
        both = self.frame.unionByName(self.new({element: by}))
        return SortedSet(both.groupBy("element").agg(F.sum("score").alias("score")))

    def remove(self, *elements: str) -> SortedSet:
        return SortedSet(self.frame.where(~F.col("element").isin(list(elements))))

    def score(self, element: str) -> float | None:
        row = self.frame.where(F.col("element") == element).first()
        return None if row is None else row["score"]

    def card(self) -> int:
        return self.frame.count()

    def rank(self, element: str) -> int | None:
        """How many elements come before this one."""
        own = self.score(element)
        if own is None:
            return None
        before = (F.col("score") < own) | ((F.col("score") == own) & (F.col("element") < element))
        return self.frame.where(before).count()

    def ranked(self) -> DataFrame:
        """element, score and rank of all. A sample cuts the order into ranges, their
        sizes are counted, and each range is then ranked by itself."""
        parts = int(self.frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sample = self.frame.orderBy(F.xxhash64("element"), "element").limit(8 * parts).select("score", "element").collect()
        cuts = sorted((r["score"], r["element"]) for r in sample)[8::8]
        place = F.struct("score", "element")
        bounds = F.array(*(F.struct(F.lit(s).alias("score"), F.lit(e).alias("element")) for s, e in cuts))
        part = F.size(F.filter(bounds, lambda b: b <= place)) if cuts else F.lit(0)
        cut = self.frame.withColumn("_part", part)
        sizes = dict(cut.groupBy("_part").count().collect())
        offsets = F.create_map(*(F.lit(x) for i in sizes for x in (i, sum(n for j, n in sizes.items() if j < i)))) if sizes else None
        rank = F.row_number().over(Window.partitionBy("_part").orderBy("score", "element")) - 1
        return cut.withColumn("rank", rank if offsets is None else offsets[F.col("_part")] + rank).drop("_part")

    def ordered(self, frame: DataFrame, reverse: bool = False) -> DataFrame:
        return frame.orderBy(*([F.desc("score"), F.desc("element")] if reverse else ["score", "element"]))

    def range_by_rank(self, start: int = 0, end: int = -1, reverse: bool = False) -> DataFrame:
        """Ranks from start to end, both included, negative ones from the end."""
        size = self.card()
        low, high = (x + size if x < 0 else x for x in (start, end))
        if reverse:
            low, high = size - 1 - high, size - 1 - low
        low, high = max(0, low), min(size - 1, high)
        if high < low:
            return self.frame.limit(0)
        return self.ordered(self.ordered(self.frame).offset(low).limit(high - low + 1), reverse)

    def range_by_score(self, least: float = float("-inf"), most: float = float("inf"), start: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
        """Scores from least to most, both included; start and count are applied in
        ascending order, before a reversal."""
        found = self.ordered(self.frame.where(F.col("score").between(least, most))).offset(start)
        return self.ordered(found if count is None else found.limit(count), reverse)

    def lexadd(self, *elements: str) -> SortedSet:
        return self.add(**dict.fromkeys(elements, 0.0))

    def within(self, low: str, high: str) -> DataFrame:
        e = F.col("element")
        return self.frame.where(reduce(lambda a, b: a & b, [F.col("score") == 0, lexical_bound(e, low, False), lexical_bound(e, high, True)]))

    def range_by_lex(self, low: str = "-", high: str = "+", start: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
        """Elements of score 0 between two bounds."""
        found = self.ordered(self.within(low, high), reverse).offset(start)
        return found if count is None else found.limit(count)

    def lexrange(self, low: str = "-", high: str = "+", start: int = 0, count: int | None = None) -> list[str]:
        return [r["element"] for r in self.range_by_lex(low, high, start, count).collect()]

    def lexrevrange(self, high: str = "+", low: str = "-", start: int = 0, count: int | None = None) -> list[str]:
        return [r["element"] for r in self.range_by_lex(low, high, start, count, True).collect()]

    def lexcard(self, low: str = "-", high: str = "+") -> int:
        return self.within(low, high).count()
