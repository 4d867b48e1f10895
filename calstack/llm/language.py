"""Language identification by hierarchical discrimination.

Texts become hashed counts of their bytes' 1- to 3-grams (lower-cased, square
roots, unit length). A first set of one-versus-one linear support vector machines
votes on the language family, a second set on the language within it. The models
are fitted on a bounded sample of labelled rows, those of smallest hash of id and
text in each language, so the sample does not depend on the order or place of rows.

Null text and text without a letter: `und`, score 0. Labels null: not learned
from; nor are texts without a letter. Rows that repeat id and text count once in the
sample. No labelled row at all: every text is `und`. One language in a family, or
one family: that one is taken. Ties go to the first in order of name. Null ids are
kept. Only the id, text and language columns are read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from calstack.llm.common import fresh, small_batches

UNDETERMINED = "und"
BITS = 13
#: Bounds of the sample that the models are fitted on: rows of all languages
#: together, and at least so many of each.
SAMPLE_ROWS, LEAST_ROWS = 1600, 24
#: Language codes of the families told apart first.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa sa si ur",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return FAMILY_OF.get(re.split(r"[-_]", lang.lower())[0], "other")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a whole text: positions and values."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(data), 1 << 16):
        part = data[i : i + (1 << 16) + 2].astype(np.uint32)
        own = min(1 << 16, len(data) - i)
        code = part.copy()
        for n in (1, 2, 3):
            if n > 1:
                code = code[:-1] * np.uint32(257) + part[n - 1 :] + np.uint32(n << 24)
            spread = (code[:own] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            counts += np.bincount(spread, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at].astype(np.float64))
    return at, value / max(1e-12, float(np.sqrt((value * value).sum())))


def machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 120) -> np.ndarray:
    """A linear support vector machine (squared hinge, labels 1 and -1, classes
    weighed equally) by accelerated gradient steps; the last column of x is 1, and
    the last weight the bias."""
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype) * cost
    step = x.dtype.type(1.0 / (1.0 + 2.0 * cost * 2.0))
    w = z = np.zeros(x.shape[1], x.dtype)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * ((weigh * y * slack) @ x))
        w, z = new, new + x.dtype.type(t / (t + 3)) * (new - w)
    return w


class Votes:
    """One-versus-one machines over some classes."""

    def __init__(self, classes: list[str], x: np.ndarray, labels: np.ndarray) -> None:
        self.classes = sorted(classes)
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        weights = []
        for i, j in self.pairs:
            own = np.isin(labels, (self.classes[i], self.classes[j]))
            weights.append(machine(x[own], np.where(labels[own] == self.classes[i], 1, -1).astype(x.dtype)))
        self.weights = np.array(weights).T if weights else None

    def decide(self, at: np.ndarray, value: np.ndarray) -> tuple[str, float]:
        """The class with most votes, larger margins first among equals, and how
        sure its machines are, from 0 to 1."""
        if self.weights is None:
            return self.classes[0], 1.0
        margin = value @ self.weights[at] + self.weights[-1]
        votes, sure = np.zeros(len(self.classes)), np.ones(len(self.classes))
        chance = 1 / (1 + np.exp(-4 * margin.clip(-30, 30)))
        for (i, j), m, p in zip(self.pairs, margin.tolist(), chance.tolist(), strict=True):
            votes[i if m >= 0 else j] += 1
            sure[i] = min(sure[i], p)
            sure[j] = min(sure[j], 1 - p)
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sure[k], -k))
        return self.classes[best], float(sure[best])


class Model:
    """The machines of the families and of the languages within each, fitted on rows
    that are given as one sparse matrix (`at` and `value` cut by `offsets`)."""

    def __init__(self, labels: list[str], offsets: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        x = np.zeros((len(labels), (1 << BITS) + 1), np.float32)
        x[np.repeat(np.arange(len(labels)), np.diff(offsets)), at] = value
        x[:, -1] = 1
        names = np.array(labels, object)
        families = np.array([family(n) for n in labels], object)
        self.families = Votes(sorted(set(families.tolist())), x, families) if labels else None
        self.within = {}
        for f in sorted(set(families.tolist())):
            own = families == f
            classes = sorted(set(names[own].tolist()))
            self.within[f] = Votes(classes, x[own] if len(classes) > 1 else x[:0], names[own])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.families is None or not any(m[0].isalpha() for m in LETTER.finditer(text)):
            return UNDETERMINED, 0.0
        vector = features(text)
        name, sure = self.families.decide(*vector)
        lang, more = self.within[name].decide(*vector)
        return lang, sure * more


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The sample is of distinct (language, id, text) with a letter in the text: in
    each language those of smallest hash, found on hashes alone; only its texts are
    then read, and rows that repeat one of them are dropped where they are."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    labelled = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col) & text.rlike(r"\p{L}"))
    texts = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    rows = texts.withColumn("t", F.xxhash64("text")).withColumn("h", F.xxhash64("id", "t"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    each = max(LEAST_ROWS, sample_rows // max(1, len(counts)))
    # hashes are spread evenly: so small a one leaves about twice the rows wanted, wherever they are
    limits = [(r["lang"], int(-(2**63) + min(1.0, 2 * each / r["n"]) * (2**64 - 2048))) for r in counts]
    few = rows.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long")), "lang").where("h <= most")
    ranked = few.select("lang", "h", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= each)
    chosen = rows.join(F.broadcast(ranked.select("lang", "h", "id")), ["lang", "h", "id"]).groupBy("lang", "id", "h").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))], ["id", "lang", "h", "at", "value"])

    few_tasks = chosen.select("id", "lang", "text", "h").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    found = few_tasks.mapInArrow(vectors, "id string, lang string, h long, at array<int>, value array<float>").toArrow()
    sample = found.sort_by([("lang", "ascending"), ("id", "ascending"), ("h", "ascending")]).combine_chunks()
    if not sample.num_rows:
        return Model([], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    at, value = sample.column("at").combine_chunks(), sample.column("value").combine_chunks()
    return Model(sample.column("lang").to_pylist(), at.offsets.to_numpy(), at.flatten().to_numpy(), value.flatten().to_numpy())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with the language and the score as its two last columns (__lang and
    __score, if free), in one pass over whole texts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    own = [fresh(docs, "__lang"), fresh(docs, "__score")]
    names = [*docs.columns, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m for m, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(own[0], T.StringType()), T.StructField(own[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, fitted on those not held out."""
    model = fit(docs, id_col, text_col, lang_col, sample_rows)
    found = predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return found.select("id", held_out("id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
