"""What the operators share: stored intermediate tables, row keys, batch sizes."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python: small, as one text may be long.
BATCH_ROWS = 256
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_OWN_FOLDER: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir;
    a temporary folder of this machine only where that is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_FOLDER:
        _OWN_FOLDER[key] = "file://" + tempfile.mkdtemp(prefix="calstack-")
    return _OWN_FOLDER[key]


def new_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clean_up(spark: SparkSession) -> None:
    """Removes what this session's operators have written into the shared folder.
    Call it when their results have been written elsewhere: they read these tables."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: what was
    computed survives lost executors, and the lineage ends here. A table that it was
    computed from and that nothing else reads can be given up for it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    made = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(made)] = path
    weakref.finalize(made, _PATHS.pop, id(made), None)
    if instead_of is not None:
        remove(spark, _PATHS[id(instead_of)])
    return made


@contextmanager
def only_last_kept(spark: SparkSession) -> Iterator[None]:
    """Removes the tables stored inside but the last, which holds what they were for."""
    first = len(_WRITTEN)
    yield
    for path in _WRITTEN[first:-1]:
        remove(spark, path)
    del _WRITTEN[first:-1]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of stages that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, which may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    if not root.is_dir():  # it came in such an archive itself
        return
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    at = Path(tempfile.mkdtemp(prefix="calstack-code-")) / f"{root.name}.zip"
    at.write_bytes(packed.getvalue())
    context.addPyFile(str(at))


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds, in the JVM and in Python; called
    before any Python runs on the executors. Frames read the setting when they are
    acted on, so all operators share this one value and it stays for the session."""
    ship(spark)
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows in a batch, for the actions inside; restored after them."""
    ship(spark)
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_scan(df: DataFrame) -> bool:
    """Whether `df` only selects from stored files, so that its rows come in the same
    order and partitions each time that it is computed."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.child()
    return node.nodeName() in ("LogicalRelation", "DataSourceV2ScanRelation") or node.nodeName().startswith("Relation")


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number that is unique and the same each time the table is read,
    whatever ids the rows carry; what is not a plain scan of files is stored first.
    How files are cut into partitions must not follow the number of executors that
    happen to be alive, so it is fixed here."""
    if not is_scan(df):
        df = stored(df, "rows")
    conf, least = df.sparkSession.conf, "spark.sql.files.minPartitionNum"
    if conf.get(least, None) is None:
        conf.set(least, str(df.sparkSession.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())
