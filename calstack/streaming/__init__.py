"""Series that arrive in micro-batches, appended to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calstack.functions.calendar import Periodicity, periodicity
from calstack.sources.store import Store


def by_slot(stream: DataFrame, time: str, values: dict[str, tuple[str, str]], period: str | Periodicity = "B", delay: str = "2 days", group: list[str] | None = None) -> DataFrame:
    """A stream's rows aggregated by slot and group: header -> (function, column). A
    slot's day is the event time, so that the watermark drops its state in time."""
    calendar = periodicity(period)
    end = calendar.end_column(calendar.ordinal_column(F.col(time).cast("date")))
    keyed = stream.withColumn("date", end.cast("timestamp")).withWatermark("date", delay)
    made = {h: (F.count(c) if f == "count" else getattr(F, f)(c)).cast("double").alias(h) for h, (f, c) in values.items()}
    return keyed.groupBy("date", *(group or [])).agg(*made.values())


def append_to(stream: DataFrame, store: Store, key: str, checkpoint: str, period: str | Periodicity = "B", labels: str | None = None, mode: str = "update", **trigger) -> StreamingQuery:
    """Writes each micro-batch into the store; a batch that runs again writes the same
    slots again."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.write(key, batch, period, labels=labels)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()
