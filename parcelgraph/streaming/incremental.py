"""Incremental ingest: keyed upserts in micro-batches, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelgraph.operators.relational import latest
from parcelgraph.operators.store import Store

_TABLE, _LAST = "rows", "last_batch"


def keyed_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, once: list[str], always: list[str], order: str, buckets: int = 16) -> StreamingQuery:
    """Merge a stream into the stored table in ``path``.

    A batch rewrites the buckets that it has keys in, beside the old ones, and becomes visible by one
    commit that names the batch too: a crash leaves the version before, and a batch that is run again
    after its commit does nothing. The version before the last is kept. Of rows of one key and
    ``order`` the greatest by the other columns counts.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        tx = store.begin()
        if number <= tx.state["notes"].get(_LAST, -1):
            return
        new = latest(batch, [key], [F.desc(order), *(F.desc(c) for c in [*once, *always])]).select(key, *once, *always)
        tx.merge(_TABLE, new, [key], once=once, always=always, buckets=buckets)
        tx.note(_LAST, number)
        tx.commit()
        store.vacuum(keep=2)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame | None:
    """The table's current version, None before the first batch."""
    return Store(spark, path).read(_TABLE)


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window; those later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
