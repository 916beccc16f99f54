"""The feed as a stream: micro-batches of features applied one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from curbstone.plans.jobs import EVERY, Jobs
from curbstone.sources.feed import FeedSource


def features(jobs: Jobs, feed: str, where: str = "1=1", page_size: int | None = None) -> DataFrame:
    """Features (object_id, feature) of a "module:function" feed as a stream; its offset is the last OBJECTID."""
    jobs.spark.dataSource.register(FeedSource)
    reader = jobs.spark.readStream.format("keyset_feed").option("feed", feed).option("where", where)
    return reader.option("pageSize", page_size or jobs.page_size).load()


def ingest(jobs: Jobs, rows: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Applies each micro-batch of rows (feature) as a run's pages are applied.

    A batch that runs again after a failure changes nothing: its versions are known by their hashes, and each batch is one
    commit. With the keyset source a trigger takes one page, so it runs on processing time until it is stopped.
    """
    run = {"id": 0, "job": "stream"}

    def batch(df: DataFrame, number: int) -> None:
        if df.take(1):
            jobs.apply(df.select("feature"), run, jobs.now(), values={"stream.batch": number})

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every or f"{int(EVERY.total_seconds())} seconds").start()
