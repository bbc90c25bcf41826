"""Queries that run streams to the end of what there is, with the SQL of the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans import search
from codeloom.session import shared_dir
from codeloom.streaming import incremental as I


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.indexed(spark, sf_dir).groupBy("doc_id").agg(F.sum("tf").alias("length"))


def _complete(counts: DataFrame, name: str) -> DataFrame:
    """The final state of a stream that is run over all there is, in complete mode: nothing is late."""
    path = _path(counts.sparkSession, name)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = counts.writeStream.foreachBatch(replace).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start()
    query.awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests a user and minute."""
    counts = _complete(I.request_counts(I.file_stream(spark, sf_dir, "events"), "ts", "user_id"), "requests")
    return counts.where("requests > 1").select("user_id", F.col("minute.start").cast("timestamp_ntz").alias("minute"), "requests")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in windows of a day that begin every six hours."""
    counts = _complete(I.sliding_counts(I.file_stream(spark, sf_dir, "events"), "ts", "24 hours", "6 hours"), "sliding")
    return counts.select(F.col("span.start").cast("timestamp_ntz").alias("begins"), "requests")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: a gap of a day ends one."""
    found = _complete(I.sessions(I.file_stream(spark, sf_dir, "events"), "ts", "user_id", "24 hours"), "sessions")
    return found.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("begins"), "events")


QUERIES = {"stream_index": stream_index, "stream_requests": stream_requests, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions}
SQL = {
    "stream_index": search.SQL["doc_lengths"],
    "stream_requests": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1",
    "stream_sliding": "SELECT begins, count(*) AS requests FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS begins FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY ALL",
    "stream_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 24 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS begins, count(*) AS events FROM s GROUP BY user_id, k""",
}
