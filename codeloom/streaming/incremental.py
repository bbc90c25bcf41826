"""Streams: incremental indexing of arriving documents, deduplicated jobs, and request limits with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.retrieval import postings
from codeloom.session import shared_dir


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of a Parquet table that is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    # watermarks want timestamps of the session's zone
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def index_stream(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Adds the postings of each batch's new documents to the index at ``path``.

    A batch is written under its own number, so a batch that is run again after a failure replaces itself: each
    document is indexed exactly once.  Documents that are in the index already are passed over.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if number:
            known = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < number).select(key).distinct()
            fresh = fresh.join(known, key, "left_anti")
        postings(fresh, key, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()


def indexed(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """The postings of a table that is read as a stream, once all of it has been."""
    import uuid

    path = f"{shared_dir(spark)}/stream-index-{uuid.uuid4().hex}"
    query = index_stream(file_stream(spark, folder, name), path)
    query.awaitTermination()
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def distinct_jobs(jobs: DataFrame, delay: str = "30 days") -> DataFrame:
    """Redelivered job rows once, as long as they are within the watermark: state is bounded by it."""
    return jobs.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id", "status", "created_at"])


def request_counts(requests: DataFrame, at: str, user: str, delay: str = "10 minutes") -> DataFrame:
    """Requests of each user and minute; rows later than the watermark are left out, as state that old is gone."""
    return requests.withWatermark(at, delay).groupBy(F.window(at, "1 minute").alias("minute"), user).agg(F.count("*").alias("requests"))


def sliding_counts(requests: DataFrame, at: str, length: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    """Requests in each window of ``length`` that begins every ``slide``: a row counts in every window that holds it."""
    return requests.withWatermark(at, delay).groupBy(F.window(at, length, slide).alias("span")).agg(F.count("*").alias("requests"))


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events without a gap."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("session"), user).agg(F.count("*").alias("events"))


def run_once(stream: DataFrame, path: str, mode: str = "append", each: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Runs a stream over what there is and gives what it wrote."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if each:
        each(query)
    return stream.sparkSession.read.parquet(path)
