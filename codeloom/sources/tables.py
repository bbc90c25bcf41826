"""Readers and sinks of the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_QUERIES = "query string, expected_type string, expected_file string, expected_function string, expected_files array<string>, expected_functions array<string>, expected_callees array<string>"


def sample_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions: one JSON array of objects."""
    return spark.read.option("multiLine", True).schema(SAMPLE_QUERIES).json(path)


def payloads(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("payload"))


def save_payloads(rows: DataFrame, path: str) -> None:
    """JSON lines, one object a row."""
    rows.write.mode("overwrite").json(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """A Parquet table with the new rows in place of those of equal key; written beside the old one, which stays until it is read no more."""
    from codeloom.operators.retrieval import upsert
    from codeloom.session import written

    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.parquet(path)
        return spark.read.parquet(path)
    merged = written(upsert(old, new, key), "upsert")  # the old files may be replaced only once the result exists
    merged.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
