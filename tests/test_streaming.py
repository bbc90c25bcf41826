from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators.retrieval import postings
from codeloom.streaming import incremental as I


def test_index_grows_by_new_documents_only(spark, tmp_path):
    folder, index = tmp_path / "docs.parquet", str(tmp_path / "index")
    first = spark.createDataFrame([(1, "a b a"), (2, "c"), (2, "c")], "doc_id bigint, text string")
    first.coalesce(1).write.parquet(str(folder))
    I.index_stream(I.file_stream(spark, str(tmp_path), "docs"), index).awaitTermination()
    more = spark.createDataFrame([(2, "c"), (3, "d d")], "doc_id bigint, text string")
    more.coalesce(1).write.mode("append").parquet(str(folder))
    I.index_stream(I.file_stream(spark, str(tmp_path), "docs"), index).awaitTermination()
    got = {(r.doc_id, r.term, r.tf) for r in spark.read.parquet(index).select("doc_id", "term", "tf").collect()}
    assert got == {tuple(r) for r in postings(first.union(more).distinct(), "doc_id", "text").collect()}
    assert spark.read.parquet(index).count() == len(got)


def test_windows_and_late_rows(spark, tmp_path):
    rows = [("2024-01-01 10:00:05", 1), ("2024-01-01 10:00:50", 1), ("2024-01-01 10:30:00", 1), ("2024-01-01 12:00:00", 2)]
    df = spark.createDataFrame(rows, "t string, user_id int").select(F.to_timestamp("t").alias("ts"), "user_id")
    df.coalesce(1).write.parquet(str(tmp_path / "ev.parquet"))
    spark.createDataFrame([("2024-01-01 10:00:10", 1), ("2024-01-01 14:00:00", 2)], "t string, user_id int").select(F.to_timestamp("t").alias("ts"), "user_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev.parquet"))
    stream = I.file_stream(spark, str(tmp_path), "ev", files_per_trigger=1)
    got = {(str(r.minute.start), r.user_id, r.requests) for r in I.run_once(I.request_counts(stream, "ts", "user_id"), str(tmp_path / "out")).collect()}
    assert ("2024-01-01 10:30:00", 1, 1) in got and len([g for g in got if g[0] == "2024-01-01 10:00:00"]) == 1
    sessions = I.run_once(I.sessions(I.file_stream(spark, str(tmp_path), "ev"), "ts", "user_id"), str(tmp_path / "s")).collect()
    assert sorted(r.events for r in sessions if r.user_id == 1) in ([1, 3], [4])


def test_redelivered_jobs(spark, tmp_path):
    rows = [(1, "done", "2024-01-01"), (1, "done", "2024-01-01"), (1, "failed", "2024-01-01")]
    spark.createDataFrame(rows, "id int, status string, c string").selectExpr("id", "status", "to_timestamp(c) as created_at").coalesce(1).write.parquet(str(tmp_path / "jobs.parquet"))
    assert I.run_once(I.distinct_jobs(I.file_stream(spark, str(tmp_path), "jobs")), str(tmp_path / "out")).count() == 2
