"""The metadata tables: schema, constraints as queries, cascades, latest states, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: states of jobs and repositories, and columns of the tables
JOB_STATES = ["pending", "in_progress", "completed", "failed"]
REPOSITORY_STATES = ["queued", "cloning", "processing", "ready", "failed"]
TABLES = {
    "users": "id INT, username STRING, email STRING, hashed_password STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "repositories": "id INT, owner_id INT, name STRING, url STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "ingestion_jobs": "id INT, repository_id INT, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "query_logs": "id INT, user_id INT, repository_id INT, query_text STRING, response_text STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
}


def upgrade(spark: SparkSession, database: str) -> None:
    """Creates the metadata tables, as Parquet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def downgrade(spark: SparkSession, database: str) -> None:
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with created_at where it is missing and updated_at now."""
    created = F.coalesce("created_at", F.current_timestamp()) if "created_at" in rows.columns else F.current_timestamp()
    return rows.withColumn("created_at", created).withColumn("updated_at", F.current_timestamp())


def duplicates(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(value, rows) of values of a unique column, letter case aside, that several keys have."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("value")).agg(F.countDistinct(key).alias("rows")).where("rows > 1")


def invalid_states(rows: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """(key, value) whose state is none of the allowed ones as they are written; null states are reported too."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).select(key, F.col(column).alias("value")).distinct()


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is missing; a null reference is none."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def cascade(users: DataFrame, repositories: DataFrame, jobs: DataFrame, logs: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the deleted users (one column, id) and all that hangs on them."""
    gone = deleted.select("id").distinct()
    lost = repositories.join(gone.withColumnRenamed("id", "owner_id"), "owner_id", "left_semi").select("id").distinct()
    by_repository = lost.withColumnRenamed("id", "repository_id")
    return {
        "users": users.join(gone, "id", "left_anti"),
        "repositories": repositories.join(gone.withColumnRenamed("id", "owner_id"), "owner_id", "left_anti"),
        "ingestion_jobs": jobs.join(by_repository, "repository_id", "left_anti"),
        "query_logs": logs.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti").join(by_repository, "repository_id", "left_anti"),
    }


def current_jobs(jobs: DataFrame) -> DataFrame:
    """One row a job id: of redeliveries the last by updated_at (or created_at), ties by state; states in lower case."""
    order = Window.partitionBy("id").orderBy(F.desc(F.coalesce("updated_at", "created_at")), F.desc("created_at"), F.desc(F.lower("status")))
    return jobs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").withColumn("status", F.lower("status"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """(repository_id, job_id, status): each repository's latest job."""
    order = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    return current_jobs(jobs).withColumn("n", F.row_number().over(order)).where("n = 1").select("repository_id", F.col("id").alias("job_id"), "status")


def over_limit(requests: DataFrame, user: str, at: str, limit: int) -> DataFrame:
    """(user, minute, requests): fixed one-minute windows with more requests than the limit."""
    return requests.groupBy(user, F.date_trunc("minute", at).alias("minute")).agg(F.count("*").alias("requests")).where(F.col("requests") > limit)


def normal_url(url: F.Column) -> F.Column:
    """A repository's address without .git and final slashes, in lower case."""
    return F.regexp_replace(F.lower(F.trim(url)), r"(?:\.git)?/*$", "")
