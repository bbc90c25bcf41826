"""Session helpers: reading tables, the shared folder, and written intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.cteRecursionLevelLimit", "100")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as a lazily read Parquet relation."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session has none (tests, local runs) a temporary folder is set.
    """
    context = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not have:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = getattr(context, "_codeloom_dir", None)
        if have is None:
            have = context._codeloom_dir = "file://" + tempfile.mkdtemp(prefix="codeloom-")
            context.setCheckpointDir(have)
    return have.rstrip("/")


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """The driver's JVM removes the folder when it ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors; removed when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, source: str | list[str], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of one or several source tables, built once for each state of the sources' files and read from the shared folder afterwards."""
    files = []
    for each in [source] if isinstance(source, str) else source:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(each)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files += sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where))
    path = f"{shared_dir(spark)}/{name}-{hashlib.sha256(repr(files).encode()).hexdigest()[:32]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
        _delete_on_exit(spark, path)
    return spark.read.parquet(path)
