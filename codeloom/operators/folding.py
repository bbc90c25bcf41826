"""Sequential accumulations as JVM-side folds and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import token_count


def packed_lines(rows: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, part, lines, tokens): greedy groups of a text's non-blank lines, each of at most ``budget`` tokens or one line.

    A fold inside each row: a line that would overflow a group that isn't empty begins the next.  No shuffle.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[ \t\r]", "") != "")
    sizes = F.transform(lines, lambda x: token_count(x))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<int>").alias("groups"), F.lit(1).alias("now"))

    def step(s, n):
        full = (s["total"] > 0) & (s["total"] + n > budget)
        now = F.when(full, s["now"] + 1).otherwise(s["now"])
        return F.struct(F.when(full, n).otherwise(s["total"] + n).alias("total"), F.concat(s["groups"], F.array(now)).alias("groups"), now.alias("now"))

    folded = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, sizes.alias("sizes")).select(key, "sizes", F.aggregate("sizes", start, step)["groups"].alias("groups"))
    each = folded.select(key, F.explode(F.arrays_zip("groups", "sizes")).alias("x"))
    return each.groupBy(key, F.col("x.groups").alias("part")).agg(F.count("*").alias("lines"), F.sum("x.sizes").alias("tokens"))


def runs(rows: DataFrame, partition: list[str], order: list[str], flag: str) -> DataFrame:
    """(partition, run, flag, length): maximal runs of equal flags in order (gaps and islands)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    fresh = F.when(F.col(flag) == F.lag(flag).over(w), 0).otherwise(1)
    numbered = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return numbered.groupBy(*partition, "run", flag).agg(F.count("*").alias("length"))
