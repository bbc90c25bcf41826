"""Retrieval and answer metrics over ranked results and relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import terms
from codeloom.operators.context import CITATION, claims


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """(query_key, recall, precision, reciprocal_rank, ndcg) at k for each query with judgements.

    ``ranked`` has query_key, key, rank (from 1); ``relevant`` has query_key, key.  Precision divides by k, gains are binary, the
    discount is log2(rank + 1).  A query of which nothing was retrieved scores 0.
    """
    gold = relevant.select(query_key, key).distinct()
    sizes = gold.groupBy(query_key).agg(F.count("*").alias("n_relevant"))
    return metrics_of_hits(ranked.select(query_key, key, "rank").join(gold, [query_key, key]), sizes, query_key, k)


def metrics_of_hits(hits: DataFrame, sizes: DataFrame, query_key: str, k: int) -> DataFrame:
    """``retrieval_metrics`` of relevant results alone (query_key, rank), where ``sizes`` (query_key, n_relevant) tells how many there were to find."""
    per = hits.where(F.col("rank") <= k).groupBy(query_key).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = sizes.join(per, query_key, "left").fillna(0, ["hits", "dcg"])
    return joined.select(
        query_key, F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def summary(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric; one row a group."""
    aggregates = [f for c in columns for f in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev(c), F.lit(0.0)), 6).alias(f"{c}_std"))]
    return metrics.groupBy(*by).agg(*aggregates) if by else metrics.agg(*aggregates)


def compared(metrics: DataFrame, strategy: str, metric: str, baseline: str) -> DataFrame:
    """(strategy, mean, delta): each strategy's mean, and how far it is from the baseline's."""
    means = metrics.groupBy(strategy).agg(F.avg(metric).alias("mean"))
    base = means.where(F.col(strategy) == baseline).select(F.col("mean").alias("base"))  # one row
    return means.crossJoin(base).select(strategy, F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.col("base"), 6).alias("delta"))


def containment(claim: Column, context: Column) -> Column:
    """The default judge: the share of a claim's distinct terms that the context has."""
    c = F.array_distinct(terms(claim))
    return F.round(F.when(F.size(c) > 0, F.size(F.array_intersect(c, F.array_distinct(terms(context)))) / F.size(c)).otherwise(0.0), 6)


def faithfulness(answers: DataFrame, key: str, answer: str, context: str, judge=containment, least: float = 0.6) -> DataFrame:
    """(key, claims, supported, faithfulness, hallucination): claims of an answer that its context supports.

    ``judge`` scores a claim against the context from 0 to 1: an expression, or a pandas UDF with a model in it.  A claim's own citations are not
    judged; an answer without claims has neither rate; a null context supports nothing.
    """
    bare = F.transform(claims(F.col(answer)), lambda c: F.regexp_replace(c, CITATION, " "))
    each = answers.select(key, F.coalesce(F.col(context), F.lit("")).alias("context"), F.posexplode_outer(bare).alias("number", "claim"))
    judged = each.withColumn("held", F.when(F.col("claim").isNotNull(), judge(F.col("claim"), F.col("context")) >= least))
    out = judged.groupBy(key).agg(F.count("claim").alias("claims"), F.count_if("held").alias("supported"))
    rate = F.when(F.col("claims") > 0, F.round(F.col("supported") / F.col("claims"), 6))
    return out.withColumn("faithfulness", rate).withColumn("hallucination", F.round(1 - rate, 6))


def failure_class(retrieved: Column, faithful: Column, tokens: Column, budget: int, least: float = 0.5) -> Column:
    """overflow, retrieval, generation or success: the first cause that holds."""
    return F.when(tokens > budget, "overflow").when(~retrieved, "retrieval").when(faithful < least, "generation").otherwise("success")


def latency(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Exact 50th, 95th and 99th percentiles of each group."""
    points = [F.round(F.percentile(column, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return rows.groupBy(*by).agg(F.count("*").alias("requests"), *points)
