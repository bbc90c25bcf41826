"""Query planning: classification, decomposition, routing, execution order and synthesis, as expressions and joins."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import written

# fixed values: what the wording of a question tells; the first that matches decides
LOOKUP = r"(?i)(?:^|[^A-Za-z])(?:where is|where are|defined|definition of|signature of|what does|dónde|où est|onde está|wo ist|que fait|qué hace|was macht|o que)(?:$|[^A-Za-z])"
STRUCTURAL = r"(?i)(?:^|[^A-Za-z])(?:call|calls|callers?|called|imports?|inherits?|depends?|reaches|llaman|appellent|chamam|rufen)(?:$|[^A-Za-z])"
IMPACT = r"(?i)(?:^|[^A-Za-z])(?:break|breaks|impact|affect|affects|if i chang\w*|changed|changing)(?:$|[^A-Za-z])"
EXPLORE = r"(?i)(?:^|[^A-Za-z])(?:explain|how does|how do|how the|overview|why|describe|architecture|warum|pourquoi|por qué|por que)(?:$|[^A-Za-z])"
IDENTIFIER = r"\b[A-Za-z]+_[A-Za-z0-9_]+\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"


def query_type(text: Column) -> Column:
    """simple-lookup, multi-hop or exploratory; what is unclear is multi-hop."""
    return F.when(text.rlike(STRUCTURAL) | text.rlike(IMPACT), "multi-hop").when(text.rlike(EXPLORE), "exploratory").when(text.rlike(LOOKUP), "simple-lookup").otherwise("multi-hop")


def confidence(text: Column) -> Column:
    """0.9 where one kind's wording matches, 0.6 where several do, 0.3 where none does."""
    kinds = (text.rlike(STRUCTURAL) | text.rlike(IMPACT)).cast("int") + text.rlike(EXPLORE).cast("int") + text.rlike(LOOKUP).cast("int")
    return F.when(kinds == 1, 0.9).when(kinds > 1, 0.6).otherwise(0.3)


def strategy(text: Column) -> Column:
    """structural questions go to the graph, identifiers to BM25, plain ones to vectors; questions with both marks to hybrid."""
    structural = text.rlike(STRUCTURAL) | text.rlike(IMPACT)
    return F.when(structural & text.rlike(EXPLORE), "hybrid").when(structural, "graph").when(text.rlike(IDENTIFIER), "bm25").when(F.length(F.trim(text)) > 0, "vector").otherwise("hybrid")


def plan_steps(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, step, text, expected, context_from): one step for a lookup, three for a multi-hop, two for an exploratory question."""
    t = F.col(text)

    def step(number: int, words: Column, expected: str, after: list[int]) -> Column:
        needs = F.array(*[F.lit(a) for a in after]) if after else F.array().cast("array<int>")
        return F.struct(F.lit(number).alias("step"), words.alias("text"), F.lit(expected).alias("expected"), needs.alias("context_from"))

    subject = F.coalesce(F.nullif(F.regexp_extract(t, f"({IDENTIFIER})", 1), F.lit("")), t)
    single = F.array(step(1, t, "location", []))
    hops = F.array(step(1, F.concat(F.lit("Where is "), subject, F.lit(" defined?")), "location", []), step(2, F.concat(F.lit("Which code reaches "), subject, F.lit("?")), "symbols", [1]), step(3, t, "explanation", [1, 2]))
    wide = F.array(step(1, F.concat(F.lit("Find the parts about "), subject), "chunks", []), step(2, t, "explanation", [1]))
    steps = F.when(query_type(t) == "simple-lookup", single).when(query_type(t) == "exploratory", wide).otherwise(hops)
    return questions.where(F.length(F.trim(t)) > 0).select(key, F.explode(steps).alias("s")).select(key, "s.*")


def levels(steps: DataFrame, key: str) -> DataFrame:
    """(key, step, level): the longest chain of dependencies before each step; a cycle's steps have none and are left out."""
    ready = written(steps.select(key, "step", F.size("context_from").alias("needs"), "context_from").distinct(), "steps")
    done = written(ready.where("needs = 0").select(key, "step", F.lit(0).alias("level")), "levels")
    for level in itertools.count(1):
        waiting = ready.join(done.select(key, "step"), [key, "step"], "left_anti")
        met = waiting.select(key, "step", "needs", F.explode("context_from").alias("dep")).join(done.select(key, F.col("step").alias("dep")), [key, "dep"])
        new = met.groupBy(key, "step", "needs").agg(F.countDistinct("dep").alias("met")).where("met = needs").select(key, "step", F.lit(level).alias("level"))
        new = written(new, "levels")
        if new.isEmpty():
            break
        done = written(done.unionByName(new), "levels")
    return done


def execute(steps: list[dict], run: Callable[[dict, dict[int, object]], object]) -> dict[int, object]:
    """Results of one plan's steps in the order of their dependencies; a step that fails is tried once more, then skipped.

    ``run`` gets the step and the results of those that it depends on.  A plan has a handful of steps; each result is a lazy DataFrame.
    """
    results: dict[int, object] = {}
    pending = {s["step"]: s for s in steps}
    skipped: set[int] = set()
    while pending:
        ready = [n for n, s in sorted(pending.items()) if all(d in results or d in skipped for d in s["context_from"])]
        if not ready:
            raise ValueError("the steps depend on each other in a cycle")
        for n in ready:
            s = pending.pop(n)
            for attempt in range(2):
                try:
                    results[n] = run(s, {d: results[d] for d in s["context_from"] if d in results})
                    break
                except Exception:  # noqa: BLE001
                    if attempt:
                        skipped.add(n)
    return results


def synthesise(results: DataFrame, query_key: str, key: str, step: str = "step") -> DataFrame:
    """One row a chunk over all steps: the best score, and the steps that found it."""
    return results.groupBy(query_key, key).agg(F.max("score").alias("score"), F.array_sort(F.collect_set(step)).alias("steps"))
