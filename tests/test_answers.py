from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from codeloom.operators import context as C
from codeloom.operators import evaluation as E
from codeloom.operators import folding
from codeloom.operators import metadata as D
from codeloom.operators import planning as P


def test_planning(spark):
    rows = [(1, "Where is parse_file defined?"), (2, "What would break if I changed UserStore?"), (3, "Explain how parsing works"), (4, "zzz"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "id int, q string")
    got = {r.id: (r.t, r.c, r.s) for r in df.select("id", P.query_type(F.col("q")).alias("t"), P.confidence(F.col("q")).alias("c"), P.strategy(F.col("q")).alias("s")).collect()}
    assert got[1] == ("simple-lookup", 0.9, "bm25") and got[2][0] == "multi-hop" and got[2][2] == "graph" and got[3][0] == "exploratory" and got[4] == ("multi-hop", 0.3, "vector")
    steps = P.plan_steps(df, "id", "q")
    assert {r.id: r.n for r in steps.groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 3, 3: 2, 4: 3}
    assert {(r.id, r.step): r.level for r in P.levels(steps, "id").collect()}[(2, 3)] == 2
    cyclic = spark.createDataFrame([(1, 1, [2]), (1, 2, [1]), (1, 3, [])], "id int, step int, context_from array<int>")
    assert [(r.step, r.level) for r in P.levels(cyclic, "id").collect()] == [(3, 0)]


def test_execution_retries_once_then_skips():
    tried = []

    def run(step, given):
        tried.append(step["step"])
        if step["step"] == 2 or step["step"] == 1 and tried.count(1) == 1:
            raise RuntimeError
        return sorted(given)

    out = P.execute([{"step": 3, "context_from": [1, 2]}, {"step": 1, "context_from": []}, {"step": 2, "context_from": [1]}], run)
    assert tried == [1, 1, 2, 2, 3] and out == {1: [], 3: [1]}
    with pytest.raises(ValueError):
        P.execute([{"step": 1, "context_from": [1]}], run)


def test_context(spark):
    spans = spark.createDataFrame([("a", 1, 10), ("a", 5, 12), ("a", 12, 20), ("b", 1, 3)], "f string, start_line int, end_line int")
    got = {(r.f, r.start_line, r.end_line, r.spans) for r in C.merged_spans(spans, ["f"]).collect()}
    assert got == {("a", 1, 12, 2), ("a", 12, 20, 1), ("b", 1, 3, 1)}
    nested = spark.createDataFrame([("a", 1, 100), ("a", 2, 5), ("a", 50, 60), ("a", 95, 130), ("a", 96, 99), ("b", 1, 3)], "f string, start_line int, end_line int")
    assert {(r.f, r.start_line, r.end_line, r.spans) for r in C.merged_spans(nested, ["f"]).collect()} == {("a", 1, 100, 3), ("a", 95, 130, 2), ("b", 1, 3, 1)}
    ranked = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 5)], "q int, rank int, tokens int")
    assert [r["rank"] for r in C.within_budget(ranked, "q", "tokens", 100).collect()] == [1]
    chosen = spark.createDataFrame([(1, 2, "b.py", 1, 2, "python", "y"), (1, 1, "a.py", 3, 4, None, "x")], "q int, chunk_id int, file_path string, start_line int, end_line int, language string, content string")
    assert C.assembled(chosen, "q").first().context == "### a.py:3-4\n```\nx\n```\n\n### b.py:1-2\n```python\ny\n```"


def test_citations(spark):
    df = spark.createDataFrame([(1, "It is here. [a.py:2-3] And there [b/c.py:10-12]. Not cited."), (2, "none"), (3, None), (4, "```\nx.\n```")], "id int, t string")
    cited = C.citations(df, "id", "t")
    assert {(r.id, r.number, r.file_path, r.start_line, r.end_line) for r in cited.collect()} == {(1, 1, "a.py", 2, 3), (1, 2, "b/c.py", 10, 12)}
    content = "\n".join(f"line {i}" for i in range(1, 31))
    spans = spark.createDataFrame([(1, 100, "a.py", 1, 5, content), (1, 101, "a.py", 2, 4, content), (1, 102, "b/c.py", 11, 20, content), (2, 103, "b/c.py", 1, 30, content), (None, 104, None, 1, 2, None)], "repo_id int, chunk_id bigint, file_path string, start_line int, end_line int, content string")
    checked = {r.number: (r.valid, r.chunk_id, r.snippet) for r in C.validated(cited, spans, "id").collect()}
    assert checked == {1: (True, 101, "line 1\nline 2"), 2: (True, 103, "line 10\nline 11\nline 12")}
    for repository, second in ((1, False), (2, True), (None, True)):  # the narrowest span of the citation's own repository; without one, of any
        own = cited.withColumn("repo", F.lit(repository).cast("int"))
        got = {r.number: r.valid for r in C.validated(own, spans, "id", "repo").collect()}
        assert got == {1: repository != 2, 2: second}
    assert {r.id: r.c for r in df.select("id", C.coverage(F.col("t")).alias("c")).collect()} == {1: 0.666667, 2: 0.0, 3: None, 4: None}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "q int, d int, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 5), (3, 1)], "q int, d int")
    got = {r.q: (r.recall, r.precision, r.reciprocal_rank, r.ndcg) for r in E.retrieval_metrics(ranked, gold, "q", "d", 3).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert got[1] == (round(2 / 3, 6), round(2 / 3, 6), 0.5, round(dcg / ideal, 6)) and got[2] == got[3] == (0.0, 0.0, 0.0, 0.0)
    cases = spark.createDataFrame([(True, 0.9, 10), (False, 0.9, 10), (True, 0.1, 10), (True, 0.9, 99)], "r boolean, f double, t int")
    assert [r.c for r in cases.select(E.failure_class(F.col("r"), F.col("f"), F.col("t"), 50).alias("c")).collect()] == ["success", "retrieval", "generation", "overflow"]


def test_faithfulness(spark):
    df = spark.createDataFrame([(1, "The reader opens pages. [a.py:1-2] Dragons sleep in caves.", "class reader: opens the pages"), (2, "", "x"), (3, "It opens pages.", None), (4, None, None)], "id int, answer string, context string")
    got = {r.id: (r.claims, r.supported, r.faithfulness, r.hallucination) for r in E.faithfulness(df, "id", "answer", "context").collect()}
    assert got == {1: (2, 1, 0.5, 0.5), 2: (0, 0, None, None), 3: (1, 0, 0.0, 1.0), 4: (0, 0, None, None)}
    judged = E.faithfulness(df.where("id = 3"), "id", "answer", "context", judge=lambda claim, context: F.lit(1.0)).first()
    assert judged.faithfulness == 1.0


def test_long_chains_of_steps(spark):
    chain = spark.createDataFrame([(1, s, [s - 1] if s > 1 else []) for s in range(1, 24)], "id int, step int, context_from array<int>")
    assert {r.step: r.level for r in P.levels(chain, "id").collect()} == {s: s - 1 for s in range(1, 24)}


def test_folds(spark):
    df = spark.createDataFrame([(1, "a a a a a\n\nb b b b b\nc c c c c\nd d d\n" + "e " * 9 + "\nf"), (2, ""), (3, None)], "id int, t string")
    assert [(r.part, r.lines, r.tokens) for r in folding.packed_lines(df, "id", "t", 10).where("id = 1").orderBy("part").collect()] == [(1, 2, 10), (2, 2, 8), (3, 2, 10)]
    runs = spark.createDataFrame([("x", i, f) for i, f in enumerate([True, True, False, True])], "k string, ord int, flag boolean")
    assert [(r.run, r.flag, r.length) for r in folding.runs(runs, ["k"], ["ord"], "flag").orderBy("run").collect()] == [(1, True, 2), (2, False, 1), (3, True, 1)]


def test_metadata(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "ann"), (3, None)], "id int, username string")
    assert [tuple(r) for r in D.duplicates(users, "id", "username").collect()] == [("ann", 2)]
    repos = spark.createDataFrame([(10, 1), (11, 3)], "id int, owner_id int")
    jobs = spark.createDataFrame([(100, 10), (101, 11)], "id int, repository_id int")
    logs = spark.createDataFrame([(7, 2, 10), (8, 2, None), (9, 1, None)], "id int, user_id int, repository_id int")
    left = D.cascade(users, repos, jobs, logs, users.where("id = 1"))
    assert {n: sorted(r.id for r in d.collect()) for n, d in left.items()} == {"users": [2, 3], "repositories": [11], "ingestion_jobs": [101], "query_logs": [8]}
    states = spark.createDataFrame([(1, "ready"), (2, "READY"), (3, None)], "id int, status string")
    assert {r.id for r in D.invalid_states(states, "id", "status", D.REPOSITORY_STATES).collect()} == {2, 3}
    D.upgrade(spark, "codeloom_test")
    assert spark.table("codeloom_test.users").columns == ["id", "username", "email", "hashed_password", "created_at", "updated_at"]
    D.downgrade(spark, "codeloom_test")
    spark.sql("DROP DATABASE codeloom_test")
    assert D.stamped(users).where("updated_at is not null and created_at is not null").count() == 3


def test_job_states(spark):
    rows = [(1, 5, "PENDING", "2024-01-01", "2024-01-01"), (1, 5, "completed", "2024-01-01", "2024-01-03"), (2, 5, "failed", "2024-01-02", None), (3, 6, "pending", "2023-01-01", None)]
    jobs = spark.createDataFrame(rows, "id int, repository_id int, status string, c string, u string").selectExpr("id", "repository_id", "status", "to_timestamp(c) as created_at", "to_timestamp(u) as updated_at")
    assert {r.id: r.status for r in D.current_jobs(jobs).collect()} == {1: "completed", 2: "failed", 3: "pending"}
    assert {r.repository_id: (r.job_id, r.status) for r in D.latest_job(jobs).collect()} == {5: (2, "failed"), 6: (3, "pending")}
