from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.api import ask, found_chunks, ingest
from codeloom.config import Settings
from codeloom.functions.text import token_count
from codeloom.sources.source_tree import from_sources
from tests.sample import PROJECT


@pytest.fixture(scope="module")
def tables(spark):
    """Two repositories; the second has its own ``main`` and an ``authenticate`` that does something else."""
    other = {"main.py": "def authenticate(name):\n    return open_gate(name)\n\n\ndef open_gate(name):\n    return name\n\n\ndef main():\n    return authenticate(1)\n"}
    files = from_sources(spark, list(PROJECT.items())).unionByName(from_sources(spark, list(other.items()), repo_id=1).withColumn("file_id", F.col("file_id") + 100))
    return ingest(files)


QUESTIONS = [(1, "Where is find_user defined?", 0), (2, "Which code calls authenticate?", 0), (3, "Explain how the digests are compared", 0), (4, "Which code calls authenticate?", 1), (5, "", 0), (6, "Where is open_gate defined?", None)]


def test_answers_stay_within_the_repository(spark, tables):
    questions = spark.createDataFrame(QUESTIONS, "query_id bigint, query_text string, repo_id int")
    homes = {r.chunk_id: (r.repo_id, r.qualified_name) for r in tables["chunks"].collect()}
    found = found_chunks(questions, tables).collect()
    for r in found:
        repo = {q[0]: q[2] for q in QUESTIONS}[r.query_id]
        assert repo is None or homes[r.chunk_id][0] == repo
    names = lambda q: {homes[r.chunk_id][1] for r in found if r.query_id == q}
    assert "find_user" in names(1) and {"authenticate", "handle_login"} <= names(2) and {"authenticate", "main"} <= names(4)
    assert {s for r in found if r.query_id == 2 for s in r.steps} == {1, 2, 3}  # three steps, all with results
    out = {r.query_id: r for r in ask(questions, tables).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6}
    assert out[1].query_type == "simple-lookup" and out[2].strategy == "graph" and out[5].chunks == 0 and out[5].answer == "No context was found."
    assert "def find_user" in out[1].context and "def open_gate" in out[6].context and "def handle_login" in out[2].context and "main.py" not in out[2].context
    assert all(r.citations == r.valid_citations == 1 for k, r in out.items() if k != 5)
    assert max(r.context.count("def check") for r in out.values()) <= 1  # a class stands for its methods


def test_models_flags_and_citations_of_an_answer(spark, tables):
    questions = spark.createDataFrame(QUESTIONS[:1], "query_id bigint, query_text string, repo_id int")
    plain = Settings(enable_graph=False, enable_reranker=False, enable_planner=False)
    row = ask(questions, tables, plain, budget=400, generator=lambda question, prompt: F.concat(F.lit("It is in [db.py:19-20], not in [nowhere.py:1-2]. Asked: "), question), scorer=lambda q, t: token_count(t)).first()
    assert row.query_type == "simple-lookup" and (row.citations, row.valid_citations) == (2, 1) and row.answer.endswith("defined?")
    assert ask(questions.limit(0), tables, plain).count() == 0


def test_secrets_in_production():
    with pytest.raises(ValueError):
        Settings.from_env({"CODELOOM_ENVIRONMENT": "production"})
    with pytest.raises(ValueError):
        Settings(environment="production", secret_key="a" * 40)
    strong = Settings.from_env({"CODELOOM_ENVIRONMENT": "production", "CODELOOM_SECRET_KEY": "0123456789abcdefghij0123456789abcdefghij"})
    assert strong.environment == "production" and "abcdef" not in repr(strong)


def test_pairs_of_questions_and_chunks_are_not_shuffled(spark):
    """Every question shares its words with every chunk of all four repositories."""
    from tests.test_crowded import shuffled

    parts = [from_sources(spark, [(f"m{i}.py", f'def read_row_{i}(the_row):\n    """Where is the row defined {i}."""\n    return the_row\n') for i in range(50)], repo_id=r).withColumn("file_id", F.col("file_id") + 100 * r) for r in range(4)]
    held = ingest(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    questions = spark.createDataFrame([(i, f"Where is the row read_row_{i % 50} defined?", i % 4 if i % 10 else None) for i in range(300)], "query_id bigint, query_text string, repo_id int")
    before = shuffled(spark)[0]
    found = found_chunks(questions, held).collect()
    assert shuffled(spark)[0] - before < 16_500
    homes = {r.chunk_id: (r.repo_id, r.qualified_name) for r in held["chunks"].collect()}
    best = {q: {homes[r.chunk_id] for r in found if r.query_id == q and r.score == max(x.score for x in found if x.query_id == q)} for q in (11, 52, 20)}
    assert best[11] == {(3, "read_row_11")} and best[52] == {(0, "read_row_2")} and (0, "read_row_20") in best[20]
