"""Questions and chunks that share their words: what a search moves follows the tables, not the pairs of both."""

from __future__ import annotations

import random

import duckdb
import pytest

from codeloom.operators import retrieval as R
from codeloom.plans import catalog
from compare import canonical

CHUNKS, QUESTIONS = 600, 200


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    rng = random.Random(3)
    where = tmp_path_factory.mktemp("crowded")
    words = [f"w{i}" for i in range(40)]
    chunks = []
    for i in range(CHUNKS):
        text = " ".join(["the", "is", "in", *rng.choices(words, k=rng.randrange(3, 40))])
        chunks.append((i, i % 4, f"src/f{i % 50}.py", "python" if i % 3 else None, 1 + i % 7, 9 + i % 7, f"K{i % 9}.{rng.choice(words)}" if i % 5 else None, "definition", text if i != 11 else None))
    chunks += [chunks[7], chunks[100]]  # delivered twice
    logs = [(20 * i, f"Where is the {rng.choice(words)} in {rng.choice(words).upper()} {rng.choice(words)}", i % 5 if i % 6 else None, "") for i in range(QUESTIONS)]
    logs += [logs[3], (20 * QUESTIONS, "", 1, ""), (20 * QUESTIONS + 20, None, 1, "")]
    spark.createDataFrame(chunks, "chunk_id bigint, repo_id int, file_path string, language string, start_line int, end_line int, qualified_name string, chunk_kind string, content string").coalesce(2).write.parquet(f"{where}/chunks.parquet")
    spark.createDataFrame(logs, "id bigint, query_text string, repository_id int, response_text string").coalesce(1).write.parquet(f"{where}/query_logs.parquet")
    return str(where)


def shuffled(spark) -> tuple[int, int]:
    """Records and bytes that all stages so far have written for others."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)


def ran(spark, where: str, name: str) -> tuple[int, int]:
    """Runs a query, holds it against its SQL and returns what it shuffled."""
    before = shuffled(spark)
    df = catalog.queries()[name](spark, where)
    rows = [tuple(r) for r in df.collect()]
    after = shuffled(spark)
    db = duckdb.connect()
    for t in ("chunks", "query_logs"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    result = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows and canonical(rows, df.columns) == canonical(result.fetchall(), columns)
    return after[0] - before[0], after[1] - before[1]


@pytest.mark.parametrize("name", ["bm25_code", "bm25_boosted", "rrf_fuse", "synthesize_dedupe", "retrieval_results", "rerank_overlap", "context_truncate", "context_order", "context_assemble", "strategy_ways"])
def test_pairs_are_not_shuffled(spark, crowded, name):
    records, _ = ran(spark, crowded, name)
    assert records < CHUNKS * QUESTIONS / 4


def test_bm25_top_is_the_top_of_bm25(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))), rng.choice(["x", "Y", None]), i % 3) for i in range(120)] + [(200, None, "x", 0), (201, "", "x", 1), (None, "a", "x", 1)]
    documents = spark.createDataFrame(docs, "id bigint, text string, name string, repo int").repartition(3)
    asked = [(1, "a b zz Y", 1), (2, "H x", None), (3, None, None), (4, "c", 7), (5, "d a x", 2), (6, "??", 0), (1, "c b", 1)]
    queries = spark.createDataFrame(asked, "q bigint, words string, repo int")
    index = R.index_tables(documents, "id", "text")
    merged = spark.createDataFrame([(1, "a b zz Y c"), *((q, w) for q, w, _ in asked[1:-1])], "q bigint, words string")  # rows of one query are one query
    names = spark.createDataFrame([(q, i) for q, n in ((1, "Y"), (2, "x"), (5, "x")) for i, _, have, _ in docs if have == n and i is not None], "q bigint, id bigint")
    rows = lambda df: {(r.q, r["rank"]): (r.id, pytest.approx(r.score, abs=2e-6)) for r in df.collect()}
    plain, boosted = R.bm25(index, merged, "id", "q", "words"), R.bm25(index, merged, "id", "q", "words", names, 3.0)
    for few in (R.BM25_QUERIES, 2):
        monkeypatch.setattr(R, "BM25_QUERIES", few)
        assert rows(R.bm25_top(documents, queries, "id", "text", "q", "words", 5)) == rows(R.top(plain, "q", "id", 5))
        assert rows(R.bm25_top(documents, queries, "id", "text", "q", "words", 5, name=documents["name"], boost=3.0)) == rows(R.top(boosted, "q", "id", 5))
        own = plain.join(queries.select("q", "repo").distinct(), "q").join(documents.select("id", documents["repo"].alias("home")), "id").where("repo is null or repo = home").select("q", "id", "score")
        assert rows(R.bm25_top(documents, queries, "id", "text", "q", "words", 5, group="repo")) == rows(R.top(own, "q", "id", 5))
    assert R.bm25_top(documents.limit(0), queries, "id", "text", "q", "words").count() == 0 and R.bm25_top(documents, queries.limit(0), "id", "text", "q", "words").count() == 0


def test_relevant_chunks_of_several_repositories(spark, tmp_path):
    """A chunk that lies in two repositories of one question is one relevant chunk; a question without a repository has none."""
    chunks = [(i, r, f"f{i}.py", "python", 1, 2, f"k{i}", "definition", f"alpha w{i % 3}") for i in range(12) for r in ((1, 2) if i % 4 == 0 else (i % 3,))]
    logs = [(20, "alpha w1", 1, ""), (20, "alpha w1", 2, ""), (40, "w2", 2, ""), (60, "alpha", None, ""), (80, "none of it", 0, "")]
    spark.createDataFrame(chunks, "chunk_id bigint, repo_id int, file_path string, language string, start_line int, end_line int, qualified_name string, chunk_kind string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame(logs, "id bigint, query_text string, repository_id int, response_text string").write.parquet(f"{tmp_path}/query_logs.parquet")
    ran(spark, str(tmp_path), "strategy_ways")
