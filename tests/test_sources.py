from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.api import ask, ingest
from codeloom.config import Settings
from codeloom.operators import manifest as M
from codeloom.sources import tables
from codeloom.sources.source_tree import Clone, SourceError, discover, from_sources
from tests.sample import PROJECT


@pytest.fixture()
def tree(tmp_path):
    for path in ("b.py", "a.PY", "__init__.py", "_p.py", "pkg/m.ts", "pkg/.h.py", "notes.txt", "node_modules/x.py", ".git/y.py", "pkg/venv/z.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    return tmp_path


def test_discovery(spark, tree):
    assert [r.path for r in discover(spark, str(tree)).collect()] == ["__init__.py", "_p.py", "a.PY", "b.py", "pkg/.h.py", "pkg/m.ts"]
    content = discover(spark, str(tree), content=True).where("path = 'b.py'").first()
    assert content.content == b"x = 1\n" and content.size_bytes == 6 and content.language == "python"
    assert [r.path for r in discover(spark, str(tree), extensions={".txt": "text"}).collect()] == ["notes.txt"]
    discover(spark, str(tree), max_bytes=36)
    with pytest.raises(SourceError, match="35"):
        discover(spark, str(tree), max_bytes=35)


def test_clone(tree, tmp_path):
    git = ["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tree)]
    for args in (["init", "-q", "-b", "trunk"], ["add", "b.py"], ["commit", "-qm", "one"], ["commit", "-qm", "two", "--allow-empty"]):
        subprocess.run([*git, *args], check=True)
    clone = Clone(str(tree), branch="trunk")
    with clone as path:
        assert subprocess.run(["git", "-C", path, "rev-list", "--count", "HEAD"], capture_output=True, text=True).stdout.strip() == "1"
    assert clone.path is None
    with pytest.raises(SourceError):
        Clone(str(tmp_path / "none")).fetch()


def test_manifest_rules(spark):
    rows = [(1, 1, "a/b.py", "xé"), (1, 1, "a/b.py", "xé"), (2, 1, ".x/b.py", ""), (3, 1, "vendor/c.py", ""), (4, 1, "d.TSX", None), (5, 1, "e.txt", ""), (6, 1, None, "")]
    df = spark.createDataFrame(rows, "file_id int, repo_id int, path string, content string").withColumn("size_bytes", F.lit(9).cast("bigint"))
    out = M.manifest(df)
    assert {(r.path, r.language, r.size_bytes) for r in out.collect()} == {("a/b.py", "python", 3), ("d.TSX", "typescript", 9)}
    assert M.size_check(out, 12).first().too_large is False and M.size_check(out, 11).first().too_large is True
    text = spark.createDataFrame([(1, "ok\tfine\nna\u00efve"), (2, "plain"), (3, None)], "id int, t string")
    assert [tuple(r) for r in M.ascii_violations(text, "id", "t").collect()] == [(1, 2)]


def test_tables(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"query": "a", "expected_type": "lookup", "expected_callees": ["x"]}, {"query": "b", "expected_type": "t"}]))
    assert [(r.query, r.expected_callees) for r in tables.sample_queries(spark, str(path)).collect()] == [("a", ["x"]), ("b", None)]
    store = str(tmp_path / "store")
    tables.upsert_table(spark, store, spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "id")
    out = tables.upsert_table(spark, store, spark.createDataFrame([(2, "c")], "id int, v string"), "id")
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "c")}
    assert json.loads(tables.payloads(out.where("id = 1")).first().payload) == {"id": 1, "v": "a"}


def test_settings():
    assert Settings.from_env({"CODELOOM_RRF_K": "10", "CODELOOM_ENABLE_GRAPH": "no", "CODELOOM_LANGUAGES": "Python"}) == Settings(rrf_k=10, enable_graph=False, languages=("python",))
    for bad in ({"CODELOOM_RRF_K": "0"}, {"CODELOOM_LANGUAGES": "cobol"}, {"CODELOOM_ENABLE_GRAPH": "maybe"}, {"CODELOOM_LANGUAGES": ""}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)


def test_ask(spark):
    files = from_sources(spark, list(PROJECT.items()))
    questions = spark.createDataFrame([(1, "Where is authenticate defined?"), (2, "What calls find_user?"), (3, "")], "query_id bigint, query_text string")
    for settings in (Settings(), Settings(enable_graph=False, enable_reranker=False, enable_planner=False)):
        got = {r.query_id: r for r in ask(questions, ingest(files, settings), settings).collect()}
        assert got[1].answer.startswith("See [") and "### auth.py" in got[1].context and got[1].query_type == "simple-lookup" and "def authenticate" in got[1].prompt
        assert "find_user" in got[2].context and got[3].answer == "No context was found."
