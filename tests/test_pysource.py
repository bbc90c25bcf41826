from __future__ import annotations

from codeloom.functions.tokens import TOKEN_RE
from codeloom.operators import pysource as P
from codeloom.sources.source_tree import from_sources
from tests.sample import PROJECT


def rows(text: str, tag: str, budget: int = 512) -> list[dict]:
    return [r for r in P.parse_source(text, (tag,), budget)]


def test_symbols():
    found = {r["qualified_name"] or r["name"]: r for r in map(lambda r: {"qualified_name": None, **r}, rows(PROJECT["db.py"], "symbol"))}
    assert list(found) == ["Base", "Store", "Store.size", "Store.check", "Store.save", "find_user"]
    assert found["Store"]["bases"] == ["Base"] and found["Store"]["docstring"] == "Keeps rows." and found["Store"]["signature"] is None
    assert found["Store.size"]["decorators"] == ["property"] and found["Store.size"]["type"] == "method" and found["Store.size"]["start_line"] == 9
    assert found["Store.save"]["is_async"] and found["Store.save"]["signature"] == "async def save(self, row)"
    nested = {r["qualified_name"]: r["type"] for r in rows(PROJECT["pkg/inner.py"], "symbol") if r["type"] != "import"}
    assert nested == {"outer": "function", "outer.<locals>.inner": "function", "outer.<locals>.inner.<locals>.Local": "class"}


def test_imports():
    text = "import os, a.b as ab\nfrom .. import x\nfrom ..p import (y,\n    z as w)\nfrom m import *\nfrom __future__ import annotations\n"
    got = [(r["name"], r["import_source"], r.get("import_alias"), r["is_wildcard_import"], r["start_line"]) for r in rows(text, "symbol")]
    assert got == [("os", "os", None, False, 1), ("ab", "a.b", "ab", False, 1), ("x", "..", None, False, 2), ("y", "..p", None, False, 3), ("w", "..p.z", "w", False, 4), ("*", "m", None, True, 5)]


def test_docstrings_and_signatures():
    text = 'def f(a: dict[str, "x:y"] = {1: 2},\n      *b) -> "int":  # why: so\n    # note\n    r"""Raw \\d\n      text."""\n\n\ndef g(): "one" \'two\'\n'
    f, g = rows(text, "symbol")
    assert f["signature"] == 'def f(a: dict[str, "x:y"] = {1: 2},\n      *b) -> "int"' and f["docstring"] == "Raw \\d\n      text." and g["docstring"] == "onetwo"


def test_broken_sources():
    text = "def good(a):\n    return a\n\n\ndef broken(a):\n    x = (1\n    return x\n\n\nclass C:\n    def m(self):\n        y = ]\n\n\ndef unfinished(\n"
    got = {r["qualified_name"]: r["has_parse_error"] for r in rows(text, "symbol")}
    assert got == {"good": False, "broken": True, "C": True, "C.m": True}
    assert rows(text, "error") and not rows("", "error") and not rows("", "symbol") and not rows("", "chunk")


def test_chunks():
    text = "import a\n\n# why\nX = 1  # trailing\n\n\n@deco\ndef f():\n    return 1\n\n\nY = 2\n"
    got = [(r["chunk_kind"], r["start_line"], r["end_line"], r["content"]) for r in rows(text, "chunk")]
    assert got == [("module", 1, 4, "import a\n# why\nX = 1\n# trailing"), ("definition", 7, 9, "@deco\ndef f():\n    return 1"), ("module", 12, 12, "Y = 2")]
    kinds = [(r.get("qualified_name"), r["chunk_kind"], r.get("parent_symbol")) for r in rows(PROJECT["db.py"], "chunk")]
    assert ("Store", "definition", None) in kinds and ("Store.save", "definition", "Store") in kinds
    assert all(r["token_count"] == len(TOKEN_RE.findall(r["content"])) for r in rows(PROJECT["db.py"], "chunk"))


def test_splitting_of_long_definitions():
    text = "def f(a):\n    \"\"\"Doc.\"\"\"\n" + "".join(f"    value_{i} = {i}  # note {i}\n" for i in range(40)) + "    return a\n"
    last = 0
    for budget in (1024, 128, 32):
        parts = rows(text, "chunk", budget)
        assert len(parts) >= last and [p["part"] for p in parts] == list(range(1, len(parts) + 1)) and {p["total_parts"] for p in parts} == {len(parts)}
        last = len(parts)
    parts = rows(text, "chunk", 128)
    assert parts[0]["chunk_kind"] == "definition" and parts[1]["chunk_kind"] == "continuation" and parts[1]["content"].startswith("def f(a):" + P.CONTINUED + "\n")
    assert all(p["overlap_header"] == "def f(a):" and p["start_line"] > 1 for p in parts)


def test_files(spark):
    df = from_sources(spark, [*PROJECT.items(), ("x.js", "let a;")])
    df = df.union(df.where("path = 'db.py'"))
    parsed = P.parse_files(df)
    assert P.symbols(parsed).where("file_path = 'db.py'").count() == 6 and P.chunks(parsed).count() > 5
    assert [r.reason for r in P.rejects(df).collect()] == ["unsupported language: js"]
    assert P.parse_files(df.limit(0)).count() == 0


def test_language_names_nulls(spark):
    rows_ = [(1, 1, "a.txt", "Python", "x = 1"), (2, 1, "b.py", None, "def f(): pass"), (3, None, None, None, None), (None, 1, "c.py", None, "x = 2"), (4, 1, "d.py", "python", None)]
    df = spark.createDataFrame(rows_, "file_id bigint, repo_id int, path string, language string, content string")
    assert {r.file_id for r in P.parse_files(df).collect()} == {1, 2}
