from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from codeloom.operators import graph as G


def random_edges(seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(15), rng.randrange(15)) for _ in range(28)]


def reach(edges, start, depth):
    out, frontier = {start: 0}, {start}
    for d in range(1, depth + 1):
        frontier = {b for a, b in edges if a in frontier} - set(out)
        out.update(dict.fromkeys(frontier, d))
    return out


def test_traversal_against_brute_force(spark):
    for seed in (1, 2):
        edges = random_edges(seed)
        df = spark.createDataFrame([*edges, (None, 1), edges[0]], "src int, dst int")
        seeds = spark.createDataFrame([(0,), (7,), (7,), (99,)], "seed int")
        got = {(r.seed, r.node): r.depth for r in G.neighbours(df, seeds, 3).collect()}
        assert got == {(s, n): d for s in (0, 7, 99) for n, d in reach(edges, s, 3).items()}
        back = {(r.seed, r.node): r.depth for r in G.neighbours(df, seeds, 2, reverse=True).collect()}
        assert back == {(s, n): d for s in (0, 7, 99) for n, d in reach([(b, a) for a, b in edges], s, 2).items()}
        paths = {tuple(r.path) for r in G.simple_paths(df, seeds, 3).collect()}
        expected = {p for s in (0, 7) for n in (1, 2, 3) for rest in itertools.permutations([x for x in range(15) if x != s], n) for p in [(s, *rest)] if all(e in set(edges) for e in zip(p, p[1:]))}
        assert paths == expected
        shortest = {(r.seed, r.node): tuple(r.path) for r in G.shortest_paths(df, seeds, 3).collect()}
        for (s, n), d in got.items():
            if s != n:
                assert shortest[(s, n)] == min((p for p in expected if p[0] == s and p[-1] == n), key=lambda p: (len(p), p)) and len(shortest[(s, n)]) == d + 1
        cyclic = {r.node for r in G.cyclic_nodes(df).collect()}
        assert cyclic == {n for n in range(15) if any(n in reach(edges, b, 20) for a, b in edges if a == n)}


def test_induced_and_empty(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    assert {tuple(r) for r in G.induced(df, spark.createDataFrame([(1,), (2,)], "node int")).select("src", "dst").collect()} == {(1, 2)}
    none = df.limit(0)
    assert G.cyclic_nodes(none).count() == 0 and G.neighbours(none, none.select(F.col("src").alias("seed")), 2).count() == 0


def test_sample_project(spark):
    from codeloom.operators import pysource as P
    from codeloom.sources.source_tree import from_sources
    from tests.sample import PROJECT

    parsed = P.parse_files(from_sources(spark, list(PROJECT.items())))
    symbols, calls = P.symbols(parsed), P.calls(parsed)
    edges = {(r.caller, r.callee) for r in G.call_edges(calls, symbols).where("callee is not null").collect()}
    assert edges >= {("handle_login", "authenticate"), ("handle_login", "make_token"), ("authenticate", "find_user"), ("authenticate", "digest"), ("Store.save", "Store.check")}
    assert not any(c in ("request.get", "hashlib.sha256") for _, c in edges)
    imports = {(r.source_module, r.target_module): list(r.imported_names) for r in G.import_edges(symbols).collect()}
    assert imports[("app", "auth")] == ["authenticate", "make_token"] and ("pkg.inner", "pkg.base") in imports and ("pkg.inner", "db") in imports
    assert G.cyclic_nodes(G.import_edges(symbols).select(F.col("source_module").alias("src"), F.col("target_module").alias("dst"))).count() == 0
    importers = G.neighbours(G.import_edges(symbols).select(F.col("source_module").alias("src"), F.col("target_module").alias("dst")), spark.createDataFrame([("db",)], "seed string"), 5, reverse=True)
    assert {r.node for r in importers.collect()} == {"db", "auth", "app", "pkg.inner"}
    kinds = {(r.kind, r.src, r.dst) for r in G.graph_edges(symbols, calls).collect()}
    ids = {(r.src_file, r.src, r.dst_file, r.dst) for r in G.graph_edges(symbols, calls).where("kind = 'CALLS'").collect()}
    assert ("app.py", "handle_login", "auth.py", "authenticate") in ids
    assert ("CONTAINS", "Store", "Store.save") in kinds and ("INHERITS", "Store", "Base") in kinds
    import tempfile

    path = tempfile.mkdtemp()
    G.save_graph(G.graph_nodes(symbols), G.graph_edges(symbols, calls), path)
    nodes, saved = G.load_graph(spark, path)
    assert saved.where("kind = 'CALLS'").count() == len({e for e in kinds if e[0] == "CALLS"}) and nodes.where("label = 'Class'").count() == 3


CODE = {
    "m.py": "class Base:\n    def shared(self):\n        return 1\n\n\nclass K(Base):\n    def __init__(self):\n        self.store = Store()\n\n    def go(self):\n        self.shared()\n        self.store.put()\n        return self.go()\n\n\nclass Store:\n    def put(self):\n        return f()\n\n\ndef f():\n    def inner():\n        return f()\n    return inner()\n\n\ndef main():\n    return f()\n",
    "n.py": "import m\nimport pkg.deep as pd\nimport pkg.deep\nfrom m import K, f as g\nfrom pkg import *\nfrom pkg import again\n\n\ndef run(x: K):\n    g()\n    m.f()\n    K()\n    K.go(k)\n    k = K()\n    k.go()\n    x.go()\n    K().go()\n    with K() as w:\n        w.go()\n    pd.far()\n    pkg.deep.far()\n    starred()\n    again()\n    unknown.thing()\n    (lambda: 1)()\n\n\ndef main():\n    return run(1)\n",
    "pkg/__init__.py": "from .deep import far as again\n\n\ndef starred():\n    return 1\n",
    "pkg/deep.py": "from .. import m\n\n\ndef far():\n    return main()\n",
}


def test_calls_through_imports_and_receivers(spark):
    from codeloom.operators import pysource as P
    from codeloom.sources.source_tree import from_sources

    parsed = P.parse_files(from_sources(spark, list(CODE.items())))
    symbols, calls = P.symbols(parsed), P.calls(parsed)
    edges = G.call_edges(calls, symbols).collect()
    got = {(r.call_site_file, r.caller, r.callee_expr): (r.callee_file, r.callee) for r in edges}
    assert len(edges) == calls.count()
    far = ("pkg/deep.py", "far")
    assert {k[2]: v for k, v in got.items() if k[0] == "n.py" and k[1] == "run"} == {
        "g": ("m.py", "f"), "m.f": ("m.py", "f"), "K": ("m.py", "K"), "K.go": ("m.py", "K.go"), "k.go": ("m.py", "K.go"), "x.go": ("m.py", "K.go"), "K().go": ("m.py", "K.go"), "w.go": ("m.py", "K.go"),
        "pd.far": far, "pkg.deep.far": far, "again": far, "starred": ("pkg/__init__.py", "starred"), "unknown.thing": (None, None), "lambda: 1": (None, None),
    }
    assert got[("m.py", "K.go", "self.shared")] == ("m.py", "Base.shared") and got[("m.py", "K.go", "self.store.put")] == ("m.py", "Store.put") and got[("m.py", "K.go", "self.go")] == ("m.py", "K.go")
    assert got[("m.py", "f", "inner")] == ("m.py", "f.<locals>.inner") and got[("m.py", "f.<locals>.inner", "f")] == ("m.py", "f")
    assert got[("n.py", "main", "run")] == ("n.py", "run") and got[("m.py", "main", "f")] == ("m.py", "f") and got[("pkg/deep.py", "far", "main")] == (None, None)
    graph = G.graph_edges(symbols, calls)
    ids = {(r.src, r.dst) for r in G.by_id(graph.where("kind = 'CALLS'")).collect()}
    assert ("0:n.py:main", "0:n.py:run") in ids and ("0:m.py:main", "0:m.py:f") in ids  # two nodes
    assert ("m.py:K", "m.py:Base") in {(f"{r.src_file}:{r.src}", f"{r.dst_file}:{r.dst}") for r in graph.where("kind = 'INHERITS'").collect()}
    chains = {(r.a, r.b, r.c) for r in G.call_pairs(graph).collect()}
    assert ("n.py:main", "n.py:run", "m.py:K.go") in chains and ("m.py:main", "m.py:f", "m.py:f.<locals>.inner") in chains
    seeds = spark.createDataFrame([("0:m.py:f",)], "seed string")
    hit = {r.node: r.depth for r in G.impact(G.by_id(graph.where("kind = 'CALLS'")), seeds).collect()}
    assert hit["0:n.py:main"] == 2 and hit["0:m.py:Store.put"] == 1 and hit["0:m.py:K.go"] == 2


def test_names_of_a_table_without_import_modules(spark):
    """The table doesn't say what an alias was imported from: its source is the whole path."""
    rows = [(1, "a.py", "g", "import", "m.f", "g", False, None), (1, "a.py", "m", "import", "m", None, False, None), (1, "a.py", "K", "import", "m", None, False, None), (1, "m.py", "f", "function", None, None, False, "f"), (1, "m.py", "K", "class", None, None, False, "K"), (2, "m.py", "K", "class", None, None, False, "K")]
    symbols = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], []) for r in rows], "repo_id int, file_path string, name string, type string, import_source string, import_alias string, is_wildcard_import boolean, qualified_name string, bases array<string>")
    got = {r["name"]: (r.callee_file, r.callee) for r in G.import_targets(symbols).collect()}
    assert got == {"g": ("m.py", "f"), "K": ("m.py", "K"), "m": (None, None)}
    assert G.import_targets(symbols.limit(0)).count() == 0


def test_long_cycles(spark):
    ring = [(i, (i + 1) % 53) for i in range(53)] + [(53, 0), (1, 54)]
    assert {r.node for r in G.cyclic_nodes(spark.createDataFrame(ring, "src int, dst int")).collect()} == set(range(53))


def test_cycles_of_a_dense_graph_are_not_closed(spark, monkeypatch):
    """Three edges a node: a closure would have a row for almost every pair of the 2,000 nodes."""
    import random

    from codeloom.operators import graph
    from tests.test_crowded import shuffled

    rng = random.Random(7)
    edges = [(f"n{rng.randrange(2000)}", f"n{rng.randrange(2000)}") for _ in range(4000)] + [("x", "y"), (None, "x"), ("x", None), ("z", "z")]
    df = spark.createDataFrame(edges, "src string, dst string")
    before = shuffled(spark)[0]
    got = {r.node for r in G.cyclic_nodes(df).collect()}
    assert shuffled(spark)[0] - before < 20_000
    after: dict = {}
    for a, b in edges:
        if a and b:
            after.setdefault(a, set()).add(b)

    def back(node):
        seen, todo = set(), [node]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return node in seen

    assert got == {n for n in after if back(n)} and "z" in got and len(got) > 500
    few = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(7, 0), (0, 8), (9, 9)], "src int, dst bigint")
    assert {r.node for r in G.cyclic_nodes(few).collect()} == {0, 1, 2, 3, 4, 9}
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)  # the way of larger graphs
    assert {r.node for r in G.cyclic_nodes(few).collect()} == {0, 1, 2, 3, 4, 9}
