"""Code graphs: call, import, containment and inheritance edges, and traversal of any edge relation.

Traversal keeps a frontier and a visited relation; every round is one join with the edges on the frontier's node and one
anti-join with what was reached before, written to the shared folder, so lineage stays short and depth is bounded.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import written

#: Edges up to which one task finds the cycles of a whole graph; larger ones are trimmed first and, where that isn't enough, closed by joins.
LOCAL_EDGES = 1_000_000

# --- code edges ------------------------------------------------------------------------------------------------


def module_of(path: str) -> F.Column:
    """The dotted module of a Python path; a package's __init__ is the package."""
    bare = F.regexp_replace(F.col(path), r"\.py$", "")
    return F.regexp_replace(F.regexp_replace(bare, "/", "."), r"(?:^|\.)__init__$", "")


def symbol_table(symbols: DataFrame) -> DataFrame:
    """Symbols that aren't imports, with their module, delivered rows once."""
    return symbols.where("type <> 'import'").withColumn("module", module_of("file_path"))


def absolute_module(source: F.Column, module: F.Column, is_package: F.Column) -> F.Column:
    """The absolute name of an import source: leading dots climb from the importing module."""
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    rest = F.regexp_replace(source, r"^\.+", "")
    parts = F.filter(F.split(module, r"\."), lambda x: x != "")
    up = dots - F.when(is_package, 1).otherwise(0)
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))
    return F.when(dots == 0, rest).otherwise(F.concat_ws(".", F.concat(base, F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>")))))


def import_edges(symbols: DataFrame) -> DataFrame:
    """(repo_id, source_module, target_module, import_type, imported_names) from import symbols; names distinct and sorted."""
    imports = symbols.where("type = 'import'").select("repo_id", "file_path", "name", "import_source", "import_alias", "is_wildcard_import", "start_line").distinct()
    module = module_of("file_path")
    package = F.col("file_path").rlike(r"(?:^|/)__init__\.py$")
    plain = F.when(F.col("import_alias").isNotNull() & F.col("import_source").rlike(r"[^.]\.[^.]+$"), F.regexp_replace("import_source", r"\.[^.]+$", "")).otherwise(F.col("import_source"))
    kind = F.when(F.col("is_wildcard_import"), "wildcard").when(F.col("import_source").startswith("."), "relative").otherwise("absolute")
    edges = imports.select("repo_id", module.alias("source_module"), absolute_module(plain, module, package).alias("target_module"), kind.alias("import_type"), "name")
    return edges.groupBy("repo_id", "source_module", "target_module", "import_type").agg(F.array_sort(F.collect_set("name")).alias("imported_names"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, src, dst): a definition and the one that holds it."""
    return symbols.where("type <> 'import' and parent_symbol is not null").select("repo_id", "file_path", F.col("parent_symbol").alias("src"), F.col("qualified_name").alias("dst")).distinct()


def inherits_edges(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, src, dst): a class and each of its bases, as written."""
    return symbols.where("type = 'class'").select("repo_id", "file_path", F.col("qualified_name").alias("src"), F.explode("bases").alias("dst")).distinct()


# --- names to definitions ----------------------------------------------------------------------------------------


def bindings(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, local, path): what each imported name of a file stands for, as an absolute dotted path.

    ``from m import f`` binds f to m.f, ``from m import f as g`` binds g to m.f, ``import a.b`` binds a to a, ``import a.b as x`` binds x to a.b.
    Where the table doesn't say which (``import m``, ``from m import m``) both are given.
    """
    imports = symbols.where("type = 'import' and not is_wildcard_import")
    package = F.col("file_path").rlike(r"(?:^|/)__init__\.py$")
    module = module_of("file_path")
    source = F.col("import_source")
    aliased = F.col("import_alias").isNotNull()
    if "import_module" in symbols.columns:  # parsed symbols say what was imported from where
        origin = F.regexp_extract(source, r"([^.]+)$", 1)
        plain = F.col("import_module") == source
        whole = F.when(aliased & ~plain, F.concat_ws(".", F.nullif(absolute_module(F.col("import_module"), module, package), F.lit("")), origin))
    else:
        whole = F.lit(None).cast("string")
    full = F.coalesce(whole, F.when(aliased, absolute_module(source, module, package)), F.concat_ws(".", F.nullif(absolute_module(source, module, package), F.lit("")), "name"))
    is_plain = ~aliased & (F.col("name") == source)
    named = imports.select("repo_id", "file_path", F.col("name").alias("local"), full.alias("path"))
    modules = imports.where(is_plain).select("repo_id", "file_path", F.regexp_extract("name", r"^([^.]+)", 1).alias("local"), F.regexp_extract("name", r"^([^.]+)", 1).alias("path"))
    return named.where(~F.col("local").contains(".")).unionByName(modules).distinct()


def definition_paths(symbols: DataFrame) -> DataFrame:
    """(repo_id, path, far, far_file): definitions by their absolute dotted path; names inside functions have none."""
    path = F.concat_ws(".", F.nullif(module_of("file_path"), F.lit("")), "qualified_name")
    defs = symbols.where("type <> 'import' and qualified_name is not null").where(~F.col("qualified_name").contains("<locals>"))
    return defs.groupBy("repo_id", path.alias("path")).agg(F.min(F.struct("file_path", "qualified_name")).alias("d")).select("repo_id", "path", F.col("d.qualified_name").alias("far"), F.col("d.file_path").alias("far_file"))


def resolved_names(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """``asked`` (repo_id, file_path, scope, name) with callee and callee_file: the definition that each dotted name stands for, or nulls.

    The scopes of Python in turn: for ``self.m`` and ``cls.m`` the class that holds the scope, then its bases; functions inside the
    scope and around it; definitions of the file; imported names, through one re-export; wildcard imports.  Every join is on equal keys.
    """
    key = ["repo_id", "file_path", "scope", "name"]
    each = written(asked.select(key).where("name is not null").distinct(), "names")
    defs = symbols.where("type <> 'import' and qualified_name is not null").select("repo_id", "file_path", F.col("qualified_name").alias("callee")).distinct()
    bound = written(bindings(symbols), "bindings")
    scope, name = F.col("scope"), F.col("name")
    member = name.rlike(r"^(?:self|cls)\.\w+$")
    owner = F.when(scope.contains("."), F.regexp_replace(scope, r"\.[^.]+$", ""))
    attribute = F.regexp_replace(name, r"^(?:self|cls)\.", "")
    outer = F.when(scope.contains(".<locals>."), F.regexp_replace(scope, r"\.<locals>\.[^.]+$", ""))
    wanted = F.array_compact(F.array(
        F.when(member, F.struct(F.lit(0).alias("order"), F.concat_ws(".", owner, attribute).alias("callee"))),
        F.when(~member & scope.isNotNull(), F.struct(F.lit(1).alias("order"), F.concat(scope, F.lit(".<locals>."), name).alias("callee"))),
        F.when(~member & outer.isNotNull(), F.struct(F.lit(2).alias("order"), F.concat(outer, F.lit(".<locals>."), name).alias("callee"))),
        F.when(~member, F.struct(F.lit(4).alias("order"), name.alias("callee"))),
    ))
    near = each.select(*key, F.explode(wanted).alias("w")).select(*key, "w.order", "w.callee")
    first = F.regexp_extract(name, r"^([^.]+)", 1)
    rest = F.regexp_extract(name, r"^[^.]+(\..*)?$", 1)
    # a method that the class doesn't define is its base's
    bases = inherits_edges(symbols).where(F.col("dst").rlike(r"^[A-Za-z_][\w.]*$")).select("repo_id", "file_path", F.col("src").alias("owner"), F.col("dst").alias("base"))
    heirs = each.where(member).withColumn("owner", owner).withColumn("attribute", attribute).join(bases, ["repo_id", "file_path", "owner"])
    near = near.unionByName(heirs.select(*key, F.lit(3).alias("order"), F.concat_ws(".", "base", "attribute").alias("callee")))
    near = near.join(defs, ["repo_id", "file_path", "callee"]).select(*key, "order", "callee", F.col("file_path").alias("callee_file"))
    # names that an import of the file binds
    outside = each.where(~member).select(*key, F.lit(5).alias("order"), first.alias("local"), rest.alias("tail"))
    outside = outside.unionByName(heirs.select(*key, F.lit(3).alias("order"), F.regexp_extract("base", r"^([^.]+)", 1).alias("local"), F.concat(F.regexp_extract("base", r"^[^.]+(\..*)?$", 1), F.lit("."), F.col("attribute")).alias("tail")))
    imported = written(outside.join(bound, ["repo_id", "file_path", "local"]).select(*key, "order", F.concat("path", "tail").alias("path")), "imported")
    # a path that is no definition may be a name that its module imports in turn
    modules = symbols.select("repo_id", F.col("file_path").alias("home"), module_of("file_path").alias("module")).distinct()
    again = imported.where("order = 5").withColumn("module", F.regexp_replace("path", r"\.[^.]+$", "")).withColumn("local", F.regexp_extract("path", r"([^.]+)$", 1)).join(modules, ["repo_id", "module"])
    exported = again.drop("path").join(bound.withColumnRenamed("file_path", "home"), ["repo_id", "home", "local"]).select(*key, F.lit(6).alias("order"), "path")
    package = F.col("file_path").rlike(r"(?:^|/)__init__\.py$")
    stars = symbols.where("type = 'import' and is_wildcard_import").select("repo_id", "file_path", absolute_module(F.col("import_source"), module_of("file_path"), package).alias("star")).distinct()
    starred = each.where(~member).join(stars, ["repo_id", "file_path"]).select(*key, F.lit(7).alias("order"), F.concat_ws(".", F.nullif("star", F.lit("")), "name").alias("path"))
    far = imported.unionByName(exported).unionByName(starred).join(definition_paths(symbols), ["repo_id", "path"]).select(*key, "order", F.col("far").alias("callee"), F.col("far_file").alias("callee_file"))
    options = near.unionByName(far)
    best = options.groupBy(*key).agg(F.min(F.struct("order", "callee_file", "callee")).alias("b")).select(*key, F.col("b.callee").alias("callee"), F.col("b.callee_file").alias("callee_file"))
    same = [asked[c].eqNullSafe(best[c]) for c in ("repo_id", "file_path", "scope")] + [asked["name"] == best["name"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return asked.join(best, on, "left").select(*[asked[c] for c in asked.columns], "callee", "callee_file")


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with the symbol they reach, or a null callee; a class stands for its constructor.

    ``calls`` has repo_id, call_site_file, caller, callee_expr, target and call_site_line.
    """
    asked = calls.withColumnsRenamed({"call_site_file": "file_path", "caller": "scope", "target": "name"})
    out = resolved_names(asked, symbols)
    return out.select("repo_id", F.col("scope").alias("caller"), "callee", "callee_file", "callee_expr", "call_site_line", F.col("file_path").alias("call_site_file"))


def import_targets(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, name, callee, callee_file): each name that a file imports, with the definition it stands for, or nulls."""
    names = symbols.where("type = 'import' and not is_wildcard_import").select("repo_id", "file_path", F.lit(None).cast("string").alias("scope"), "name").distinct()
    return resolved_names(names, symbols).select("repo_id", "file_path", "name", "callee", "callee_file")


def graph_edges(symbols: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """All edges as (repo_id, kind, src_file, src, dst_file, dst) of kinds CONTAINS, INHERITS, IMPORTS and CALLS.

    A definition is named by its file and qualified name, so that two ``main`` of one repository are two nodes.  A base or module that isn't in the
    repository has a null dst_file.
    """
    inherits = resolved_names(inherits_edges(symbols).select("repo_id", "file_path", F.lit(None).cast("string").alias("scope"), F.col("dst").alias("name"), "src"), symbols)
    homes = symbols.select("repo_id", module_of("file_path").alias("module"), "file_path").groupBy("repo_id", "module").agg(F.min("file_path").alias("home"))
    imports = import_edges(symbols).join(homes.select("repo_id", F.col("module").alias("source_module"), F.col("home").alias("src_file")), ["repo_id", "source_module"], "left").join(homes.select("repo_id", F.col("module").alias("target_module"), F.col("home").alias("dst_file")), ["repo_id", "target_module"], "left")
    parts = [
        contains_edges(symbols).select("repo_id", F.lit("CONTAINS").alias("kind"), F.col("file_path").alias("src_file"), "src", F.col("file_path").alias("dst_file"), "dst"),
        inherits.select("repo_id", F.lit("INHERITS").alias("kind"), F.col("file_path").alias("src_file"), "src", F.col("callee_file").alias("dst_file"), F.coalesce("callee", "name").alias("dst")),
        imports.select("repo_id", F.lit("IMPORTS").alias("kind"), "src_file", F.col("source_module").alias("src"), "dst_file", F.col("target_module").alias("dst")),
    ]
    if calls is not None:
        parts.append(call_edges(calls, symbols).where("caller is not null and callee is not null").select("repo_id", F.lit("CALLS").alias("kind"), F.col("call_site_file").alias("src_file"), F.col("caller").alias("src"), F.col("callee_file").alias("dst_file"), F.col("callee").alias("dst")))
    return _union(parts).distinct()


def node_id(side: str) -> F.Column:
    """One name of a node of ``graph_edges``: repository, file and name."""
    return F.concat_ws(":", F.col("repo_id").cast("string"), F.coalesce(F.col(f"{side}_file"), F.lit("")), F.col(side))


def by_id(edges: DataFrame) -> DataFrame:
    """(src, dst) of edges whose ends are named by repository, file and name: what the traversals walk."""
    return edges.select(node_id("src").alias("src"), node_id("dst").alias("dst"))


def call_pairs(edges: DataFrame) -> DataFrame:
    """(repo_id, a, b, c) of every chain of two CALLS edges: a calls b, b calls c."""
    calls = edges.where("kind = 'CALLS'")
    first = calls.select("repo_id", F.concat_ws(":", "src_file", "src").alias("a"), F.concat_ws(":", "dst_file", "dst").alias("b")).distinct()
    second = calls.select("repo_id", F.concat_ws(":", "src_file", "src").alias("b"), F.concat_ws(":", "dst_file", "dst").alias("c")).distinct()
    return first.join(second, ["repo_id", "b"]).select("repo_id", "a", "b", "c")


def impact(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(seed, node, depth): what may break if a seed changes, the reversed closure of any edges, as far as they go (or ``rounds`` steps)."""
    return neighbours(edges, seeds, rounds, reverse=True)


def graph_nodes(symbols: DataFrame) -> DataFrame:
    """(repo_id, label, name, file_path): Function, Class and Module nodes; name and file together name a node."""
    label = F.when(F.col("type") == "class", "Class").otherwise("Function")
    named = symbols.where("type <> 'import'").select("repo_id", label.alias("label"), F.col("qualified_name").alias("name"), "file_path")
    return named.unionByName(symbols.select("repo_id", F.lit("Module").alias("label"), module_of("file_path").alias("name"), "file_path")).distinct()


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as tables; edges lie in one folder a kind."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- traversal -------------------------------------------------------------------------------------------------


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """(seed, node, depth): what each seed reaches in at most ``depth`` steps (None: any number), with the least depth; the seed itself at 0.

    ``edges`` has src and dst, ``seeds`` has seed.  Null ends join nothing; repeated edges count once.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = written(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct(), "steps")
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    reached = written(frontier.withColumn("depth", F.lit(0)), "reached")
    rounds = [reached]
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        new = rounds[-1].join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        new = new.join(_union(rounds).select("seed", "node"), ["seed", "node"], "left_anti")
        new = written(new.withColumn("depth", F.lit(d)), "reached")
        if new.isEmpty():
            break
        rounds.append(new)
    return _union(rounds)


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, path): every path without repeated nodes of 1 to ``depth`` steps from each seed."""
    steps = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("node is not null and next is not null").distinct(), "steps")
    paths = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct()
    out = None
    for _ in range(depth):
        paths = written(paths.join(steps, "node").where(~F.array_contains("path", F.col("next"))).select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")), "paths")
        out = paths if out is None else out.unionByName(paths)
    return out


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, steps, path): for each node reached, the least path by length and then by its nodes.

    One predecessor is kept a node and round, the least; so no more than one path a pair is ever carried.
    """
    steps = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("node is not null and next is not null").distinct(), "steps")
    rounds = [written(seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct(), "paths")]
    for _ in range(depth):
        new = rounds[-1].join(steps, "node").select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        new = new.groupBy("seed", "node").agg(F.min("path").alias("path"))
        new = new.join(_union(rounds).select("seed", "node"), ["seed", "node"], "left_anti")
        new = written(new.select("seed", "node", "path"), "paths")
        if new.isEmpty():
            break
        rounds.append(new)
    return _union(rounds).select("seed", "node", (F.size("path") - 1).alias("steps"), "path")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are in ``nodes`` (one column, node): two semi joins."""
    inside = nodes.select("node").distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")


def cyclic_nodes(edges: DataFrame, trims: int = 8, steps: int = 8) -> DataFrame:
    """(node) of every node that lies on a cycle: those of strong components of several nodes, or with an edge to themselves.

    A graph of at most LOCAL_EDGES edges is one task's work, in time proportional to its edges (Tarjan).  A larger one is trimmed of nodes without incoming
    or outgoing edges (two semi joins a round, at most ``trims`` rounds).  On what is still larger each node's own
    reachability decides: ``steps`` rounds by single edges and, where they don't end, squaring of the relation until nothing is new, so a cycle may have any length.
    """
    core = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "core")
    left = core.count()
    for _ in range(trims):
        if left <= LOCAL_EDGES:
            break
        kept = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = written(kept, "core")
        before, left = left, core.count()
        if left == before:
            break
    if left <= LOCAL_EDGES:
        return _cyclic_here(core)
    found = neighbours(core, core.select(F.col("src").alias("seed")).distinct(), steps)
    reach = written(found.select("seed", "node"), "reach")
    going = not found.where(F.col("depth") == steps).isEmpty()
    while going:
        beyond = reach.join(reach.select(F.col("seed").alias("node"), F.col("node").alias("next")), "node").select("seed", F.col("next").alias("node"))
        more = written(reach.union(beyond).distinct(), "reach")
        going = more.count() > reach.count()
        reach = more
    return reach.join(core.select(F.col("src").alias("node"), F.col("dst").alias("seed")), ["seed", "node"]).select(F.col("seed").alias("node")).distinct()


def _cyclic_here(edges: DataFrame) -> DataFrame:
    """``cyclic_nodes`` of a graph that fits in a task."""
    kind = dict(edges.select("src").union(edges.select("dst")).dtypes)["src"]  # of both ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([c for side in ("src", "dst") for c in table.column(side).chunks]).dictionary_encode()
        codes = ends.indices.to_numpy()
        yield pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(np.flatnonzero(on_cycles(codes[: len(table)], codes[len(table) :], len(ends.dictionary)))))], ["node"])

    return edges.select(*(F.col(c).cast(kind) for c in ("src", "dst"))).repartition(1).mapInArrow(run, f"node {kind}")


def on_cycles(src: np.ndarray, dst: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the nodes 0 .. nodes - 1 lie on a cycle of the edges: Tarjan's strong components, without recursion."""
    order = np.argsort(src, kind="stable")
    at, to = np.searchsorted(src[order], np.arange(nodes + 1)).tolist(), dst[order].tolist()
    out = np.zeros(nodes, bool)
    out[src[src == dst]] = True
    index, low, waiting, stack, count = [0] * nodes, [0] * nodes, [False] * nodes, [], 0
    edge = at[:-1]  # the next edge of each node
    for root in range(nodes):
        if index[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not index[v]:
                count += 1
                index[v] = low[v] = count
                stack.append(v)
                waiting[v] = True
            end = at[v + 1]
            i, least = edge[v], low[v]
            while i < end:
                w = to[i]
                if not index[w]:
                    break  # w is looked at again when it is done
                if waiting[w] and low[w] < least:
                    least = low[w]
                i += 1
            edge[v], low[v] = i, least
            if i < end:
                path.append(to[i])
                continue
            path.pop()
            if least == index[v]:
                group = []
                while True:
                    w = stack.pop()
                    waiting[w] = False
                    group.append(w)
                    if w == v:
                        break
                if len(group) > 1:
                    out[group] = True
    return out
