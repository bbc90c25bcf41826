"""Queries over sources, symbols, chunks and code graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import manifest as M
from codeloom.operators import pysource as P
from codeloom.session import table, written


def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.manifest(table(spark, sf_dir, "files")).select("repo_id", "path", "language")


def extension_language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the language that their extension tells, and whether the stored one agrees."""
    files = table(spark, sf_dir, "files").select("file_id", "path", F.lower("language").alias("stored"), M.language(F.col("path")).alias("language")).distinct()
    return files.groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("stored") == F.col("language")).alias("agreeing"))


def size_limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.size_check(M.manifest(table(spark, sf_dir, "files")), 100_000)


def ascii_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ascii_violations(table(spark, sf_dir, "documents"), "doc_id", "text")


def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.guarded_paths(table(spark, sf_dir, "files"), ["%/secrets%", "%/credentials%", "secrets%", "credentials%"])


def _parsed(spark: SparkSession, sf_dir: str, tags: tuple[str, ...]) -> DataFrame:
    return P.parse_files(table(spark, sf_dir, "files"), tags)


_SYMBOL_FIELDS = ["repo_id", "file_path", "name", "type", "start_line", "signature", "is_async", "parent_symbol", "qualified_name", "import_source", "import_alias", "is_wildcard_import"]


def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols parsed from the files' contents; the symbols table holds the same."""
    lists = [F.array_join(c, "|").alias(c) for c in ("decorators", "bases")]
    return P.symbols(_parsed(spark, sf_dir, ("symbol",))).select(*_SYMBOL_FIELDS, *lists).distinct()


def symbol_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = P.symbols(_parsed(spark, sf_dir, ("symbol",)))
    return symbols.groupBy("type").agg(F.count("*").alias("symbols"), F.count("signature").alias("signatures"), F.sum(F.size("decorators")).alias("decorators"), F.sum(F.size("bases")).alias("bases"))


def extract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunks(_parsed(spark, sf_dir, ("chunk",)))


def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed chunks by kind, and how many stay within the budget."""
    chunks = extract_chunks(spark, sf_dir)
    return chunks.groupBy("chunk_kind").agg(F.count("*").alias("chunks"), F.count_if(F.col("token_count") <= P.MAX_TOKENS).alias("within"), F.max("token_count").alias("largest"))


def ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, ("node",)).groupBy("type").agg(F.count("*").alias("nodes"), F.countDistinct("file_id").alias("files"))


def find_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, ("error",)).select("file_id", "file_path", "start_line", "end_line")


def parser_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rejects(table(spark, sf_dir, "files"))


def chunk_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived kind of each stored chunk: continuation, else module where both names are null, else definition."""
    kind = F.when(F.col("is_continuation"), "continuation").when(F.col("parent_symbol").isNull() & F.col("qualified_name").isNull(), "module").otherwise("definition")
    return table(spark, sf_dir, "chunks").select("chunk_id", kind.alias("chunk_kind")).distinct()


def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split definitions: their parts in order, and whether all are there."""
    parts = table(spark, sf_dir, "chunks").where("total_parts > 1").select("repo_id", "file_path", "qualified_name", "part", "total_parts").distinct()
    return parts.groupBy("repo_id", "file_path", "qualified_name", "total_parts").agg(F.count("*").alias("parts"), F.min("part").alias("first_part"), F.max("part").alias("last_part"))


def chunk_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads written as JSON objects and read back."""
    chunks = table(spark, sf_dir, "chunks")
    payload = chunks.select("chunk_id", F.to_json(F.struct(*chunks.columns)).alias("payload"))
    back = payload.select("chunk_id", F.from_json("payload", chunks.schema).alias("p"))
    return back.select("chunk_id", F.sha2("p.content", 256).alias("digest"), "p.start_line", "p.chunk_kind", "p.overlap_header").distinct()


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing as a fold: the non-blank lines of each document into groups of at most 128 tokens."""
    from codeloom.operators.folding import packed_lines

    return packed_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 128)


def module_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of imports and of definitions in each file (gaps and islands over the order of symbols)."""
    from codeloom.operators.folding import runs

    symbols = table(spark, sf_dir, "symbols").select("repo_id", "file_path", "ord", (F.col("type") == "import").alias("is_import")).distinct()
    return runs(symbols, ["repo_id", "file_path"], ["ord", "is_import"], "is_import")


def symbol_lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols that share a name with a symbol whose id is divisible by 20."""
    symbols = G.symbol_table(table(spark, sf_dir, "symbols"))
    wanted = symbols.where("symbol_id % 20 = 0").select("name").distinct()
    return symbols.join(wanted, "name", "left_semi").select("symbol_id", "name", "module", "start_line").distinct()


def symbol_lookup_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = G.symbol_table(table(spark, sf_dir, "symbols"))
    return symbols.groupBy("repo_id", "module", "qualified_name").agg(F.countDistinct("start_line").alias("definitions"))


def symbol_lookup_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symbol_table(table(spark, sf_dir, "symbols")).where(F.col("name").rlike(r"^(?:get|load|read|fetch)_[a-z]+$")).select("symbol_id", "name", "file_path").distinct()


def symbol_lookup_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").where(F.col("file_path").startswith("src/")).select("symbol_id", "file_path", "start_line").distinct()


def registry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol registry as JSON and back."""
    symbols = G.symbol_table(table(spark, sf_dir, "symbols")).select("symbol_id", "file_path", "start_line", "type", "signature", "docstring").distinct()
    schema = symbols.drop("symbol_id").schema
    back = symbols.select("symbol_id", F.from_json(F.to_json(F.struct(*schema.names)), schema).alias("r"))
    return back.select("symbol_id", "r.*")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.import_edges(table(spark, sf_dir, "symbols"))
    return edges.select("repo_id", "source_module", "target_module", "import_type", F.concat_ws(",", "imported_names").alias("imported_names"))


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges whose target is a module of the repository, against all."""
    symbols = table(spark, sf_dir, "symbols")
    edges = G.import_edges(symbols)
    modules = table(spark, sf_dir, "files").where("path like '%.py'").select("repo_id", G.module_of("path").alias("target_module")).distinct().withColumn("inside", F.lit(1))
    return edges.join(modules, ["repo_id", "target_module"], "left").groupBy("import_type").agg(F.count("*").alias("edges"), F.count("inside").alias("resolved"))


def wildcard_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").where("is_wildcard_import").select("symbol_id", "repo_id", "file_path", "import_source").distinct()


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contains_edges(table(spark, sf_dir, "symbols"))


def inherits_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.inherits_edges(table(spark, sf_dir, "symbols"))


def find_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calls(_parsed(spark, sf_dir, ("call",)))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = written(_parsed(spark, sf_dir, ("symbol", "call")), "parsed")
    return G.call_edges(P.calls(parsed), P.symbols(parsed))


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every imported name with the definition of its repository that it stands for, if any."""
    return G.import_targets(table(spark, sf_dir, "symbols"))


def name_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolver on every name that a file defines or imports, asked from every file of its repository that does so."""
    names = table(spark, sf_dir, "symbols").where("not is_wildcard_import and coalesce(qualified_name, name) is not null").select("repo_id", "file_path", F.lit(None).cast("string").alias("scope"), F.coalesce("qualified_name", "name").alias("name")).distinct()
    return G.resolved_names(names, table(spark, sf_dir, "symbols")).select("repo_id", "file_path", "name", "callee", "callee_file")


def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges that the symbols table holds."""
    return G.graph_edges(table(spark, sf_dir, "symbols"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_nodes(table(spark, sf_dir, "symbols"))


def code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class reaches in two steps: what it holds and inherits."""
    symbols = table(spark, sf_dir, "symbols")
    edges = G.graph_edges(symbols).where("kind in ('CONTAINS', 'INHERITS')")
    classes = symbols.where("type = 'class'").select(F.concat_ws(":", F.col("repo_id").cast("string"), "file_path", "qualified_name").alias("seed")).distinct()
    return G.neighbours(G.by_id(edges), classes, 2)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.import_edges(table(spark, sf_dir, "symbols"))
    return edges.select(F.concat_ws(":", F.col("repo_id").cast("string"), "source_module").alias("src"), F.concat_ws(":", F.col("repo_id").cast("string"), "target_module").alias("dst"))


def impact_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may break if an imported module changes: the reversed closure of the imports of its repository."""
    edges = _modules(spark, sf_dir)
    return G.impact(edges, edges.select(F.col("dst").alias("seed")).distinct())


def _succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts that follow each other in an order: the graph that the traversal queries walk."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.where("dst is not null and src <> dst").distinct()


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed"))


def neighbours_nhop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(_succession(spark, sf_dir), _seeds(spark, sf_dir), 2)


def callers_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(_succession(spark, sf_dir), _seeds(spark, sf_dir), 2, reverse=True)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_paths(_succession(spark, sf_dir), _seeds(spark, sf_dir), 2).select("seed", "node", "steps", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.simple_paths(_succession(spark, sf_dir), _seeds(spark, sf_dir), 2).select("seed", "node", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return G.induced(_succession(spark, sf_dir), nodes).select("src", "dst")


def cycle_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules on an import cycle, by repository; names are qualified with the repository."""
    edges = G.import_edges(table(spark, sf_dir, "symbols"))
    named = edges.select(F.concat_ws(":", "repo_id", "source_module").alias("src"), F.concat_ws(":", "repo_id", "target_module").alias("dst"))
    return G.cyclic_nodes(named)


def cycle_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles of the successions between parts of the smallest sizes."""
    nodes = table(spark, sf_dir, "part").where("p_size <= 3").select(F.col("p_partkey").alias("node"))
    return G.cyclic_nodes(G.induced(_succession(spark, sf_dir), nodes))


def graph_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph neighbours as retrieval results: chunks of a class and of what it holds within two steps, scored 1 / (1 + depth)."""
    symbols = table(spark, sf_dir, "symbols")
    name = F.concat_ws(":", F.col("repo_id").cast("string"), "file_path", "qualified_name")
    classes = symbols.where("type = 'class'").select(name.alias("seed")).distinct()
    reached = G.neighbours(G.by_id(G.graph_edges(symbols).where("kind = 'CONTAINS'")), classes, 2)
    chunks = table(spark, sf_dir, "chunks").where("qualified_name is not null").select("chunk_id", name.alias("node")).distinct()
    return reached.join(chunks, "node").select(F.col("seed").alias("query"), "chunk_id", F.round(1 / (1 + F.col("depth")), 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    manifest_filter, extension_language_lookup, size_limit_check, ascii_guard, path_guard, extract_symbols, symbol_details, extract_chunks, chunk_budget, ast_nodes, find_errors, parser_rejects, chunk_kind, chunk_parts, chunk_payload_json, chunk_pack, module_runs, symbol_lookup_exact, symbol_lookup_qualified, symbol_lookup_regex,
    symbol_lookup_path, registry_roundtrip, import_edges, import_resolution, wildcard_imports, contains_edges, inherits_edges, find_calls, call_edges, import_targets, name_targets, graph_store, graph_nodes, code_neighbours, impact_modules, neighbours_nhop, callers_reverse, shortest_path, all_paths, subgraph, cycle_detect, cycle_subgraph, graph_results,
)}

_MODULE = r"regexp_replace(regexp_replace(replace(regexp_replace({0}, '\.py$', ''), '/', '.'), '\.__init__$', ''), '^__init__$', '')"
_MANIFEST = r"""
    SELECT DISTINCT repo_id, path, CASE lower(regexp_extract(path, '(\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END AS language, CAST(coalesce(octet_length(encode(content)), size_bytes) AS BIGINT) AS size_bytes
    FROM files WHERE NOT regexp_matches(path, '(^|/)(\.[^/]*|node_modules|venv|env|__pycache__|dist|build|target|vendor)/')"""
_EDGES = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst"
_IMPORTS = rf"""
    i AS (SELECT DISTINCT repo_id, file_path, name, import_source, import_alias, is_wildcard_import, start_line FROM symbols WHERE type = 'import'),
    m AS (SELECT *, {_MODULE.format('file_path')} AS source_module, CASE WHEN import_alias IS NOT NULL AND regexp_matches(import_source, '[^.]\.[^.]+$') THEN regexp_replace(import_source, '\.[^.]+$', '') ELSE import_source END AS plain FROM i),
    d AS (SELECT *, length(regexp_extract(plain, '^(\.*)', 1)) AS dots, regexp_replace(plain, '^\.+', '') AS rest, list_filter(string_split(source_module, '.'), lambda x: x <> '') AS parts, CASE WHEN regexp_matches(file_path, '(^|/)__init__\.py$') THEN 1 ELSE 0 END AS pkg FROM m),
    t AS (SELECT *, CASE WHEN dots = 0 THEN rest ELSE array_to_string(list_concat(list_slice(parts, 1, greatest(len(parts) - (dots - pkg), 0)), CASE WHEN rest <> '' THEN [rest] ELSE [] END), '.') END AS target_module,
        CASE WHEN is_wildcard_import THEN 'wildcard' WHEN starts_with(import_source, '.') THEN 'relative' ELSE 'absolute' END AS import_type FROM d),
    e AS (SELECT repo_id, source_module, target_module, import_type, array_to_string(list_sort(list_distinct(list(name))), ',') AS imported_names FROM t GROUP BY ALL)"""


def _hops(a: str, b: str) -> str:
    return f"""WITH e AS ({_EDGES}), s AS (SELECT p_partkey AS seed FROM part WHERE p_partkey % 20 = 0),
        r AS (SELECT seed, seed AS node, 0 AS depth FROM s UNION SELECT seed, {b} AS node, 1 AS depth FROM s JOIN e ON seed = {a}
              UNION SELECT seed, y.{b} AS node, 2 AS depth FROM s JOIN e x ON seed = x.{a} JOIN e y ON x.{b} = y.{a})
        SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL"""


def _dotted(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' THEN {b} ELSE {a} || '.' || {b} END"


#: The resolver, for names asked outside any function: definitions of the file, imported names, re-exports, wildcards.
_RESOLVER = rf"""
    ib AS (SELECT DISTINCT repo_id, file_path, name, import_source, import_alias, is_wildcard_import, {_MODULE.format('file_path')} AS module, CASE WHEN regexp_matches(file_path, '(^|/)__init__\.py$') THEN 1 ELSE 0 END AS pkg FROM symbols WHERE type = 'import'),
    ia AS (SELECT *, length(regexp_extract(import_source, '^(\.*)', 1)) AS dots, regexp_replace(import_source, '^\.+', '') AS rest, list_filter(string_split(module, '.'), lambda x: x <> '') AS parts FROM ib),
    ic AS (SELECT *, CASE WHEN dots = 0 THEN rest ELSE array_to_string(list_concat(list_slice(parts, 1, greatest(len(parts) - (dots - pkg), 0)), CASE WHEN rest <> '' THEN [rest] ELSE [] END), '.') END AS source FROM ia),
    bd AS (SELECT repo_id, file_path, name AS local, CASE WHEN import_alias IS NOT NULL THEN source ELSE {_dotted('source', 'name')} END AS path FROM ic WHERE NOT is_wildcard_import AND name NOT LIKE '%.%'
           UNION SELECT repo_id, file_path, regexp_extract(name, '^([^.]+)', 1), regexp_extract(name, '^([^.]+)', 1) FROM ic WHERE NOT is_wildcard_import AND import_alias IS NULL AND name = import_source),
    dp AS (SELECT repo_id, {_dotted('m', 'qualified_name')} AS path, qualified_name AS far, file_path AS far_file FROM (SELECT *, {_MODULE.format('file_path')} AS m FROM symbols) WHERE type <> 'import' AND qualified_name IS NOT NULL AND qualified_name NOT LIKE '%<locals>%'
           QUALIFY row_number() OVER (PARTITION BY repo_id, {_dotted('m', 'qualified_name')} ORDER BY file_path, qualified_name) = 1),
    im AS (SELECT a.repo_id, a.file_path, a.name, b.path || regexp_extract(a.name, '^[^.]+(\..*)?$', 1) AS path FROM asked a JOIN bd b ON a.repo_id = b.repo_id AND a.file_path = b.file_path AND regexp_extract(a.name, '^([^.]+)', 1) = b.local),
    op AS (SELECT a.repo_id, a.file_path, a.name, 4 AS o, s.qualified_name AS callee, s.file_path AS callee_file FROM asked a JOIN symbols s ON s.type <> 'import' AND s.repo_id = a.repo_id AND s.file_path = a.file_path AND s.qualified_name = a.name
           UNION ALL SELECT im.repo_id, im.file_path, name, 5, far, far_file FROM im JOIN dp USING (repo_id, path)
           UNION ALL SELECT im.repo_id, im.file_path, im.name, 6, d.far, d.far_file FROM im JOIN (SELECT DISTINCT repo_id, file_path AS home, {_MODULE.format('file_path')} AS module FROM symbols) h ON h.repo_id = im.repo_id AND h.module = regexp_replace(im.path, '\.[^.]+$', '') JOIN bd b ON b.repo_id = im.repo_id AND b.file_path = h.home AND b.local = regexp_extract(im.path, '([^.]+)$', 1) JOIN dp d ON d.repo_id = im.repo_id AND d.path = b.path
           UNION ALL SELECT a.repo_id, a.file_path, a.name, 7, d.far, d.far_file FROM asked a JOIN ic ON ic.is_wildcard_import AND ic.repo_id = a.repo_id AND ic.file_path = a.file_path JOIN dp d ON d.repo_id = a.repo_id AND d.path = {_dotted('ic.source', 'a.name')}),
    bs AS (SELECT * FROM op QUALIFY row_number() OVER (PARTITION BY repo_id, file_path, name ORDER BY o, callee_file, callee) = 1),
    rs AS (SELECT a.repo_id, a.file_path, a.name, b.callee, b.callee_file FROM asked a LEFT JOIN bs b ON b.repo_id = a.repo_id AND b.file_path = a.file_path AND b.name = a.name)"""
_GRAPH = f"""{_IMPORTS}, asked AS (SELECT DISTINCT repo_id, file_path, unnest(bases) AS name FROM symbols WHERE type = 'class'), {_RESOLVER},
    hm AS (SELECT repo_id, {_MODULE.format('file_path')} AS module, min(file_path) AS home FROM symbols GROUP BY ALL),
    graph AS (SELECT DISTINCT repo_id, 'CONTAINS' AS kind, file_path AS src_file, parent_symbol AS src, file_path AS dst_file, qualified_name AS dst FROM symbols WHERE type <> 'import' AND parent_symbol IS NOT NULL
        UNION SELECT c.repo_id, 'INHERITS', c.file_path, c.src, rs.callee_file, coalesce(rs.callee, c.name) FROM (SELECT DISTINCT repo_id, file_path, qualified_name AS src, unnest(bases) AS name FROM symbols WHERE type = 'class') c LEFT JOIN rs ON rs.repo_id = c.repo_id AND rs.file_path = c.file_path AND rs.name = c.name
        UNION SELECT e.repo_id, 'IMPORTS', s.home, e.source_module, t.home, e.target_module FROM e LEFT JOIN hm s ON s.repo_id = e.repo_id AND s.module = e.source_module LEFT JOIN hm t ON t.repo_id = e.repo_id AND t.module = e.target_module)"""
_PATHS = f"""e AS ({_EDGES}), s AS (SELECT p_partkey AS seed FROM part WHERE p_partkey % 20 = 0),
    p AS (SELECT seed, dst AS node, [seed, dst] AS path FROM s JOIN e ON seed = src UNION ALL SELECT seed, y.dst AS node, [seed, x.dst, y.dst] AS path FROM s JOIN e x ON seed = x.src JOIN e y ON x.dst = y.src WHERE y.dst <> seed)"""
SQL = {
    "manifest_filter": f"SELECT DISTINCT repo_id, path, language FROM ({_MANIFEST}) WHERE language IS NOT NULL",
    "extension_language_lookup": f"""SELECT language, count(*) AS files, count(*) FILTER (stored = language) AS agreeing FROM (SELECT DISTINCT file_id, path, lower(language) AS stored, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END AS language FROM files) GROUP BY ALL""",
    "size_limit_check": f"SELECT repo_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, sum(size_bytes) > 100000 AS too_large FROM ({_MANIFEST}) WHERE language IS NOT NULL GROUP BY ALL",
    "ascii_guard": r"SELECT DISTINCT doc_id, CAST(n AS INTEGER) AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(line, '[^\t -~]')",
    "path_guard": "SELECT DISTINCT path FROM files WHERE path LIKE '%/secrets%' OR path LIKE '%/credentials%' OR path LIKE 'secrets%' OR path LIKE 'credentials%'",
    "extract_symbols": f"SELECT DISTINCT {', '.join(_SYMBOL_FIELDS)}, array_to_string(decorators, '|') AS decorators, array_to_string(bases, '|') AS bases FROM symbols",
    "symbol_details": "SELECT type, count(*) AS symbols, count(signature) AS signatures, CAST(sum(len(decorators)) AS BIGINT) AS decorators, CAST(sum(len(bases)) AS BIGINT) AS bases FROM (SELECT DISTINCT symbol_id, type, signature, decorators, bases FROM symbols) GROUP BY ALL",
    "cycle_detect": f"""WITH RECURSIVE {_IMPORTS}, n AS (SELECT DISTINCT repo_id || ':' || source_module AS src, repo_id || ':' || target_module AS dst FROM e), r AS (SELECT src, dst FROM n UNION SELECT r.src, n.dst FROM r JOIN n ON r.dst = n.src) SELECT DISTINCT src AS node FROM r WHERE src = dst""",
    "parser_rejects": r"SELECT DISTINCT file_id, path, coalesce(lower(trim(language)), regexp_extract(lower(path), '\.([^./]+)$', 1)) AS language, 'unsupported language: ' || coalesce(lower(trim(language)), regexp_extract(lower(path), '\.([^./]+)$', 1)) AS reason FROM files WHERE coalesce(lower(trim(language)), regexp_extract(lower(path), '\.([^./]+)$', 1)) NOT IN ('python', 'py')",
    "chunk_kind": "SELECT DISTINCT chunk_id, chunk_kind FROM chunks",
    "chunk_parts": "SELECT repo_id, file_path, qualified_name, total_parts, count(*) AS parts, min(part) AS first_part, max(part) AS last_part FROM (SELECT DISTINCT repo_id, file_path, qualified_name, part, total_parts FROM chunks WHERE total_parts > 1) GROUP BY ALL",
    "chunk_payload_json": "SELECT DISTINCT chunk_id, sha256(content) AS digest, start_line, chunk_kind, overlap_header FROM chunks",
    "module_runs": """WITH s AS (SELECT DISTINCT repo_id, file_path, ord, type = 'import' AS is_import FROM symbols), f AS (SELECT *, CASE WHEN is_import = lag(is_import) OVER (PARTITION BY repo_id, file_path ORDER BY ord, is_import) THEN 0 ELSE 1 END AS fresh FROM s),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY repo_id, file_path ORDER BY ord, is_import) AS run FROM f) SELECT repo_id, file_path, CAST(run AS BIGINT) AS run, is_import, count(*) AS length FROM r GROUP BY ALL""",
    "symbol_lookup_exact": f"SELECT DISTINCT symbol_id, name, {_MODULE.format('file_path')} AS module, start_line FROM symbols WHERE type <> 'import' AND name IN (SELECT name FROM symbols WHERE type <> 'import' AND symbol_id % 20 = 0)",
    "symbol_lookup_qualified": f"SELECT repo_id, {_MODULE.format('file_path')} AS module, qualified_name, count(DISTINCT start_line) AS definitions FROM symbols WHERE type <> 'import' GROUP BY ALL",
    "symbol_lookup_regex": "SELECT DISTINCT symbol_id, name, file_path FROM symbols WHERE type <> 'import' AND regexp_matches(name, '^(get|load|read|fetch)_[a-z]+$')",
    "symbol_lookup_path": "SELECT DISTINCT symbol_id, file_path, start_line FROM symbols WHERE starts_with(file_path, 'src/')",
    "registry_roundtrip": "SELECT DISTINCT symbol_id, file_path, start_line, type, signature, docstring FROM symbols WHERE type <> 'import'",
    "import_edges": f"WITH {_IMPORTS} SELECT * FROM e",
    "import_resolution": f"WITH {_IMPORTS}, h AS (SELECT DISTINCT repo_id, {_MODULE.format('path')} AS target_module, 1 AS inside FROM files WHERE path LIKE '%.py') SELECT import_type, count(*) AS edges, count(inside) AS resolved FROM e LEFT JOIN h USING (repo_id, target_module) GROUP BY ALL",
    "wildcard_imports": "SELECT DISTINCT symbol_id, repo_id, file_path, import_source FROM symbols WHERE is_wildcard_import",
    "contains_edges": "SELECT DISTINCT repo_id, file_path, parent_symbol AS src, qualified_name AS dst FROM symbols WHERE type <> 'import' AND parent_symbol IS NOT NULL",
    "inherits_edges": "SELECT DISTINCT repo_id, file_path, src, dst FROM (SELECT repo_id, file_path, qualified_name AS src, unnest(bases) AS dst FROM symbols WHERE type = 'class')",
    "import_targets": f"WITH asked AS (SELECT DISTINCT repo_id, file_path, name FROM symbols WHERE type = 'import' AND NOT is_wildcard_import), {_RESOLVER} SELECT * FROM rs",
    "name_targets": f"WITH asked AS (SELECT DISTINCT repo_id, file_path, coalesce(qualified_name, name) AS name FROM symbols WHERE NOT is_wildcard_import AND coalesce(qualified_name, name) IS NOT NULL), {_RESOLVER} SELECT * FROM rs",
    "graph_store": f"WITH {_GRAPH} SELECT * FROM graph",
    "graph_nodes": f"""SELECT repo_id, CASE WHEN type = 'class' THEN 'Class' ELSE 'Function' END AS label, qualified_name AS name, file_path FROM symbols WHERE type <> 'import' UNION SELECT repo_id, 'Module', {_MODULE.format('file_path')}, file_path FROM symbols""",
    "code_neighbours": f"""WITH {_GRAPH}, g AS (SELECT DISTINCT repo_id || ':' || src_file || ':' || src AS src, repo_id || ':' || coalesce(dst_file, '') || ':' || dst AS dst FROM graph WHERE kind IN ('CONTAINS', 'INHERITS')), z AS (SELECT DISTINCT repo_id || ':' || file_path || ':' || qualified_name AS seed FROM symbols WHERE type = 'class'),
        r AS (SELECT seed, seed AS node, 0 AS depth FROM z UNION ALL SELECT seed, dst, 1 FROM z JOIN g ON g.src = seed UNION ALL SELECT seed, y.dst, 2 FROM z JOIN g x ON x.src = seed JOIN g y ON y.src = x.dst) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL""",
    "impact_modules": f"""WITH RECURSIVE {_IMPORTS}, g AS (SELECT DISTINCT repo_id || ':' || source_module AS src, repo_id || ':' || target_module AS dst FROM e), r AS (SELECT DISTINCT dst AS seed, dst AS node, 0 AS depth FROM g UNION SELECT r.seed, g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < 12)
        SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL""",
    "cycle_subgraph": f"""WITH RECURSIVE q AS ({_EDGES}), n AS (SELECT src, dst FROM q WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 3) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 3)), r AS (SELECT src, dst FROM n UNION SELECT r.src, n.dst FROM r JOIN n ON r.dst = n.src) SELECT DISTINCT src AS node FROM r WHERE src = dst""",
    "neighbours_nhop": _hops("src", "dst"),
    "callers_reverse": _hops("dst", "src"),
    "shortest_path": f"WITH {_PATHS}, a AS (SELECT seed, seed AS node, [seed] AS path FROM s UNION ALL SELECT * FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY len(path), path) AS n FROM a) SELECT seed, node, CAST(len(path) - 1 AS INTEGER) AS steps, array_to_string(path, '>') AS path FROM r WHERE n = 1",
    "all_paths": f"WITH {_PATHS} SELECT seed, node, array_to_string(path, '>') AS path FROM p",
    "subgraph": f"WITH e AS ({_EDGES}) SELECT src, dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 10)",
    "graph_results": """WITH g AS (SELECT DISTINCT repo_id || ':' || file_path || ':' || parent_symbol AS src, repo_id || ':' || file_path || ':' || qualified_name AS dst FROM symbols WHERE type <> 'import' AND parent_symbol IS NOT NULL),
        z AS (SELECT DISTINCT repo_id || ':' || file_path || ':' || qualified_name AS seed FROM symbols WHERE type = 'class'), r AS (SELECT seed, seed AS node, 0 AS depth FROM z UNION ALL SELECT seed, dst, 1 FROM z JOIN g ON g.src = seed UNION ALL SELECT seed, y.dst, 2 FROM z JOIN g x ON x.src = seed JOIN g y ON y.src = x.dst),
        d AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT d.seed AS query, c.chunk_id, round(1 / (1 + d.depth), 6) AS score FROM d JOIN (SELECT DISTINCT chunk_id, repo_id || ':' || file_path || ':' || qualified_name AS node FROM chunks WHERE qualified_name IS NOT NULL) c USING (node)""",
    "chunk_pack": r"""WITH RECURSIVE l AS (SELECT doc_id, n, len(regexp_extract_all(line, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
        f AS (SELECT doc_id, k, t, t AS total, 1 AS grp FROM l WHERE k = 1 UNION ALL SELECT l.doc_id, l.k, l.t, CASE WHEN f.total > 0 AND f.total + l.t > 128 THEN l.t ELSE f.total + l.t END, CASE WHEN f.total > 0 AND f.total + l.t > 128 THEN f.grp + 1 ELSE f.grp END FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1)
        SELECT doc_id, CAST(grp AS INTEGER) AS part, count(*) AS lines, CAST(sum(t) AS BIGINT) AS tokens FROM f GROUP BY ALL""",
}
