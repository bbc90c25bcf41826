"""Queries of the operators in this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.tokens import TOKEN_PATTERN
from codeloom.llm.doc_pairs import documented_functions, documented_symbols
from codeloom.llm.generated import profiles, unwritten_files
from codeloom.llm.leakage import RUN, leaked_spans, leaks
from codeloom.llm.neardup import definition_groups, similar_definitions
from codeloom.llm.packing import CAPACITY, pack
from codeloom.llm.parse_errors import failure_rates, invalid_files
from codeloom.llm.qa_defects import defective_pairs
from codeloom.llm.residue import residual_documents
from codeloom.llm.secrets import credential_spans, redacted_rows
from codeloom.llm.splitting import MAX_TOKENS, oversized_ids, split_oversized
from codeloom.session import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_spans(table(spark, sf_dir, "chunks")).select("chunk_id", "line_no").distinct()


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_spans(table(spark, sf_dir, "chunks"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_rows(table(spark, sf_dir, "chunks"))


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of whole files, with the paths that hold them."""
    files = table(spark, sf_dir, "files")
    paths = files.select("file_id", "repo_id", "path").where("file_id is not null").dropDuplicates(["file_id"])
    config = F.col("path").rlike(r"(?i)(?:^|[/_.-])(?:config|conf|settings?|secrets?|credentials?|deploy|env|local_env)(?:[_.-]|$)")
    return credential_spans(files, "file_id").join(paths, "file_id").select("file_id", "repo_id", "path", config.alias("config_like"), "line_no", "detector")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_ids(table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))


def p2_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each chunk put together again without their overlaps, and whether all are within the limit and flagged."""
    pieces = split_oversized(table(spark, sf_dir, "chunks"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", F.expr("substr(content, overlap_chars + 1)").alias("own"))))
    whole = F.array_join(F.transform(ordered, lambda x: x["own"]), "")
    return pieces.groupBy("chunk_id").agg(F.sha2(whole, 256).alias("digest"), F.min((F.col("token_count") <= MAX_TOKENS) & (F.col("is_continuation") == (F.col("piece") > 1))).alias("sound"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_symbols(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files")).select("symbol_id")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_symbols(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"))


def p3_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "files")).select("file_id")


def p4_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "files"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_rates(table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_definitions(table(spark, sf_dir, "chunks")).select("chunk_id_a", "chunk_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definition_groups(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten_files(table(spark, sf_dir, "files")).select("file_id")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten_files(table(spark, sf_dir, "files"))


def p6_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(table(spark, sf_dir, "files")).drop("shared").dropDuplicates(["file_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(table(spark, sf_dir, "query_logs"))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("defect").agg(F.countDistinct("id").alias("pairs"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens were packed, whether any container exceeds the capacity, and whether there are at most 1 % more containers than the tokens need."""
    packed = written(p8_containers(spark, sf_dir), "pack-report")
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("fill"))
    fills = bins.agg(F.sum("fill").alias("tokens"), (F.max("fill") > CAPACITY).alias("exceeded"), (F.count("*") <= F.ceil(F.sum("fill") / CAPACITY) * 1.01 + 1).alias("tight"))
    return fills.crossJoin(packed.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("pieces")))  # one row each


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_spans, p1_redacted, p1_files, p2_found, p2_pieces, p2_reassembled, p3_found, p3_pairs, p3_islands, p4_found, p4_failures, p4_rates, p5_found, p5_groups, p6_found, p6_kinds, p6_grammars, p7_found, p7_rates, p8_containers, p8_report, p9_found, p9_spans, p10_found, p10_reasons,
)}

_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))"
_RUNS = f"unnest(list_transform(range(1, len(w) - {RUN - 2}), lambda i: array_to_string(w[i : i + {RUN - 1}], ' ')))"


def _count(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{TOKEN_PATTERN}'))"


SQL: dict[str, str] = {
    "p2_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND {_count('content')} > {MAX_TOKENS}",
    "p2_reassembled": f"SELECT DISTINCT chunk_id, sha256(content) AS digest, true AS sound FROM chunks WHERE chunk_id IS NOT NULL AND {_count('content')} > {MAX_TOKENS}",
    "p5_found": f"""
        WITH d AS (SELECT DISTINCT chunk_id, repo_id, file_path, start_line, end_line, regexp_extract_all(lower(content), '{TOKEN_PATTERN}') AS t FROM chunks WHERE qualified_name IS NOT NULL AND total_parts = 1),
             e AS (SELECT * FROM d WHERE len(t) >= 40),
             g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i : i + 2], ' '))) AS gram FROM e),
             n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY ALL),
             o AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT x AS chunk_id_a, y AS chunk_id_b FROM o JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y JOIN e a ON a.chunk_id = x JOIN e b ON b.chunk_id = y
        WHERE s >= 0.7 * (p.n + q.n - s) - 1e-9 AND NOT coalesce(a.repo_id = b.repo_id AND a.file_path = b.file_path AND a.start_line <= b.end_line AND b.start_line <= a.end_line, false)""",
    "p8_report": f"""
        WITH sized AS (SELECT DISTINCT doc_id, {_count('text')} AS n FROM documents WHERE doc_id IS NOT NULL)
        SELECT CAST(sum(n) AS BIGINT) AS tokens, false AS exceeded, true AS tight, CAST(count(*) AS BIGINT) AS documents,
               CAST(sum((n + {CAPACITY - 1}) // {CAPACITY}) AS BIGINT) AS pieces
        FROM sized WHERE n > 0""",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_RUNS} AS run FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= {RUN}),
             e AS (SELECT item_id, {_RUNS} AS run FROM (SELECT item_id, {_WORDS} AS w FROM eval_items) WHERE len(w) >= {RUN})
        SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run)""",
}
