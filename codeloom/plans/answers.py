"""Queries of planning, context, citations, evaluation and metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import token_count
from codeloom.functions.tokens import TOKEN_PATTERN
from codeloom.operators import context as C
from codeloom.operators import evaluation as E
from codeloom.operators import metadata as D
from codeloom.operators import planning as P
from codeloom.plans import search as S
from codeloom.session import table, written


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_logs").select("id", "query_text", "response_text").distinct()


def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).select("id", P.query_type(F.col("query_text")).alias("query_type"), P.confidence(F.col("query_text")).alias("confidence")).distinct()


def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).select("id", P.strategy(F.col("query_text")).alias("strategy")).distinct()


def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = P.plan_steps(_logs(spark, sf_dir).select("id", "query_text").distinct(), "id", "query_text")
    return steps.select("id", "step", "text", "expected", F.concat_ws(",", F.col("context_from").cast("array<string>")).alias("context_from"))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.levels(P.plan_steps(_logs(spark, sf_dir).select("id", "query_text").distinct(), "id", "query_text"), "id")


def synthesize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found by two steps (content and name searches), deduplicated with their steps."""
    by_text = S.bm25_code(spark, sf_dir).select("query_id", "chunk_id", "score", F.lit(1).alias("step"))
    boosted = S.bm25_boosted(spark, sf_dir).select("query_id", "chunk_id", "score", F.lit(2).alias("step"))
    merged = P.synthesise(by_text.unionByName(boosted), "query_id", "chunk_id")
    return merged.select("query_id", "chunk_id", "score", F.concat_ws(",", F.col("steps").cast("array<string>")).alias("steps"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found chunks with their places and tokens; a text is counted where it lies and not moved."""
    found = S.bm25_code(spark, sf_dir).select("query_id", "chunk_id", "rank")
    chunks = S.of_found(table(spark, sf_dir, "chunks"), found).select("chunk_id", "file_path", "start_line", token_count("content").alias("tokens")).dropDuplicates(["chunk_id"])
    return found.join(chunks, "chunk_id")


def context_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.within_budget(_ranked(spark, sf_dir), "query_id", "tokens", 2000).select("query_id", "chunk_id", "rank", "running_tokens")


def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts, prompts and default answers; whether the prompt fits, and what the answer cites."""
    chosen = written(C.within_budget(_ranked(spark, sf_dir), "query_id", "tokens", 2000), "chosen")
    texts = S.of_found(table(spark, sf_dir, "chunks").select("chunk_id", "language", "end_line", "content"), chosen).dropDuplicates(["chunk_id"])
    chosen = chosen.join(texts, "chunk_id")
    asked = table(spark, sf_dir, "query_logs").where("id % 20 = 0").select(F.col("id").alias("query_id"), "query_text").distinct()
    joined = C.assembled(chosen, "query_id").join(asked, "query_id")
    text = C.prompt(F.col("query_text"), F.col("context"), P.query_type(F.col("query_text")))
    return joined.select("query_id", token_count(text).alias("prompt_tokens"), C.prompt_fits(text, 4000).alias("fits"), C.extractive_answer(F.col("query_text"), F.col("context")).alias("answer"))


def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the chosen chunks by file and line."""
    from pyspark.sql import Window

    chosen = C.within_budget(_ranked(spark, sf_dir), "query_id", "tokens", 2000)
    w = Window.partitionBy("query_id").orderBy("file_path", "start_line", "chunk_id")
    return chosen.select("query_id", "chunk_id", F.row_number().over(w).alias("position"))


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "chunks").where("chunk_kind = 'definition'").select("repo_id", "file_path", "start_line", "end_line").distinct()
    return C.merged_spans(spans, ["repo_id", "file_path"]).select("repo_id", "file_path", "island", "start_line", "end_line", "spans")


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.citations(_logs(spark, sf_dir), "id", "response_text").distinct()


def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation, whether a chunk of the question's repository holds its lines, and the cited lines of the narrowest such chunk."""
    logs = table(spark, sf_dir, "query_logs").select("id", "repository_id", "response_text").distinct()
    cited = C.citations(logs, "id", "response_text").join(logs.select("id", "repository_id").distinct(), "id")
    checked = C.validated(cited, table(spark, sf_dir, "chunks"), "id", "repository_id")
    return checked.select("id", "number", "file_path", "start_line", "end_line", "valid", "chunk_id", F.sha2("snippet", 256).alias("snippet"))


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with claims, and how many of them carry at least one citation."""
    logs = _logs(spark, sf_dir).where("response_text is not null")
    return logs.select("id", C.coverage(F.col("response_text")).alias("coverage")).distinct()


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two rankings of vectors for each stated query, and as relevant the vectors of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = written(S.vector_topk(spark, sf_dir).where("query_id <> vec_id").select("query_id", "vec_id", F.col("rank").alias("raw")), "ranked")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = asked.join(vectors, "label").where("query_id <> vec_id").select("query_id", "vec_id")
    full = S.R.top(ranked.withColumn("score", -F.col("raw")), "query_id", "vec_id").select("query_id", "vec_id", "rank")
    reverse = S.R.top(ranked.withColumn("score", F.col("raw")), "query_id", "vec_id").select("query_id", "vec_id", "rank")
    return full, reverse, gold


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision, reciprocal rank and NDCG at 10."""
    full, _, gold = _judged(spark, sf_dir)
    return E.retrieval_metrics(full, gold, "query_id", "vec_id", 10)


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(retrieval_metrics(spark, sf_dir), [], ["recall", "precision", "reciprocal_rank", "ndcg"])


def strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, reverse, gold = _judged(spark, sf_dir)
    both = E.retrieval_metrics(full, gold, "query_id", "vec_id", 10).withColumn("strategy", F.lit("vector")).unionByName(E.retrieval_metrics(reverse, gold, "query_id", "vec_id", 10).withColumn("strategy", F.lit("reversed")))
    return E.compared(both, "strategy", "ndcg", "vector")


def answer_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question terms that answers take up, and the class of what fails."""
    logs = _logs(spark, sf_dir).where("query_text is not null")
    scored = logs.select("id", E.containment(F.col("query_text"), F.col("response_text")).alias("relevance"), token_count("response_text").alias("tokens"), (F.length(F.trim("response_text")) > 0).alias("present"))
    return scored.select("id", "relevance", E.failure_class(F.coalesce("present", F.lit(False)), F.col("relevance"), F.col("tokens"), 400).alias("class")).distinct()


def claim_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of answers against the question and the answer's code: the share that they support, and the rate of hallucination."""
    logs = _logs(spark, sf_dir).groupBy("id").agg(F.max("query_text").alias("query_text"), F.max("response_text").alias("response_text"))
    return E.faithfulness(logs, "id", "response_text", "query_text")


def strategy_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways of retrieval compared: by content, by name, by content with names boosted, and both fused; relevant are the chunks of the repository that a question is about."""
    homes = written(table(spark, sf_dir, "chunks").where("chunk_id is not null and repo_id is not null").select("chunk_id", F.col("repo_id").alias("repository_id")).distinct(), "homes")
    logs = table(spark, sf_dir, "query_logs").where("id % 20 = 0").select(F.col("id").alias("query_id"), "repository_id").distinct()
    # how many chunks are relevant is told by the repository; a chunk of several repositories of one question is one
    sizes = logs.join(homes.groupBy("repository_id").agg(F.count("*").alias("n")), "repository_id").select("query_id", "n")
    several = homes.groupBy("chunk_id").agg(F.collect_list("repository_id").alias("homes")).where(F.size("homes") > 1).select("chunk_id", F.explode("homes").alias("repository_id"))
    again = several.join(logs, "repository_id").groupBy("query_id", "chunk_id").agg((1 - F.count("*")).alias("n")).select("query_id", "n")
    sizes = written(sizes.unionByName(again).groupBy("query_id").agg(F.sum("n").alias("n_relevant")), "relevant")
    ways = {"content": S.bm25_code(spark, sf_dir), "name": S.found_chunks(spark, sf_dir, "qualified_name"), "boosted": S.bm25_boosted(spark, sf_dir), "fused": S.rrf_fuse(spark, sf_dir)}
    found = [r.select("query_id", "chunk_id", "rank", F.lit(n).alias("strategy")) for n, r in ways.items()]
    found = written(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]), "ways")
    hits = found.join(S.of_found(homes, found), "chunk_id").join(logs, ["query_id", "repository_id"], "left_semi").drop("repository_id").distinct()
    each = [E.metrics_of_hits(hits.where(F.col("strategy") == n), sizes, "query_id", 10).withColumn("strategy", F.lit(n)) for n in ways]
    return E.compared(each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]), "strategy", "ndcg", "content")


def ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the files: every question whose id is divisible by 20, answered from its repository."""
    from codeloom.api import ask, ingest

    questions = table(spark, sf_dir, "query_logs").where("id % 20 = 0").select(F.col("id").alias("query_id"), "query_text", F.col("repository_id").alias("repo_id")).dropDuplicates(["query_id"])
    out = ask(questions, ingest(table(spark, sf_dir, "files")))
    return out.select("query_id", "query_type", "strategy", "chunks", token_count("context").alias("context_tokens"), "answer", "citations", "valid_citations")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.over_limit(table(spark, sf_dir, "events"), "user_id", "ts", 1)


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table after the users whose id is divisible by 20 are deleted."""
    t = {n: table(spark, sf_dir, n) for n in D.TABLES}
    left = D.cascade(t["users"], t["repositories"], t["ingestion_jobs"], t["query_logs"], t["users"].where("id % 20 = 0"))
    parts = [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, d in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "users")
    return D.duplicates(users, "id", "username").withColumn("field", F.lit("username")).unionByName(D.duplicates(users, "id", "email").withColumn("field", F.lit("email")))


def enum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = D.invalid_states(table(spark, sf_dir, "ingestion_jobs"), "id", "status", D.JOB_STATES).withColumn("name", F.lit("ingestion_jobs"))
    return jobs.unionByName(D.invalid_states(table(spark, sf_dir, "repositories"), "id", "status", D.REPOSITORY_STATES).withColumn("name", F.lit("repositories")))


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a row they point at: none in these tables."""
    jobs = D.orphans(table(spark, sf_dir, "ingestion_jobs"), table(spark, sf_dir, "repositories"), "repository_id").agg(F.count("*").alias("rows")).withColumn("name", F.lit("ingestion_jobs"))
    logs = D.orphans(table(spark, sf_dir, "query_logs"), table(spark, sf_dir, "users"), "user_id").agg(F.count("*").alias("rows")).withColumn("name", F.lit("query_logs"))
    return jobs.unionByName(logs)


def current_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.current_jobs(table(spark, sf_dir, "ingestion_jobs")).select("id", "repository_id", "status")


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with the status of their latest job; null without one."""
    repositories = table(spark, sf_dir, "repositories").select(F.col("id").alias("repository_id"), "name", F.lower("status").alias("repository_status"))
    return repositories.join(D.latest_job(table(spark, sf_dir, "ingestion_jobs")), "repository_id", "left")


def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repositories").select("id", D.normal_url(F.col("url")).alias("url"))


QUERIES = {f.__name__: f for f in (
    classify_query, route_query, decompose, topo_levels, synthesize_dedupe, context_truncate, context_assemble, context_order, overlap_merge, citation_extract, citation_validate, citation_coverage, retrieval_metrics, metric_summary, strategy_compare, strategy_ways, answer_faithfulness, claim_faithfulness, ask_answers, latency_percentiles,
    rate_limit, cascade_delete, unique_violations, enum_check, orphan_check, current_jobs, latest_status, repository_urls,
)}

_LOGS = "(SELECT DISTINCT id, query_text, response_text FROM query_logs)"


def _m(pattern: str, column: str = "query_text") -> str:
    return f"regexp_matches({column}, '{pattern}')"


_STRUCT = f"({_m(P.STRUCTURAL)} OR {_m(P.IMPACT)})"
_TYPE = f"CASE WHEN {_STRUCT} THEN 'multi-hop' WHEN {_m(P.EXPLORE)} THEN 'exploratory' WHEN {_m(P.LOOKUP)} THEN 'simple-lookup' ELSE 'multi-hop' END"
_SUBJECT = f"coalesce(nullif(regexp_extract(query_text, '({P.IDENTIFIER})', 1), ''), query_text)"
_STEPS = f"""(SELECT id, 1 AS step, query_text AS text, 'location' AS expected, '' AS context_from FROM k WHERE t = 'simple-lookup'
    UNION ALL SELECT id, 1, 'Where is ' || subject || ' defined?', 'location', '' FROM k WHERE t = 'multi-hop' UNION ALL SELECT id, 2, 'Which code reaches ' || subject || '?', 'symbols', '1' FROM k WHERE t = 'multi-hop' UNION ALL SELECT id, 3, query_text, 'explanation', '1,2' FROM k WHERE t = 'multi-hop'
    UNION ALL SELECT id, 1, 'Find the parts about ' || subject, 'chunks', '' FROM k WHERE t = 'exploratory' UNION ALL SELECT id, 2, query_text, 'explanation', '1' FROM k WHERE t = 'exploratory')"""
_KINDS = f"WITH k AS (SELECT DISTINCT id, query_text, {_TYPE} AS t, {_SUBJECT} AS subject FROM query_logs WHERE length(trim(query_text)) > 0)"
_CONTEXT = f"""WITH {S._CODE}, a AS ({S._top_sql('s', 'query_id', 'chunk_id')}), c AS (SELECT chunk_id, any_value(file_path) AS file_path, any_value(start_line) AS start_line, len(regexp_extract_all(any_value(content), '{TOKEN_PATTERN}')) AS tokens FROM chunks GROUP BY chunk_id),
    r AS (SELECT query_id, chunk_id, rank, file_path, start_line, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running_tokens FROM a JOIN c USING (chunk_id)), b AS (SELECT * FROM r WHERE running_tokens <= 2000)"""
_CITED = r"""WITH x AS (SELECT DISTINCT id, response_text FROM query_logs WHERE response_text IS NOT NULL), m AS (SELECT id, unnest(regexp_extract_all(response_text, '\[[^\[\]\s:]+:\d+[-–]\d+\]')) AS c, generate_subscripts(regexp_extract_all(response_text, '\[[^\[\]\s:]+:\d+[-–]\d+\]'), 1) AS number FROM x),
    cited AS (SELECT DISTINCT id, CAST(number AS INTEGER) AS number, regexp_extract(c, '\[([^\[\]\s:]+):', 1) AS file_path, CAST(regexp_extract(c, ':(\d+)[-–]', 1) AS INTEGER) AS start_line, CAST(regexp_extract(c, '[-–](\d+)\]$', 1) AS INTEGER) AS end_line FROM m)"""
_CITE = r"\[([^\[\]\s:]+):(\d+)[-–](\d+)\]"
#: Claims of each answer: code blocks dropped, cut after sentences and lines, without those that are nothing but a citation.
_CLAIMS = rf"""p AS (SELECT id, response_text, regexp_replace(response_text, '(?s)```.*?```', ' ', 'g') AS plain FROM {_LOGS} WHERE response_text IS NOT NULL),
    b AS (SELECT id, response_text, regexp_replace(regexp_replace(plain, '([.!?])\s+([^\s\[])', '\1' || chr(10) || '\2', 'g'), '(\d\])\s+(\p{{Lu}})', '\1' || chr(10) || '\2', 'g') AS broken FROM p),
    u AS (SELECT id, response_text, unnest(string_split_regex(broken, '\n+')) AS claim FROM b),
    q AS (SELECT id, response_text, CASE WHEN regexp_matches(claim, '\w') AND NOT regexp_matches(regexp_replace(claim, '{_CITE}', '', 'g'), '^\W*$') THEN claim END AS claim FROM u)"""
_METRICS = f"""
    v AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, vec_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, vec_id) AS back FROM ({S._vector_sql('true')}) WHERE query_id <> vec_id),
    g AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY ALL)"""


def _metric_sql(rank: str) -> str:
    return f"""(SELECT query_id, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
        FROM n LEFT JOIN (SELECT query_id, count(*) AS hits, min({rank}) AS first, sum(1 / log2({rank} + 1)) AS dcg FROM v JOIN g USING (query_id, vec_id) WHERE {rank} <= 10 GROUP BY ALL) USING (query_id))"""


SQL = {
    "classify_query": f"SELECT DISTINCT id, {_TYPE} AS query_type, CASE {_STRUCT}::INT + {_m(P.EXPLORE)}::INT + {_m(P.LOOKUP)}::INT WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM query_logs",
    "route_query": f"SELECT DISTINCT id, CASE WHEN {_STRUCT} AND {_m(P.EXPLORE)} THEN 'hybrid' WHEN {_STRUCT} THEN 'graph' WHEN {_m(P.IDENTIFIER)} THEN 'bm25' WHEN length(trim(query_text)) > 0 THEN 'vector' ELSE 'hybrid' END AS strategy FROM query_logs",
    "decompose": f"{_KINDS} SELECT * FROM {_STEPS}",
    "topo_levels": f"{_KINDS} SELECT id, step, CAST(CASE context_from WHEN '' THEN 0 WHEN '1' THEN 1 ELSE 2 END AS INTEGER) AS level FROM {_STEPS}",
    "synthesize_dedupe": f"WITH a AS ({S.SQL['bm25_code']}), b AS ({S.SQL['bm25_boosted']}) SELECT query_id, chunk_id, max(score) AS score, array_to_string(list_sort(list_distinct(list(step))), ',') AS steps FROM (SELECT query_id, chunk_id, score, 1 AS step FROM a UNION ALL SELECT query_id, chunk_id, score, 2 FROM b) GROUP BY ALL",
    "context_truncate": f"{_CONTEXT} SELECT query_id, chunk_id, rank, running_tokens FROM b",
    "context_order": f"{_CONTEXT} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY file_path, start_line, chunk_id) AS position FROM b",
    # the span that reaches farthest so far, as one number: its end, then its start
    "overlap_merge": """WITH s AS (SELECT DISTINCT repo_id, file_path, start_line, end_line FROM chunks WHERE chunk_kind = 'definition'), l AS (SELECT *, max(end_line::BIGINT * 100000000 + start_line) OVER (PARTITION BY repo_id, file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
        f AS (SELECT *, CASE WHEN least(end_line, far // 100000000) - greatest(start_line, far % 100000000) + 1 > 0.5 * (least(end_line - start_line, far // 100000000 - far % 100000000) + 1) THEN 0 ELSE 1 END AS fresh FROM l), i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY repo_id, file_path ORDER BY start_line, end_line) AS BIGINT) AS island FROM f)
        SELECT repo_id, file_path, island, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS spans FROM i GROUP BY ALL""",
    "citation_extract": f"{_CITED} SELECT * FROM cited",
    "citation_validate": f"""{_CITED}, o AS (SELECT DISTINCT id, repository_id FROM query_logs), k AS (SELECT DISTINCT repo_id, chunk_id, file_path, start_line, end_line, content FROM chunks),
        h AS (SELECT x.*, k.chunk_id, k.content, k.start_line AS from_line, row_number() OVER (PARTITION BY x.id, x.number, x.file_path, x.start_line, x.end_line ORDER BY k.end_line - k.start_line, k.start_line, k.chunk_id) AS n FROM cited x JOIN o USING (id) JOIN k ON k.file_path = x.file_path AND (o.repository_id IS NULL OR o.repository_id = k.repo_id) AND k.start_line <= x.start_line AND x.end_line <= k.end_line)
        SELECT x.id, x.number, x.file_path, x.start_line, x.end_line, h.chunk_id IS NOT NULL AS valid, h.chunk_id, CASE WHEN h.chunk_id IS NOT NULL THEN sha256(array_to_string(list_slice(string_split(h.content, chr(10)), h.start_line - h.from_line + 1, h.end_line - h.from_line + 1), chr(10))) END AS snippet
        FROM cited x LEFT JOIN h ON h.n = 1 AND h.id = x.id AND h.number = x.number AND h.file_path = x.file_path AND h.start_line = x.start_line AND h.end_line = x.end_line""",
    "citation_coverage": f"""WITH {_CLAIMS}, c AS (SELECT id, response_text, count(claim) AS n, count(*) FILTER (regexp_matches(claim, '{_CITE}')) AS cited FROM q GROUP BY ALL) SELECT DISTINCT id, CASE WHEN n > 0 THEN round(cited / n, 6) END AS coverage FROM c""",
    "claim_faithfulness": f"""WITH logs AS (SELECT id, max(query_text) AS query_text, max(response_text) AS response_text FROM query_logs GROUP BY ALL), {_CLAIMS.replace(_LOGS, 'logs')}, t AS (SELECT q.id, claim, list_distinct({S._terms("regexp_replace(claim, '" + _CITE + "', ' ', 'g')")}) AS c, list_distinct({S._terms('query_text')}) AS k FROM q JOIN logs USING (id)),
        j AS (SELECT id, count(claim) AS claims, count(*) FILTER (claim IS NOT NULL AND CASE WHEN len(c) > 0 THEN round(len(list_intersect(c, k)) / len(c), 6) ELSE 0 END >= 0.6) AS supported FROM t GROUP BY ALL)
        SELECT l.id, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, CASE WHEN claims > 0 THEN round(supported / claims, 6) END AS faithfulness, CASE WHEN claims > 0 THEN round(1 - round(supported / claims, 6), 6) END AS hallucination FROM logs l LEFT JOIN j USING (id)""",
    "context_assemble": f"""{_CONTEXT}, w AS (SELECT b.query_id, b.chunk_id, b.file_path, b.start_line, c.end_line, '### ' || b.file_path || ':' || b.start_line || '-' || c.end_line || chr(10) || '```' || coalesce(c.language, '') || chr(10) || c.content || chr(10) || '```' AS block FROM b JOIN (SELECT chunk_id, any_value(end_line) AS end_line, any_value(language) AS language, any_value(content) AS content FROM chunks GROUP BY chunk_id) c USING (chunk_id)),
        g AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY file_path, start_line, chunk_id) AS context FROM w GROUP BY ALL),
        y AS (SELECT g.query_id, context, 'You answer questions about a code base from the context alone.' || chr(10) || chr(10) || CASE {_TYPE} WHEN 'simple-lookup' THEN 'Answer in one or two sentences.' WHEN 'exploratory' THEN 'Explain step by step.' ELSE 'Trace the chain of calls and imports.' END || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query_text || chr(10) || chr(10) || 'Cite as [file:start-end].' AS prompt FROM g JOIN {S._ASKED} USING (query_id)),
        zz AS (SELECT query_id, CAST(len(regexp_extract_all(prompt, '{TOKEN_PATTERN}')) AS BIGINT) AS prompt_tokens, regexp_extract(context, '### ([^\\s:]+:\\d+-\\d+)', 1) AS place FROM y)
        SELECT query_id, prompt_tokens, prompt_tokens <= 4000 AS fits, CASE WHEN place <> '' THEN 'See [' || place || '].' ELSE 'No context was found.' END AS answer FROM zz""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM {_metric_sql('rank')}",
    "metric_summary": f"WITH {_METRICS} SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev({c}), 0), 6) AS {c}_std" for c in ("recall", "precision", "reciprocal_rank", "ndcg")) + f" FROM {_metric_sql('rank')}",
    "strategy_compare": f"WITH {_METRICS}, u AS (SELECT 'vector' AS strategy, ndcg FROM {_metric_sql('rank')} UNION ALL SELECT 'reversed', ndcg FROM {_metric_sql('back')}), a AS (SELECT strategy, avg(ndcg) AS mean FROM u GROUP BY ALL) SELECT strategy, round(mean, 6) AS mean, round(mean - (SELECT mean FROM a WHERE strategy = 'vector'), 6) AS delta FROM a",
    "strategy_ways": f"""WITH {S._CODE}, {S._NAMED}, a AS ({S._top_sql('s', 'query_id', 'chunk_id')}), bn AS ({S._top_sql('ns', 'query_id', 'chunk_id')}),
        gold AS (SELECT DISTINCT l.id AS query_id, c.chunk_id FROM query_logs l JOIN chunks c ON c.repo_id = l.repository_id WHERE l.id % 20 = 0),
        names AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, unnest(regexp_extract_all(query_text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM {S._ASKED}) JOIN (SELECT chunk_id, list_extract(string_split(qualified_name, '.'), -1) AS name FROM {S._CHUNKS} WHERE qualified_name IS NOT NULL) USING (name)),
        t AS (SELECT query_id, chunk_id, score * CASE WHEN (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM names) THEN 2.0 ELSE 1.0 END AS score FROM s), bo AS ({S._top_sql('t', 'query_id', 'chunk_id')}),
        fs AS (SELECT query_id, chunk_id, sum(1 / (60.0::DOUBLE + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM a UNION ALL SELECT query_id, chunk_id, rank FROM bn) GROUP BY ALL), fu AS ({S._top_sql('fs', 'query_id', 'chunk_id', 20, 'round(score, 9)')}),
        z AS (SELECT 'content' AS strategy, query_id, chunk_id, rank FROM a UNION ALL SELECT 'name', query_id, chunk_id, rank FROM bn UNION ALL SELECT 'boosted', query_id, chunk_id, rank FROM bo UNION ALL SELECT 'fused', query_id, chunk_id, rank FROM fu),
        gn AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL), gd AS (SELECT strategy, query_id, sum(1 / log2(rank + 1)) AS dcg FROM z JOIN gold USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY ALL),
        gm AS (SELECT w.strategy, gn.query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM gn CROSS JOIN (SELECT unnest(['content', 'name', 'boosted', 'fused']) AS strategy) w LEFT JOIN gd ON gd.strategy = w.strategy AND gd.query_id = gn.query_id),
        v AS (SELECT strategy, avg(ndcg) AS mean FROM gm GROUP BY ALL) SELECT strategy, round(mean, 6) AS mean, round(mean - (SELECT mean FROM v WHERE strategy = 'content'), 6) AS delta FROM v""",
    "answer_faithfulness": f"""WITH t AS (SELECT id, {S._terms('query_text')} AS q, {S._terms('response_text')} AS r, coalesce(len(regexp_extract_all(response_text, '{TOKEN_PATTERN}')), 0) AS tokens, coalesce(length(trim(response_text, ' ')) > 0, false) AS present FROM {_LOGS} WHERE query_text IS NOT NULL),
        s AS (SELECT id, tokens, present, CASE WHEN len(q) > 0 THEN round(len(list_intersect(list_distinct(q), list_distinct(r))) / len(list_distinct(q)), 6) ELSE 0.0 END AS relevance FROM t)
        SELECT DISTINCT id, relevance, CASE WHEN tokens > 400 THEN 'overflow' WHEN NOT present THEN 'retrieval' WHEN relevance < 0.5 THEN 'generation' ELSE 'success' END AS class FROM s""",
    "latency_percentiles": "SELECT event_type, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL",
    "rate_limit": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1",
    "cascade_delete": """WITH g AS (SELECT id FROM users WHERE id % 20 = 0), l AS (SELECT id FROM repositories WHERE owner_id IN (SELECT id FROM g)) SELECT 'users' AS name, count(*) AS rows FROM users WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'repositories', count(*) FROM repositories WHERE owner_id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'ingestion_jobs', count(*) FROM ingestion_jobs WHERE repository_id NOT IN (SELECT id FROM l) UNION ALL SELECT 'query_logs', count(*) FROM query_logs WHERE user_id NOT IN (SELECT id FROM g) AND (repository_id IS NULL OR repository_id NOT IN (SELECT id FROM l))""",
    "unique_violations": "SELECT lower(username) AS value, count(DISTINCT id) AS rows, 'username' AS field FROM users GROUP BY ALL HAVING count(DISTINCT id) > 1 UNION ALL SELECT lower(email), count(DISTINCT id), 'email' FROM users GROUP BY ALL HAVING count(DISTINCT id) > 1",
    "enum_check": "SELECT DISTINCT id, status AS value, 'ingestion_jobs' AS name FROM ingestion_jobs WHERE status IS NULL OR status NOT IN ('pending', 'in_progress', 'completed', 'failed') UNION ALL SELECT DISTINCT id, status, 'repositories' FROM repositories WHERE status IS NULL OR status NOT IN ('queued', 'cloning', 'processing', 'ready', 'failed')",
    "orphan_check": "SELECT count(*) AS rows, 'ingestion_jobs' AS name FROM ingestion_jobs WHERE repository_id IS NOT NULL AND repository_id NOT IN (SELECT id FROM repositories) UNION ALL SELECT count(*), 'query_logs' FROM query_logs WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)",
    "current_jobs": "SELECT id, repository_id, lower(status) AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC, created_at DESC, lower(status) DESC) AS n FROM ingestion_jobs) WHERE n = 1",
    "latest_status": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC, created_at DESC, lower(status) DESC) AS n FROM ingestion_jobs) WHERE n = 1), j AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS k FROM c)
        SELECT r.id AS repository_id, r.name, lower(r.status) AS repository_status, j.id AS job_id, lower(j.status) AS status FROM repositories r LEFT JOIN j ON j.repository_id = r.id AND j.k = 1""",
    "repository_urls": r"SELECT id, regexp_replace(lower(trim(url)), '(\.git)?/*$', '') AS url FROM repositories",
}
