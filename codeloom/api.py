"""The two entry points: ``ingest`` makes the relations of a tree of sources, ``ask`` answers questions over them.

Feature flags decide at planning time which parts are in a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.config import Settings
from codeloom.functions.text import code_tokens, token_count
from codeloom.operators import context as C
from codeloom.operators import graph as G
from codeloom.operators import planning as P
from codeloom.operators import pysource
from codeloom.operators import retrieval as R
from codeloom.session import written

#: Chunks of an earlier step whose definitions a later step starts from.
PASSED_ON = 3
_STEPS = 16  # steps that a question has at most


def ingest(files: DataFrame, settings: Settings | None = None, model: Callable | None = None) -> dict[str, DataFrame]:
    """symbols, chunks (with chunk_id), calls, edges, nodes, postings, vectors and rejects of a files relation; sources are parsed once.

    ``model`` embeds lists of words; without one they are hashed.
    """
    settings = settings or Settings()
    parsed = written(pysource.parse_files(files, max_tokens=settings.chunk_max_tokens), "parsed")
    symbols, calls = pysource.symbols(parsed), pysource.calls(parsed)
    key = F.xxhash64("file_id", "ord")
    chunks = pysource.chunks(parsed).withColumn("chunk_id", key).withColumn("language", F.lit("python"))
    out = {"symbols": symbols, "chunks": chunks, "calls": calls, "postings": R.index_tables(chunks, "chunk_id", "content"), "vectors": R.embed(chunks, "chunk_id", code_tokens("content"), model, keep=("repo_id",)), "rejects": pysource.rejects(files)}
    if settings.enable_graph:
        out |= {"edges": written(G.graph_edges(symbols, calls), "edges"), "nodes": G.graph_nodes(symbols)}
    return out


def _graph_results(steps: DataFrame, tables: dict[str, DataFrame], before: DataFrame | None) -> DataFrame:
    """(step_id, chunk_id, score): chunks of the definitions that a step names, or that earlier steps found, and of their neighbours by any edge."""
    chunks = tables["chunks"].where("qualified_name is not null").select("chunk_id", "repo_id", "file_path", "qualified_name")
    words = steps.select("step_id", F.col("repo_id").alias("asked"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][\w.]*"), F.lit(0)))).alias("word"))
    # a name is a whole qualified name or its last part, within the repository
    by_name = chunks.withColumn("word", F.explode(F.array_distinct(F.array("qualified_name", F.element_at(F.split("qualified_name", r"\."), -1)))))
    own = words.where("asked is not null").withColumnRenamed("asked", "repo_id").join(by_name, ["repo_id", "word"])
    free = words.where("asked is null").join(by_name, "word")
    seeds = own.select("step_id", "repo_id", "file_path", "qualified_name").unionByName(free.select("step_id", "repo_id", "file_path", "qualified_name"))
    if before is not None:
        seeds = seeds.unionByName(before.join(chunks, "chunk_id").select("step_id", "repo_id", "file_path", "qualified_name"))
    seeds = seeds.distinct()
    edges = tables["edges"].where("kind <> 'IMPORTS'")
    ends = edges.select("repo_id", F.col("src_file").alias("file_path"), F.col("src").alias("qualified_name"), F.col("dst_file").alias("far_file"), F.col("dst").alias("far"))
    ends = ends.unionByName(edges.select("repo_id", F.col("dst_file").alias("file_path"), F.col("dst").alias("qualified_name"), F.col("src_file").alias("far_file"), F.col("src").alias("far"))).where("far_file is not null")
    near = seeds.join(ends, ["repo_id", "file_path", "qualified_name"]).select("step_id", "repo_id", F.col("far_file").alias("file_path"), F.col("far").alias("qualified_name"), F.lit(0.5).alias("score"))
    reached = seeds.withColumn("score", F.lit(1.0)).unionByName(near).groupBy("step_id", "repo_id", "file_path", "qualified_name").agg(F.max("score").alias("score"))
    return reached.join(chunks, ["repo_id", "file_path", "qualified_name"]).groupBy("step_id", "chunk_id").agg(F.max("score").alias("score"))


def retrieve(steps: DataFrame, tables: dict[str, DataFrame], settings: Settings, before: DataFrame | None = None, model: Callable | None = None) -> DataFrame:
    """(step_id, chunk_id, score, rank) of steps (step_id, text, repo_id), each by the strategy that its wording asks for; lists are fused.

    ``before`` (step_id, chunk_id) is what the steps that a step depends on found.
    """
    graph = settings.enable_graph and "edges" in tables
    routed = written(steps.withColumn("strategy", P.strategy(F.col("text"))), "routed")
    ways = {w: routed.where(F.col("strategy").isin(w, "hybrid") if w != "bm25" or graph else F.col("strategy").isin("bm25", "hybrid", "graph")) for w in ("bm25", "vector", "graph")}
    lists = R.bm25_top(tables["chunks"], ways["bm25"], "chunk_id", "content", "step_id", "text", settings.bm25_top_k, group="repo_id").select("step_id", "chunk_id", "rank")
    asked = R.embed(ways["vector"], "step_id", code_tokens("text"), model)
    vectors = tables["vectors"]
    if "repo_id" not in vectors.columns:  # of another maker than ``ingest``
        vectors = vectors.join(tables["chunks"].select("chunk_id", "repo_id"), "chunk_id")
    # the nearest of every repository are ranked where a question names none, else those of its own
    near = R.vector_search_within(vectors, asked.join(routed.select("step_id", "repo_id"), "step_id"), "chunk_id", "embedding", "step_id", "repo_id", settings.vector_top_k)
    lists = lists.unionByName(near.where("score > 0").select("step_id", "chunk_id", "rank"))
    if graph:
        found = _graph_results(ways["graph"], tables, None if before is None else before.join(ways["graph"].select("step_id"), "step_id", "left_semi"))
        lists = lists.unionByName(R.top(found, "step_id", "chunk_id", settings.bm25_top_k).select("step_id", "chunk_id", "rank"))
    return R.top(R.fuse(lists, "step_id", "chunk_id", settings.rrf_k), "step_id", "chunk_id", settings.vector_top_k)


def found_chunks(questions: DataFrame, tables: dict[str, DataFrame], settings: Settings | None = None, model: Callable | None = None) -> DataFrame:
    """(query_id, chunk_id, score, steps) over all steps of each question, executed in the order of their dependencies.

    A level of steps is one plan for all questions; a later level starts from what the steps before it found.
    """
    settings = settings or Settings()
    asked = questions.select("query_id", "query_text", F.col("repo_id") if "repo_id" in questions.columns else F.lit(None).cast("int").alias("repo_id"))
    if settings.enable_planner:
        steps = P.plan_steps(asked, "query_id", "query_text")
    else:
        steps = asked.where(F.length(F.trim("query_text")) > 0).select("query_id", F.lit(1).alias("step"), F.col("query_text").alias("text"), F.lit("chunks").alias("expected"), F.array().cast("array<int>").alias("context_from"))
    steps = written(steps.join(asked.select("query_id", "repo_id"), "query_id").withColumn("step_id", F.col("query_id").cast("bigint") * _STEPS + F.col("step")), "steps")
    level = written(P.levels(steps, "query_id"), "levels")
    depth = level.agg(F.max("level")).first()[0]
    done: DataFrame | None = None
    for d in range((depth if depth is not None else -1) + 1):  # as many rounds as the longest chain of steps has
        now = steps.join(level.where(F.col("level") == d), ["query_id", "step"], "left_semi")
        before = None
        if done is not None:
            needs = now.select("step_id", "query_id", F.explode("context_from").alias("step"))
            before = needs.join(done.where(F.col("rank") <= PASSED_ON), ["query_id", "step"]).select("step_id", "chunk_id").distinct()
        found = retrieve(now.select("step_id", "text", "repo_id"), tables, settings, before, model)
        found = written(found.join(now.select("step_id", "query_id", "step"), "step_id").select("query_id", "step", "chunk_id", "score", "rank"), "found")
        done = found if done is None else done.unionByName(found)
    if done is None:
        return questions.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, score double, steps array<int>")
    return P.synthesise(done, "query_id", "chunk_id")


def ask(questions: DataFrame, tables: dict[str, DataFrame], settings: Settings | None = None, budget: int = 2000, generator: Callable[[Column, Column], Column] = C.extractive_answer, model: Callable | None = None, scorer: Callable[[Column, Column], Column] = R.overlap_score) -> DataFrame:
    """(query_id, query_text, query_type, strategy, chunks, context, prompt, answer, citations, valid_citations) of each question.

    ``questions`` has query_id (an integer), query_text and, if they are about one repository each, repo_id.  Steps are routed to the graph, BM25 and vectors,
    executed in order, synthesised, reranked, merged where they overlap, cut to the budget and assembled; the answer's citations are
    checked against its own context.  ``generator`` answers from (question, prompt); ``model`` embeds and ``scorer`` reranks.
    """
    settings = settings or Settings()
    chunks = tables["chunks"]
    found = found_chunks(questions, tables, settings, model)
    asked = questions.select("query_id", "query_text")
    rows = R.top(found, "query_id", "chunk_id", settings.vector_top_k).select("query_id", "chunk_id", "rank")
    rows = rows.join(chunks.select("chunk_id", "repo_id", "content", "file_path", "start_line", "end_line", "language"), "chunk_id").join(asked, "query_id")
    if settings.enable_reranker:
        best = R.rerank(rows, "query_id", "chunk_id", "query_text", "content", settings.rerank_top_k, scorer).select("query_id", "chunk_id", F.col("rank").alias("new_rank"))
        rows = rows.join(best, ["query_id", "chunk_id"]).drop("rank").withColumnRenamed("new_rank", "rank")
    # of chunks that overlap by more than half (a class and its methods) the widest stands for all, at the best rank
    island = Window.partitionBy("query_id", "repo_id", "file_path", "island")
    rows = C.islands(rows, ["query_id", "repo_id", "file_path"]).withColumn("rank", F.min("rank").over(island))
    rows = rows.withColumn("width", F.row_number().over(island.orderBy(F.desc(F.col("end_line") - F.col("start_line")), "chunk_id"))).where("width = 1").drop("width", "island")
    chosen = written(C.within_budget(rows.withColumn("tokens", token_count("content")), "query_id", "tokens", budget), "context")
    joined = asked.join(C.assembled(chosen, "query_id"), "query_id", "left").join(chosen.groupBy("query_id").agg(F.count("*").alias("chunks")), "query_id", "left").fillna("", ["context"]).fillna(0, ["chunks"])
    text = F.col("query_text")
    kind = P.query_type(text) if settings.enable_planner else F.lit("simple-lookup")
    answered = joined.select("query_id", "query_text", kind.alias("query_type"), P.strategy(text).alias("strategy"), "chunks", "context", C.prompt(text, F.col("context"), kind).alias("prompt"))
    answered = written(answered.withColumn("answer", generator(text, F.col("prompt"))), "answers")
    held = chosen.select("query_id", "chunk_id", "repo_id", "file_path", "start_line", "end_line", "content")
    # an answer may only cite its own context: the question is part of the place
    place = F.concat_ws("\x01", F.col("query_id").cast("string"), F.col("file_path"))
    cited = C.citations(answered, "query_id", "answer").withColumn("file_path", place)
    checked = C.validated(cited, held.withColumn("file_path", place), "query_id").groupBy("query_id").agg(F.count("*").alias("citations"), F.count_if("valid").alias("valid_citations"))
    return answered.join(checked, "query_id", "left").fillna(0, ["citations", "valid_citations"])
