"""Context assembly, prompts, citations: ordering, merging and cutting of spans, and checks of what an answer cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import token_count

CITATION = r"\[([^\[\]\s:]+):(\d+)[-–](\d+)\]"
OVERLAP = 0.5


def islands(spans: DataFrame, partition: list[str], start: str = "start_line", end: str = "end_line", share: float = OVERLAP) -> DataFrame:
    """``spans`` with the number of their island: a span joins the one that has reached farthest so far if they overlap by more than ``share`` of the shorter.

    Gaps and islands over spans ordered by start, then end, against the running maximum of ends: one window, no self-join.
    """
    w = Window.partitionBy(*partition).orderBy(start, end)
    far = F.max(F.struct(F.col(end).alias("e"), F.col(start).alias("s"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = spans.withColumn("far", far)
    overlap = F.least(F.col(end), F.col("far.e")) - F.greatest(F.col(start), F.col("far.s")) + 1
    shorter = F.least(F.col(end) - F.col(start), F.col("far.e") - F.col("far.s")) + 1
    return held.withColumn("fresh", F.when(overlap > share * shorter, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w)).drop("far", "fresh")


def merged_spans(spans: DataFrame, partition: list[str], start: str = "start_line", end: str = "end_line", share: float = OVERLAP) -> DataFrame:
    """(partition, island, start, end, spans): islands as one span each."""
    return islands(spans, partition, start, end, share).groupBy(*partition, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("spans"))


def within_budget(ranked: DataFrame, query_key: str, tokens: str, budget: int) -> DataFrame:
    """The best-ranked prefix of each query's rows whose tokens fit the budget, with the running total."""
    w = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("running_tokens", F.sum(tokens).over(w)).where(F.col("running_tokens") <= budget)


def formatted(content: Column, path: Column, start: Column, end: Column, language: Column) -> Column:
    """A chunk as a headed code block."""
    return F.concat(F.lit("### "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), content, F.lit("\n```"))


def assembled(chosen: DataFrame, query_key: str) -> DataFrame:
    """(query_key, context): the chosen chunks by file and line as one text; bounded by the token budget they passed."""
    block = formatted(F.col("content"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("language"))
    ordered = F.array_sort(F.collect_list(F.struct("file_path", "start_line", "chunk_id", block.alias("block"))))
    return chosen.groupBy(query_key).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column, kind: Column, prior: Column | None = None) -> Column:
    """System text by query type, context, earlier answers, question and citation format."""
    system = F.when(kind == "simple-lookup", "Answer in one or two sentences.").when(kind == "exploratory", "Explain step by step.").otherwise("Trace the chain of calls and imports.")
    return F.concat_ws("\n\n", F.lit("You answer questions about a code base from the context alone."), system, F.concat(F.lit("Context:\n"), context), *([] if prior is None else [prior]), F.concat(F.lit("Question: "), question), F.lit("Cite as [file:start-end]."))


def prompt_fits(text: Column, limit: int) -> Column:
    return token_count(text) <= limit


def extractive_answer(question: Column, context: Column) -> Column:
    """The default generator: the context's first heading as a citation, so that the pipeline runs without a model."""
    cited = F.regexp_extract(context, r"### ([^\s:]+:\d+-\d+)", 1)
    return F.when(cited != "", F.concat(F.lit("See ["), cited, F.lit("]."))).otherwise(F.lit("No context was found."))


def citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, file_path, start_line, end_line) of every citation in an answer, in order."""
    t = F.col(text)
    groups = [F.regexp_extract_all(t, F.lit(CITATION), F.lit(g)) for g in (1, 2, 3)]
    each = answers.where(t.isNotNull()).select(key, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "fse")])).alias("number", "c"))
    return each.select(key, (F.col("number") + 1).alias("number"), F.col("c.f").alias("file_path"), F.expr("try_cast(c.s as int)").alias("start_line"), F.expr("try_cast(c.e as int)").alias("end_line"))


def validated(cited: DataFrame, spans: DataFrame, key: str, repository: str | None = None) -> DataFrame:
    """Citations with whether a known span holds their lines, the narrowest such span (chunk_id), and the cited lines of its content.

    ``spans`` has repo_id, chunk_id, file_path, start_line, end_line and content.  With ``repository``, a column of ``cited``, only
    spans of that repository count; where it is null, those of any.  Equality joins on repository and file, lines as a residual; contents are joined last, by
    chunk_id, for valid citations alone.
    """
    fields = [key, "number", "file_path", "start_line", "end_line"]
    known = spans.select("repo_id", "chunk_id", "file_path", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line")).distinct()
    inside = (F.col("from_line") <= F.col("start_line")) & (F.col("end_line") <= F.col("to_line"))
    best = F.min(F.struct((F.col("to_line") - F.col("from_line")).alias("width"), F.col("from_line"), F.col("chunk_id")))
    if repository is None:
        parts = [(cited, ["file_path"])]
    else:
        parts = [(cited.where(F.col(repository).isNotNull()).withColumn("repo_id", F.col(repository)), ["repo_id", "file_path"]), (cited.where(F.col(repository).isNull()), ["file_path"])]
    held = [c.join(known, on).where(inside).select(*fields, "from_line", "to_line", "chunk_id") for c, on in parts]
    found = (held[0] if len(held) == 1 else held[0].unionByName(held[1])).groupBy(*fields).agg(best.alias("b"))
    text = spans.select("chunk_id", "content").where("chunk_id is not null").dropDuplicates(["chunk_id"])
    # the line numbers of a content begin with the span's; a module's content may have lost blank lines
    lines = F.slice(F.split("content", "\n"), F.col("start_line") - F.col("from_line") + 1, F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    shown = found.select(*fields, F.col("b.chunk_id").alias("chunk_id"), F.col("b.from_line").alias("from_line")).join(text, "chunk_id", "left").select(*fields, "chunk_id", F.array_join(lines, "\n").alias("snippet"))
    return cited.select(*fields).distinct().join(shown, fields, "left").withColumn("valid", F.col("chunk_id").isNotNull())


def claims(text: Column) -> Column:
    """Sentences of an answer outside code; a citation after the full stop belongs to its sentence."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " ")
    parts = F.split(plain, r"(?<=[.!?])\s+(?!\[)|(?<=\d\])\s+(?=\p{Lu})|\n+")
    return F.filter(parts, lambda s: s.rlike(r"\w") & ~F.regexp_replace(s, CITATION, "").rlike(r"^\W*$"))


def coverage(text: Column) -> Column:
    """Share of an answer's claims that carry a citation; null where it makes none."""
    all_claims = claims(text)
    cited = F.filter(all_claims, lambda s: s.rlike(CITATION))
    return F.when(F.size(all_claims) > 0, F.round(F.size(cited) / F.size(all_claims), 6))
