"""Source files that are not valid in their language (problem 4).

Method: parsing with derivatives, memoised.  A file's tokens are derived one after the other: an empty derivative marks the
failing token, a derivative at the end that doesn't contain the empty word marks truncation.  What Python's grammar here
doesn't know is settled by an exact check of the files that it rejects.

Row by row; the only shuffles make rows distinct and count.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.llm.doc_pairs import language_of
from codeloom.llm.grammars import grammar, python_kinds, script_kinds

LANGUAGES = ("python", "javascript", "typescript")
_MARKUP = re.compile(r"(?P<before>[(,=?:&|{}\[;>]|\breturn|=>|\bdefault|^)\s*<(?=[A-Za-z>])")
_TAG = re.compile(r"<(?P<name>[A-Za-z][\w.:-]*)?")
_ATTRIBUTE = re.compile(r"\s*(?:(?P<name>[A-Za-z_][\w:-]*)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<hole>\{)))?|(?P<spread>\{))")


def _hole(text: str, at: int) -> int:
    """The end (exclusive) of a braced hole, or -1."""
    from codeloom.llm.doc_pairs import balanced

    return balanced(text, at)


def _element(text: str, at: int, holes: list[str]) -> int:
    """The end of the JSX element that begins at ``at``, or -1; its embedded expressions go to ``holes``."""
    m = _TAG.match(text, at)
    name, pos = m["name"] or "", m.end()
    while True:
        end = re.compile(r"\s*(/?>)").match(text, pos)
        if end:
            pos = end.end()
            break
        a = _ATTRIBUTE.match(text, pos)
        if not a or not name:
            return -1
        pos = a.end()
        if a["hole"] or a["spread"]:
            close = _hole(text, pos - 1)
            if close < 0:
                return -1
            holes.append(text[pos : close - 1].replace("...", "", 1) if a["spread"] else text[pos : close - 1])
            pos = close
    if end[1] == "/>":
        return pos
    while pos < len(text):
        if text.startswith("</", pos):
            close = re.compile(r"</\s*" + re.escape(name) + r"\s*>").match(text, pos)
            return close.end() if close else -1
        if text[pos] == "<":
            pos = _element(text, pos, holes)
            if pos < 0:
                return -1
        elif text[pos] == "{":
            close = _hole(text, pos)
            if close < 0:
                return -1
            inner = text[pos + 1 : close - 1]
            if re.sub(r"/\*[\s\S]*?\*/", "", inner).strip():
                holes.append(inner)
            pos = close
        elif text[pos] in ">}":
            return -1
        else:
            pos += 1
    return -1


def without_markup(text: str) -> tuple[str, list[str]] | None:
    """The text with each outermost JSX element replaced by a name, and the expressions inside; None if one is broken."""
    out, holes, at = [], [], 0
    while (m := _MARKUP.search(text, at)) is not None:
        start = text.index("<", m.end("before"))
        end = _element(text, start, holes)
        if end < 0:
            return None
        out.append(text[at:start] + " JSX_ELEMENT ")
        at = end
    return ("".join(out) + text[at:], holes) if out else None


def _script_failure(text: str, language: str, markup: bool = True) -> tuple[int, str, bool] | None:
    """The failure of a text; a text that fails with markup is tried again without it.  Holes of markup and templates are texts of their own, however deep."""
    kinds, holes = script_kinds(text)
    found = grammar(language).failure(kinds)
    if found is not None:
        if markup and ("</" in text or "/>" in text):
            bare = without_markup(text)
            if bare is not None:
                inner = next((f for h in bare[1] if h.strip() and (f := _script_failure("(" + h + ")", language))), None)
                return inner or _script_failure(bare[0], language, False)
        return found[0], kinds[found[0]] if found[0] < len(kinds) else "end", found[1]
    for h in holes:
        if not h.strip():
            return 0, "TPL", False
        if bad := _script_failure("(" + h + ")", language):
            return bad
    return None


def failure(text: str, language: str) -> tuple[int, str, bool] | None:
    """None for a valid text; else the index and kind of the token that fails, and whether the text breaks off."""
    text = text.removeprefix("\ufeff")
    if language != "python":
        return _script_failure(text, language)
    if not text.strip():
        return None
    kinds = python_kinds(text)
    found = grammar("python").failure(kinds)
    if found is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return found[0], kinds[found[0]] if found[0] < len(kinds) else "end", found[1]


SCHEMA = "file_id bigint, repo_id int, language string, failing_token int, failing_kind string, truncated boolean"


def judged_files(files: DataFrame) -> DataFrame:
    """Every file of a known language with its failure; failing_token is null for valid files.

    The language is the given one, whatever its letter case, or that of the extension.  Files of other languages, with null
    content or without an id are left out; a file delivered twice comes out once.  Empty contents are valid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            rows = []
            for i, repo, path, language, content in zip(*(block.column(c).to_pylist() for c in ("file_id", "repo_id", "path", "language", "content"))):
                language = language_of(language, path)
                if language in LANGUAGES:
                    rows.append((i, repo, language, *(failure(content, language) or (None, None, None))))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file_id", "repo_id", "language", "failing_token", "failing_kind", "truncated"])

    kept = files.select("file_id", "repo_id", "path", "language", "content").where("file_id is not null and content is not null")
    return kept.mapInArrow(run, SCHEMA).dropDuplicates(["file_id"])


def invalid_files(files: DataFrame) -> DataFrame:
    """The files of ``judged_files`` that fail."""
    return judged_files(files).where("failing_token is not null")


def failure_rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, truncated, rate) for each repository and language."""
    bad = F.col("failing_token").isNotNull()
    grouped = judged_files(files).groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.count_if(bad).alias("invalid"), F.count_if(bad & F.col("truncated")).alias("truncated"))
    return grouped.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
