"""Oversized texts cut into pieces under a token limit, at natural boundaries, with overlaps (problem 2).

Method: pointer doubling.  Every token of a text is a node at which a piece may begin.  One
vectorised search joins each node to its farthest legal successor (the budget less the overlap that
a piece beginning there carries), preferring statement starts, then line starts, then any token.
Squaring that successor table log2(n) times marks all cuts of the greedy split at once.

Each text is one row's own work, so the operator adds no shuffle; any number of rows stream
through ``mapInArrow`` in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.functions.tokens import code_points, column_token_counts, token_ends, token_starts
from codeloom.llm.doc_pairs import language_of

MAX_TOKENS = 512
TAIL_TOKENS = 32

_QUOTED = r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?'
_SCAN = {
    "python": re.compile(_QUOTED + r"|\#[^\n]*|\\\n|[()\[\]{}]"),
    "": re.compile(_QUOTED + r"|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|[()\[\]{}]"),
}


def statement_lines(text: str, language: str | None) -> list[int]:
    """Offsets of the lines that begin a statement: outside quotes and round or square brackets.

    Braces count as brackets in Python only; elsewhere they hold statements.
    """
    python = (language or "").lower() in ("python", "")
    opens, closes = ("([{", ")]}") if python else ("([", ")]")
    covered: list[tuple[int, int]] = []
    depth, since = 0, 0
    for m in _SCAN["python" if python else ""].finditer(text):
        s = m[0]
        if s in opens:
            if not depth:
                since = m.start()
            depth += 1
        elif s in closes:
            depth = max(0, depth - 1)
            if not depth:
                covered.append((since, m.start()))
        elif len(s) > 1 and "\n" in s and not depth:
            covered.append((m.start(), m.end() - 1))
    if depth:
        covered.append((since, len(text)))
    starts, k = [], 0
    for m in re.finditer(r"^(?=[^\n]*\S)", text, re.M):
        at = m.start()
        while k < len(covered) and covered[k][1] < at:
            k += 1
        if not (k < len(covered) and covered[k][0] < at):
            starts.append(at)
    return starts


def cut_points(text: str, language: str | None = None, header_tokens: int = 0, limit: int = MAX_TOKENS, tail: int = TAIL_TOKENS) -> tuple[list[int], list[int], list[int]]:
    """Greedy cuts of one text: token index and character offset where each piece begins, and token offsets.

    ``header_tokens`` is what a later piece spends on its header; 0 means that it repeats ``tail`` tokens.
    """
    points, _ = code_points([text])
    starts = token_starts(points)
    n = len(starts)
    if n <= limit:
        return [0], [0], starts.tolist()
    newlines = np.flatnonzero(points[:-1] == 10) + 1
    line_of = np.concatenate(([0], newlines))
    owner = np.searchsorted(line_of, starts, side="right") - 1
    lines = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))  # tokens that are first on their line
    where = starts.copy()
    where[lines] = line_of[owner[lines]]
    where[0] = 0
    natural = np.intersect1d(np.searchsorted(starts, np.asarray(statement_lines(text, language), np.int64)), lines)

    node = np.arange(n + 1)
    spent = np.full(n + 1, header_tokens) if header_tokens else np.minimum(tail, node)
    spent[0] = 0
    bound = np.minimum(node + limit - spent, n)

    def last(of: np.ndarray) -> np.ndarray:
        at = np.searchsorted(of, bound, side="right") - 1
        return np.where(at >= 0, of[np.maximum(at, 0)], -1) if len(of) else np.full(n + 1, -1)

    step = last(natural)
    by_line = last(lines)
    step = np.where(step > node, step, np.where(by_line > node, by_line, bound))
    step = np.where(bound >= n, n, step)
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    for _ in range(max(1, int(n).bit_length())):  # pointer doubling: after k squarings, 2**k steps from 0 are marked
        reached[step[reached]] = True
        step = step[step]
    cuts = np.flatnonzero(reached[:n])
    return cuts.tolist(), where[cuts].tolist(), starts.tolist()


def split_text(text: str, language: str | None = None, header: str | None = None, limit: int = MAX_TOKENS, tail: int = TAIL_TOKENS) -> list[tuple[int, int, str, int]]:
    """(start, end, overlap, tokens) of each piece; ``overlap + text[start:end]`` is the piece's content.

    A header of more than half the limit is not repeated; such texts repeat their tail instead.
    """
    spent = len(token_starts(code_points([header])[0])) if header and header.strip() else 0
    if spent * 2 > limit:
        spent = 0
    cuts, chars, starts = cut_points(text, language, spent, limit, tail)
    out = []
    for k, (token, at) in enumerate(zip(cuts, chars)):
        end = chars[k + 1] if k + 1 < len(cuts) else len(text)
        upto = cuts[k + 1] if k + 1 < len(cuts) else len(starts)
        overlap, extra = "", 0
        if k and spent:
            overlap, extra = header.rstrip() + "\n", spent
        elif k:
            extra = min(tail, token)
            overlap = text[starts[token - extra] : at]
        out.append((at, end, overlap, upto - token + extra))
    return out


PIECE_SCHEMA = "chunk_id bigint, piece int, pieces int, content string, token_count int, is_continuation boolean, overlap_chars int, start_char int, end_char int"


def split_oversized(chunks: DataFrame, limit: int = MAX_TOKENS, tail: int = TAIL_TOKENS) -> DataFrame:
    """Pieces of every chunk whose content has more than ``limit`` tokens, counted afresh.

    Input: chunk_id, content, language (a null one is told by the path), file_path, overlap_header; other columns are ignored.  Defined results: a null or
    empty content yields no row; a chunk within the limit yields none; a single line longer than the limit is
    cut between tokens; a row delivered twice yields its pieces once; a row
    without an id can't be referred to and is left out.
    ``substr(content, overlap_chars + 1)`` over the pieces in order gives back the chunk's content exactly.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            big = np.flatnonzero(column_token_counts(block.column("content")) > limit)
            if not len(big):
                continue
            rows = []
            for r in block.take(pa.array(big)).to_pylist():
                pieces = split_text(r["content"], language_of(r["language"], r["file_path"]), r["overlap_header"], limit, tail)
                for k, (a, b, overlap, tokens) in enumerate(pieces):
                    rows.append((r["chunk_id"], k + 1, len(pieces), overlap + r["content"][a:b], tokens, k > 0, len(overlap), a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()))],
                ["chunk_id", "piece", "pieces", "content", "token_count", "is_continuation", "overlap_chars", "start_char", "end_char"],
            )

    # a token has at least one character, so shorter texts can't exceed the limit: they never reach Python
    long = chunks.select("chunk_id", "content", "language", "file_path", "overlap_header").where(F.col("chunk_id").isNotNull() & (F.length("content") > limit))
    return long.mapInArrow(cut, PIECE_SCHEMA).dropDuplicates(["chunk_id", "piece"])


def oversized_ids(chunks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Ids of the chunks that ``split_oversized`` cuts, each once."""
    return split_oversized(chunks, limit).where("piece = 1").select("chunk_id")
