"""Source files that no one wrote by hand: tool output, minified or bundled scripts, third-party copies, data (problem 6).

Method: a Re-Pair grammar of every file's tokens decides first.

1. Rules that are reused again and again and cover most of a file mark tool output: bundles, minified scripts.
2. Literals that fill a file and whose own grammar hardly compresses them mark data saved as code.
3. Rules shared across repositories mark third-party copies: a file with many long rules that all occur in other repositories, or a file
   with a licence notice most of whose long rules do.

What a grammar can't tell from hand-written code (one more generated stub, one vendored module that reads like any other) is left to marks:
banners in the comment block at the head, vendoring folders, and lines longer than anyone types.  Marks are asked last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.functions.repair import Grammar
from codeloom.functions.tokens import WORD_RE, code_points, token_ends, token_hashes, token_starts

#: Uses a rule, share of tokens under rules, and tokens, from which a file counts as repetitive output.
REUSE, COVERED, REUSED_TOKENS = 4.8, 0.7, 120
#: Share of literal characters, characters, and size of the literals' own grammar from which a file is data.
LITERAL, LITERAL_CHARS, INCOMPRESSIBLE = 0.88, 400, 0.6
#: Tokens that a shared rule derives at least, repositories it occurs in, and the share of such rules beside a licence notice.
SHARED_TOKENS, SHARED_REPOSITORIES, SHARED_PART = 8, 2, 0.5
#: Long rules, all of them shared, from which a file is a third-party copy without any notice.
COPIED_RULES = 40
#: Uses a rule from which text in lines longer than anyone types is minified.
DENSE_REUSE = 3.0

# fixed values: folders of third-party code and of build output
VENDOR_FOLDER = re.compile(r"(?:^|/)(?:_?vendor|_?vendored|third[_-]?party|3rd[_-]?party|external|externals|deps|node_modules|bower_components|jspm_packages|site-packages|dist-packages|Pods|Godeps)/", re.I)
VERSIONED_FOLDER = re.compile(r"(?:^|/)[a-z][a-z0-9_]*(?:-[a-z][a-z0-9_]*)*[-@]v?\d+\.\d+(?:\.\d+)*(?:[-.]?(?:rc|beta|alpha)\d*)?/", re.I)
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.[jt]sx?|[._-](?:generated|autogen|gen)\.[jt]sx?|_(?:generated|autogen|gen)\.py)$", re.I)
MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|chunk|packed)\.[jt]sx?$|-[0-9a-f]{8,}\.[jt]sx?$", re.I)

# fixed values: banners, at the start of a comment line in the head of a file
GENERATED_BANNER = re.compile(
    r"^\W*(?:@generated\b|code generated by\b|auto-?(?:matically )?generated (?:by|from|file|code|with|on|using)|automatically (?:created|generated|written|produced)\b|autogenerated\b|auto-generated\b(?! banner)|<auto-?generated|generated (?:by|from|with|using|automatically|at|on)\b"
    r"|(?:this|the) (?:file|code|module|script) (?:was|is|has been) (?:auto-?|automatically |machine[- ])?(?:generated|written by|created by|produced by|emitted by|built by|compiled)(?! by hand)|do not (?:edit|modify)\b|don't edit\b|machine[- ]generated\b|source map|compiled (?:by|from|with)\b|produced by\b|regenerate with\b|built with\b|transpiled\b"
    r"|.{0,80}\b(?:do not edit|changes will be (?:lost|overwritten)|edits will be (?:lost|overwritten)|will be overwritten)\b)",
    re.I,
)
DENIES = re.compile(r"\bnot (?:auto-?)?(?:generated|copied|vendored)\b|\bhand[- ](?:tuned|written|made|edited|maintained)\b|\bby hand\b|\b(?:every|each|all) outputs?\b|\bstarts? with\b|\bemits?\b", re.I)
VENDOR_BANNER = re.compile(
    r"^\W*(?:(?:this (?:file|code|module) is )?(?:an? )?(?:verbatim |unmodified |exact |local |vendored |bundled )?cop(?:y|ied) (?:of|from)\b|taken (?:unchanged|verbatim|as is|unmodified|directly)?\s*from\b|vendored (?:from|copy)\b|borrowed (?:unchanged |verbatim )?from\b|imported (?:unchanged |verbatim )from\b|adapted verbatim\b|bundled with this project\b|bundled (?:copy|version)\b|.{0,60}\breport (?:problems|bugs|issues) to the \S+ (?:maintainers|authors|project)\b|upstream(?: authors| version|:| source)\b|originally (?:from|published)\b|from \S+ v?\d+\.\d+|source: https?://)",
    re.I,
)
VERSION_BANNER = re.compile(r"^(?:#|//|/\*!?|\*)\s*!?\s*@?(?:license\s+)?[a-z][\w.-]{2,40}(?:\.js)?\s+v?\d+\.\d+(?:\.\d+)*(?:[-+]\w+)?(?:\s*(?:\*/|[|(-].*))?\s*$", re.I)
LICENCE = re.compile(r"\b(?:copyright|\(c\) \d{4}|©|spdx-license|licen[cs]ed under|distributed under|permission (?:is hereby granted|to use)|all rights reserved|see the licen[cs]e|redistribution and use)\b", re.I)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|[\s,\[\](){}:]+")


def head(content: str) -> list[str]:
    """The comment lines at the head of a file, however many, without blank lines."""
    out = []
    block = ""
    for m in re.finditer(r"[^\n]+", content.lstrip("\ufeff")):
        s = m[0].strip()
        if not s or s.startswith("#!") or s in ("'use strict';", '"use strict";'):
            continue
        if block:
            out.append(s)
            block = "" if block in s else block
        elif s.startswith("/*"):
            out.append(s)
            block = "" if "*/" in s[2:] else "*/"
        elif s.startswith(("#", "//")):
            out.append(s)
        else:
            break
    return out


def dense(content: str) -> bool:
    """Lines far longer than anyone types, with hardly any white space, outside literals."""
    size = len(content)
    if size < 400:
        return False
    lines = content.split("\n")
    longest = max(lines, key=len)
    if len(longest) < 400 or len(longest) * 2 < size:
        return False
    bare = _LITERAL.sub(" ", longest)
    letters = len(bare.replace(" ", ""))
    return letters * 4 > len(longest) and sum(c.isspace() for c in longest) < 0.1 * len(longest) and len(re.findall(r"[;,{}()=]", longest)) > len(longest) // 12


def literal_words(content: str) -> list[str] | None:
    """The words of a file's literals, in order, if literals fill it."""
    solid = len("".join(content.split()))
    if solid < LITERAL_CHARS or len(_LITERAL.sub("", content)) > (1 - LITERAL) * solid:
        return None
    return [w for m in _LITERAL.finditer(content) for w in WORD_RE.findall(m[0])]


def by_marks(path: str | None, content: str, tokens: int, reuse: float) -> tuple[str | None, bool]:
    """(generated, vendored, minified or None; whether a licence notice stands in the head), for files that the grammar leaves open."""
    path = path or ""
    top = head(content)
    plain = [re.sub(r"^(?:#+|//+|/\*+!?|\*+)\s*", "", x) for x in top]
    if any(GENERATED_BANNER.match(x) and not DENIES.search(x) for x in plain):
        return "generated", False
    if VENDOR_FOLDER.search(path) or VERSIONED_FOLDER.search(path):
        return "vendored", False
    if any(VENDOR_BANNER.match(x) and not DENIES.search(x) for x in plain) or top and VERSION_BANNER.match(top[0]):
        return "vendored", False
    if reuse >= DENSE_REUSE and dense(content) or MINIFIED_NAME.search(path) and tokens > 50 and len(content) > 200 * (content.count("\n") + 1):
        return "minified", False
    if GENERATED_NAME.search(path) and top and any(re.search(r"generat|\bproto", x, re.I) for x in top):
        return "generated", False
    return None, any(LICENCE.search(x) for x in top)


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    points, offsets = code_points(texts)
    starts = token_starts(points)
    return token_hashes(points, starts, token_ends(points, starts)), np.searchsorted(starts, offsets)


def judged(paths: list[str | None], texts: list[str | None], grammars: bool = True, marks: bool = True) -> tuple[Grammar, list[str | None], list[str], list[bool]]:
    """For a block of files: their grammars, and of each its kind or None, what decided, and whether it has a licence notice.

    ``grammars`` or ``marks`` switch one kind of evidence off, to measure the other.
    """
    g = Grammar(*_hashed(texts))
    reuse, covered = g.uses / np.maximum(g.rules, 1), g.covered / np.maximum(g.length, 1)
    repetitive = (g.length >= REUSED_TOKENS) & (reuse >= REUSE) & (covered >= COVERED)
    literals = {i: w for i, t in enumerate(texts) if t and (w := literal_words(t)) is not None}
    noise = Grammar(*_hashed([" ".join(w) for w in literals.values()])).ratio() if literals else np.zeros(0)
    data = {i for i, r in zip(literals, noise.tolist()) if r >= INCOMPRESSIBLE}
    kinds: list[str | None] = []
    decided: list[str] = []
    noticed: list[bool] = []
    for i, (path, text) in enumerate(zip(paths, texts)):
        text = text or ""
        kind, by, notice = None, "", False
        if grammars and i in data:
            kind, by = "data", "literals"
        elif grammars and repetitive[i]:
            kind, by = "minified" if dense(text) else "generated", "reuse"
        elif marks:
            kind, notice = by_marks(path, text, int(g.length[i]), float(reuse[i]))
            by = "marks" if kind else ""
        kinds.append(kind)
        decided.append(by)
        noticed.append(notice)
    return g, kinds, decided, noticed


PROFILE = "file_id bigint, repo_id int, kind string, decided string, noticed boolean, tokens int, rules int, reuse double, covered double, ratio double, shared array<bigint>"


def profiles(files: DataFrame, grammars: bool = True, marks: bool = True) -> DataFrame:
    """Per file its grammar's figures, what it is by itself, what decided, and its distinct long rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            texts = block.column("content").to_pylist()
            g, kinds, decided, noticed = judged(block.column("path").to_pylist(), texts, grammars, marks)
            long = g.derived >= SHARED_TOKENS
            order = np.argsort(g.owner[long], kind="stable")
            names = g.name[long][order].view(np.int64)
            edges = np.searchsorted(g.owner[long][order], np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [block.column("file_id"), block.column("repo_id"), pa.array(kinds, pa.string()), pa.array(decided, pa.string()), pa.array(noticed, pa.bool_()), pa.array(g.length, pa.int32()), pa.array(g.rules, pa.int32()), pa.array(g.uses / np.maximum(g.rules, 1)), pa.array(g.covered / np.maximum(g.length, 1)), pa.array(g.ratio()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(names))],
                ["file_id", "repo_id", "kind", "decided", "noticed", "tokens", "rules", "reuse", "covered", "ratio", "shared"],
            )

    rows = files.select("file_id", "repo_id", "path", "content").where(F.col("file_id").isNotNull())
    return rows.mapInArrow(run, PROFILE)


def unwritten_files(files: DataFrame, grammars: bool = True, marks: bool = True) -> DataFrame:
    """(file_id, kind, decided) of every file that is not hand-written: generated, minified, vendored or data.

    Input: file_id, repo_id, path, content.  ``decided`` is the evidence: reuse, literals, shared (the grammar's) or marks.  A
    null or empty content is hand-written (an empty module) unless it lies in a vendoring folder; a row without an id is left out; a file
    delivered twice comes out once; a null repo_id shares rules with no repository.  Text that is no code at all (a log or a page under a wrong extension) is not
    data saved as code; it is a file that doesn't parse (problem 4).
    """
    from codeloom.session import written

    seen = written(profiles(files, grammars, marks), "unwritten-profiles")
    sure = seen.where("kind is not null").select("file_id", "kind", "decided")
    if not grammars:
        return sure.dropDuplicates(["file_id"])
    # rules shared across repositories, counted over all files; asked for files that are still open and could be copies by the number of their rules or by a notice
    rules = seen.select("repo_id", F.explode("shared").alias("rule")).where("repo_id is not null").distinct().groupBy("rule").agg(F.count("*").alias("repositories"))
    open_files = seen.where(F.col("kind").isNull() & (F.col("noticed") | (F.size("shared") >= COPIED_RULES))).dropDuplicates(["file_id"])
    asked = open_files.select("file_id", "noticed", F.explode("shared").alias("rule")).join(rules, "rule")
    part = asked.groupBy("file_id", "noticed").agg(F.avg((F.col("repositories") >= SHARED_REPOSITORIES).cast("double")).alias("part"), F.count("*").alias("rules"))
    copied = part.where((F.col("noticed") & (F.col("part") >= SHARED_PART)) | ((F.col("rules") >= COPIED_RULES) & (F.col("part") == 1))).select("file_id", F.lit("vendored").alias("kind"), F.lit("shared").alias("decided"))
    return sure.unionByName(copied).dropDuplicates(["file_id"])
