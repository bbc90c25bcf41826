"""Functions paired with their documentation (problem 3).

Method: island grammars.  For each language only the islands are parsed: documentation, annotations, signatures and
balanced bodies; everything between them is water and skipped.  Docstrings have an island grammar of their own: section labels, entries and
fields with their names and types are islands that tell nothing by themselves, and only the text that they hold, and the prose between
them, is searched for something told: without the words of the function's own name and signature, stock words and remarks that
documentation is missing.

The pairs of a symbols table come from the islands of its files, joined by repository, path and line; where a file is missing or its
island's docstring differs from the symbol's, the symbol's own docstring goes through the docstring grammar.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks

# fixed values: words that tell nothing in a docstring
STOCK = set(
    """this that these those function functions method methods class classes coroutine procedure routine callable object objects instance module code implementation helper util utility wrapper internal private public generic simple basic main
    will would does do done is are be been was were has have can may should must shall to of in on for from with by at as and or not the a an it its self cls if then when which who what where there here used use uses using call calls called perform performs execute executes run runs make makes
    get gets set sets getter setter init initialize initializes initialise constructor default given specified provided passed value values result results return returns returned returning param params parameter parameters arg args argument arguments kwarg kwargs keyword keywords raise raises raised yields yield rtype type types input inputs output outputs
    attribute attributes note notes example examples see also none null nil true false int str string float bool boolean list dict tuple bytes any optional union iterable sequence number integer array void unknown promise record
    summary description describe desc details detail docstring docs doc documentation document documented documenting undocumented comment comments text placeholder todo fixme xxx tbd tba wip hack pending missing later soon fill filled write written add added complete completed incomplete needed needs need required no yet available n na autogenerated auto generated stub empty blank unspecified lorem ipsum work progress please explain goes go me my we you i
    der die das ein eine einer und oder von zu mit für im in den dem des diese dieser dieses funktion methode klasse wird ist gibt zurück beschreibung dokumentation fehlt noch keine kein
    el la los las un una y o de del en para con por esta este función método clase es se descripción documentación falta pendiente devuelve sin
    le les un une et ou de du des dans pour avec par cette ce fonction méthode classe est la description documentation manque manquante à renvoie retourne aucune
    o os as um uma e ou do da dos das em para com por esta este função método classe é descrição documentação falta pendente retorna devolve sem""".split()
)
#: Filler: metasyntactic words, keyboard runs, and the words that filler texts begin with.
_FILLER = re.compile(r"foo|bar|baz|qux|quux|blah?|hmm+|asdf\w*|qwer\w*|zxcv\w*|hjkl\w*|wait|okay|lorem|ipsum|dolor|amet|consectetur|adipiscing|elit")

# fixed values: labels of sections, and fields
_SECTION = re.compile(r"\s*(?:args|arguments|parameters?|params|returns?|raises|yields|attributes|notes?|examples?|see also|keyword args|other parameters|todo|warnings?|summary|description)\s*(?P<colon>:?)\s*$", re.I)
_RULE = re.compile(r"\s*[-=~^]{3,}\s*$")
_FIELD = re.compile(r"\s*(?::(?:param|type|return|returns|rtype|raises?|arg|var|ivar|cvar|keyword)\b(?P<names>[^:\n]*):|@(?:param|returns?|type|throws|arg|example|see|template|typedef|property)\b(?P<braced>\s*\{[^}\n]*\})?)", re.I)
_NAMED = re.compile(r"(?P<name>\s+\*{0,2}[\w.\[\], |]{1,60}?)\s*(?P<type>\([^()\n]*\))?\s*:(?=\s|$)")


def docstring_islands(docstring: str) -> list[tuple[str, str]]:
    """(kind, text) of a docstring, in order: section, rule, field, entry (a name with its type) and prose.

    An entry is an indented name before a colon below a section label.  Descriptions are prose.
    """
    out: list[tuple[str, str]] = []
    inside = False
    for line in docstring.split("\n"):
        if not line.strip():
            continue
        if _SECTION.match(line):
            out.append(("section", line.strip()))
            inside = True
        elif _RULE.match(line):
            out.append(("rule", line.strip()))
        elif m := _FIELD.match(line):
            out.append(("field", m[0].strip()))
            out.append(("prose", line[m.end() :]))
        elif inside and (m := _NAMED.match(line)):
            out.append(("entry", m[0].strip()))
            out.append(("prose", line[m.end() :]))
        else:
            inside = inside and line[:1].isspace()
            out.append(("prose", line))
    return [(k, t) for k, t in out if t.strip()]


def split_name(name: str) -> list[str]:
    """Words of an identifier, lower-cased: snake, kebab and camel case and digits."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|[^\W\d_]+|\d+", name)]


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """A crude stem under which inflected forms of one word meet."""
    w, again = word, True
    while again:
        again = False
        for ending in ("ings", "ing", "edly", "ied", "ies", "ed", "ers", "er", "es", "s", "e"):
            if w.endswith(ending) and len(w) - len(ending) >= 3:
                w = w[: -len(ending)] + ("y" if ending in ("ied", "ies") else "")
                again = True
                break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    if len(w) > 3 and w[-1] in "eyi":
        w = w[:-1]
    return w


def informative_words(docstring: str | None, own: str) -> list[str]:
    """Words of a docstring that tell something; ``own`` is the text of the qualified name and the signature."""
    if not docstring:
        return []
    names = re.findall(r"\w+", own)
    mine = {n.lower() for n in names} | {w for n in names for w in split_name(n)}
    mine_stems = {stem(w) for w in mine}
    told = []
    for kind, text in docstring_islands(re.sub(r"https?://\S+", " link ", docstring)):
        if kind != "prose":
            continue
        for token in re.findall(r"[^\W_][\w']*|_\w+", text):
            if token.lower() in mine or re.fullmatch(r"_\w+_", token):
                continue
            for w in split_name(token):
                if len(w) > 1 and not w.isdigit() and w not in STOCK and w not in mine and stem(w) not in mine_stems and stem(w) not in _STOCK_STEMS and not _FILLER.fullmatch(w):
                    told.append(w)
                elif len(w) == 1 and ord(w) > 0x2E80:
                    told.append(w)
    return told


_STOCK_STEMS = {stem(w) for w in STOCK if len(w) > 4}


def tells(docstring: str | None, qualified_name: str | None, signature: str | None) -> bool:
    """Whether a docstring tells something that its function's name and signature don't."""
    return bool(informative_words(docstring, f"{qualified_name or ''} {signature or ''}"))


# --- islands of source files ---------------------------------------------------------------------------------

#: What a line of code may begin with; annotations and definitions are islands, all else is water.
_PY_DEF = re.compile(r"(?P<indent>[ \t\f]*)(?:(?P<deco>@)|(?P<kind>async[ \t]+def|def|class)[ \t]+(?P<name>\w+))?")
_PY_WATER = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*")
_PY_TOKEN = re.compile(r"\"\"\"|'''|[\"'()\[\]{}:\n]|#[^\n]*|\\\n")
_PY_PREFIX = re.compile(r"(?<!\w)[rRbBuUfFtT]{1,2}\Z")
_PY_CLOSE = {q: re.compile(rf"[^{q[0]}\\]*(?:(?:\\[\s\S]|{q[0]}(?!{q[0] * 2}))[^{q[0]}\\]*)*{q}" if len(q) == 3 else rf"[^{q}\\\n]*(?:\\[\s\S][^{q}\\\n]*)*{q}") for q in ('"""', "'''", '"', "'")}
_PY_TEXT = {q: re.compile(rf"{q}|\{{\{{|[{{}}]|\\[^{{}}]" + ("" if len(q) == 3 else r"|\n")) for q in _PY_CLOSE}
_PY_CODE = re.compile(r"\"\"\"|'''|[\"'()\[\]{}:]|#[^\n]*")
#: Lines that no bracket holds: definitions, and statements that begin with a keyword.
_PY_NEXT = re.compile(r"[ \t\f]*(?:(?P<kind>async[ \t]+def|def|class)[ \t]+\w|(?:import|return|raise|while|with|try|except|finally|elif|pass|assert|del|global|nonlocal|break|continue)\b)")
_PY_HEADER = re.compile(r"^(?P<indent>[ \t\f]*)(?:async[ \t]+def|def|class)[ \t]+\w+[ \t]*[(:\[]", re.M)
_PY_BODY = re.compile(r":[ \t]*(?:#[^\n]*)?\n?[ \t]*[rRbBuUfF]{0,2}\Z")
_PY_GAP = re.compile(r"(?:[\s(]|\\\n|#[^\n]*\n)*")
_PY_AFTER = re.compile(r"(?:[\s)]|\\\n|#[^\n]*(?:\n|\Z))*(?:;|\Z)")


class Island(NamedTuple):
    """A function or method of a source text; its header begins at ``line`` and its body ends at ``end_line``, both from 1."""

    qualified_name: str
    signature: str
    documentation: str | None
    line: int
    end_line: int
    annotations: tuple[str, ...]


class _Line(NamedTuple):
    """A logical line without a closing comment: its first colon outside brackets or -1, whether its brackets are balanced, and (begin, text's begin, text's end, end) of its strings."""

    start: int
    end: int
    colon: int
    balanced: bool
    strings: list[tuple[int, int, int, int]]


def _py_width(indent: str) -> int:
    return len(indent.rpartition("\f")[2].expandtabs(8))


def _py_formatted_end(text: str, at: int, quote: str) -> int:
    """Where a formatted string ends, whose fields may hold strings in the same quotes, or -1 if they aren't balanced."""
    open_, quotes = ["string"], [quote]  # strings, their fields, the formats of these (which are text again), brackets
    while m := (_PY_TEXT[quotes[-1]] if open_[-1] in ("string", "format") else _PY_CODE).search(text, at):
        c, at, inner = m[0], m.end(), open_[-1]
        if inner in ("string", "format"):
            if c in (quotes[-1], "\n"):
                if c == "\n" or inner == "format":
                    return -1
                open_.pop()
                quotes.pop()
                if not open_:
                    return at
            elif c == "{":
                open_.append("field")
            elif c == "}" and inner == "format":
                del open_[-2:]
        elif c[0] in "\"'":
            if _py_formatted(_py_prefix(text, m.start())):
                open_.append("string")
                quotes.append(c)
            elif s := _PY_CLOSE[c].match(text, at):
                at = s.end()
            else:
                return -1
        elif c in "([{":
            open_.append("bracket")
        elif c in ")]}":
            if inner == "field" and c != "}":
                return -1
            open_.pop()
        elif c == ":" and inner == "field":
            open_.append("format")
    return -1


def _py_prefix(text: str, at: int) -> str:
    """The letters before the quotes at ``at``, in lower case."""
    m = _PY_PREFIX.search(text, max(0, at - 2), at) if text[at - 1 : at].isalpha() else None
    return m[0].lower() if m else ""


def _py_formatted(prefix: str) -> bool:
    return "f" in prefix or "t" in prefix


def _py_annotated(text: str, at: int, least: int) -> int:
    """Where the lines of annotations begin that stand right before the line at ``at``, after ``least``."""
    while (before := text.rfind("\n", least, at - 1) + 1) > least and text[before:at].lstrip(" \t\f")[:1] == "@":
        at = before
    return at


def _py_lines(text: str, torn: bool = False) -> tuple[list[_Line], bool]:
    """Logical lines of a text that aren't blank or mere comments, and whether a string is still open at its end.

    A bracket that isn't closed ends before a line that no bracket holds.  With ``torn`` some quotes of the text are missing: a string that holds a
    definition no deeper than its own line, and goes on to the text's end or to where a body begins, was never closed and ends before it.
    """
    lines: list[_Line] = []
    at, unclosed, nested = 0, False, True  # nested: formatted strings have been balanced; where one isn't, quotes in fields end the strings after it
    while (start := _PY_WATER.match(text, at).end()) < len(text):
        depth, colon, comment, balanced, at, strings = 0, -1, -1, True, start, []
        while m := _PY_TOKEN.search(text, at):
            c, at = m[0], m.end()
            if c == "\n":
                if not depth:
                    end = comment if comment >= 0 else m.start()
                    break
                if s := _PY_NEXT.match(text, at):
                    end = at = _py_annotated(text, at, start) if s["kind"] else at
                    break
            elif c[0] in "\"'":
                kind, close = _py_prefix(text, m.start()), -1
                if nested and _py_formatted(kind):
                    close = _py_formatted_end(text, at, c)
                    nested = close >= 0
                if close < 0 and (s := _PY_CLOSE[c].match(text, at)):
                    close = s.end()
                if len(c) == 1 and close < 0:  # water up to the line's end
                    newline, comment = text.find("\n", at), -1
                    at = newline if newline >= 0 else len(text)
                    continue
                unclosed |= close < 0
                inner = close - len(c) if close >= 0 else len(text)
                if torn and len(c) == 3 and (close < 0 or _PY_BODY.search(text, at, inner)):
                    width = _py_width(_PY_DEF.match(text, start)["indent"])
                    if h := next((h for h in _PY_HEADER.finditer(text, at, inner) if _py_width(h["indent"]) <= width), None):
                        close, inner = -1, _py_annotated(text, h.start(), at)
                strings.append((m.start() - len(kind), at, inner, close))
                at = close
                if close < 0:
                    end = at = inner
                    break
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                balanced &= depth > 0 or colon >= 0
                depth = max(depth - 1, 0)
            elif c == ":" and not depth and colon < 0:
                colon = m.start()
            comment = m.start() if c[0] == "#" else -1
        else:
            end, at = comment if comment >= 0 else len(text), len(text)
        lines.append(_Line(start, end, colon, balanced and (not depth or colon >= 0), strings))
    return lines, unclosed


def _py_documentation(text: str, at: int, line: _Line) -> str | None:
    """The string literal (in pieces, in parentheses) that is the whole statement at ``at``; one that the text breaks off in goes to its end."""
    pieces = []
    for begin, a, b, end in line.strings:
        if begin < at:
            continue
        if _PY_GAP.fullmatch(text, at, begin):
            if _py_formatted(text[begin:a].lower()):
                return None
            pieces.append(text[a:b])
            at = end if end >= 0 else b
        else:
            break
    return inspect.cleandoc("".join(pieces)).strip() if pieces and _PY_AFTER.match(text, at, line.end) else None


def python_definitions(text: str) -> list[Island]:
    """The functions and methods of a text.

    An island is made of annotations, a header up to its colon and a body: what follows on the line, or the lines below that are indented deeper; documentation is
    the string that a body begins with.  All other strings, comments, brackets and statements are water; what stands in them is no island, and a statement ends the
    bodies that it isn't indented in.
    """
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    lines, unclosed = _py_lines(text)
    if unclosed:
        lines, _ = _py_lines(text, torn=True)
    found: list[Island] = []
    scopes: list[tuple[int, str, str, int]] = []  # width, name, kind, place in found or -1
    annotations: list[tuple[int, str]] = []
    row, counted, last = 1, 0, 1

    def leave(width: int) -> None:
        while scopes and scopes[-1][0] >= width:
            place = scopes.pop()[3]
            if place >= 0:
                found[place] = found[place]._replace(end_line=last)

    for line, below in zip(lines, [*lines[1:], None]):
        m = _PY_DEF.match(text, line.start)
        width = _py_width(m["indent"])
        leave(width)
        row, counted = row + text.count("\n", counted, line.start), line.start
        last = row + text.count("\n", line.start, line.end)
        if m["deco"]:
            annotations.append((width, text[m.end() : line.end].strip()))
            continue
        if m["kind"] and line.balanced:
            at = line.colon if line.colon >= 0 else line.end
            if m["kind"] != "class":
                doc = None
                if text[at + 1 : line.end].strip():
                    doc = _py_documentation(text, at + 1, line)
                elif below and _py_width(_PY_DEF.match(text, below.start)["indent"]) > width:
                    doc = _py_documentation(text, below.start, below)
                prefix = "".join(s + ("." if k == "class" else ".<locals>.") for _, s, k, _ in scopes)
                found.append(Island(prefix + m["name"], text[m.end("indent") : at].strip(), doc, row, last, tuple(a for w, a in annotations if w == width)))
            scopes.append((width, m["name"], m["kind"], -1 if m["kind"] == "class" else len(found) - 1))
        annotations = []
    leave(0)
    return found


def python_islands(text: str) -> list[tuple[str, str, str | None, int]]:
    """(qualified name, signature, documentation, line) of each function or method."""
    return [(i.qualified_name, i.signature, i.documentation, i.line) for i in python_definitions(text)]


_JS_DOC = re.compile(r"/\*\*(?P<doc>[\s\S]*?)\*/\s*(?P<deco>(?:@[\w.]+(?:\([^()]*\))?\s*)*)|(?P<line>(?:^[ \t]*//[^\n]*\n)+)", re.M)
_JS_SIGNATURE = re.compile(
    r"\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|override\s+|abstract\s+)*(?:(?:async\s+)?function\s*\*?\s*(?P<f>[\w$]+)?\s*(?:<[^<>(){}]*>)?\s*(?=\()|(?:const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*[\w$]*\s*)?(?=\(|[\w$]+\s*=>)|(?:async\s+|get\s+|set\s+|\*\s*)*(?P<m>[\w$#]+)\s*(?:<[^<>(){}]*>)?\s*(?=\())"
)
_JS_CLASS = re.compile(r"\bclass\s+(?P<name>[\w$]+)[^{;]*\{")
_JS_SKIP = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?<=[=(,:;!&|?{}\s])/(?![*/ \n])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|[()\[\]{}]")


def balanced(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes (exclusive), or -1."""
    depth = 0
    for m in _JS_SKIP.finditer(text, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return m.end()
    return -1


def script_islands(text: str) -> list[tuple[str, str, str | None, int]]:
    """(qualified name, signature, documentation, line) of each documented function or method of JavaScript or TypeScript."""
    classes = [(m.start(), balanced(text, m.end() - 1), m["name"]) for m in _JS_CLASS.finditer(text)]
    out = []
    for d in _JS_DOC.finditer(text):
        s = _JS_SIGNATURE.match(text, d.end())
        if not s or not (name := s["f"] or s["v"] or s["m"]) or name in ("if", "for", "while", "switch", "catch", "return", "function", "import", "super"):
            continue
        opened = text.find("(", s.end()) if text[s.end() : s.end() + 1] != "(" else s.end()
        close = balanced(text, opened) if opened >= 0 else -1
        if close < 0:
            continue
        tail = re.compile(r"\s*(?::\s*[^{};=]+(?:<[^{};]*>)?)?\s*(?:=>)?").match(text, close)
        body = text[tail.end() : tail.end() + 1]
        if s["m"] and body != "{":
            continue  # a call, not a method
        raw = d["doc"] if d["doc"] is not None else d["line"]
        doc = "\n".join(re.sub(r"^\s*(?:\*+|//+)\s?", "", x).rstrip() for x in raw.strip().split("\n")).strip()
        owner = next((n for a, b, n in classes if a < s.start() < b), None)
        signature = " ".join(text[s.start() : tail.end()].replace("=>", "").split())
        out.append((f"{owner}.{name}" if owner and s["m"] else name, signature, doc, text.count("\n", 0, s.start("f") if s["f"] else s.start("v") if s["v"] else s.start("m")) + 1))
    return out


ISLANDS = {"python": python_islands, "javascript": script_islands, "typescript": script_islands}


def language_of(language: str | None, path: str | None) -> str | None:
    """The language of a file: the given one in lower case, or by extension."""
    if language and language.strip():
        return language.strip().lower()
    extension = (path or "").rpartition(".")[2].lower()
    return {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}.get(extension)


def _source_islands(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, start_line, told, digest) of each Python function's island; texts stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            rows = [
                (repo, path, line, tells(d, q, s), d)
                for repo, path, content in zip(*(block.column(c).to_pylist() for c in ("repo_id", "path", "content")))
                for q, s, d, line in python_islands(content) if d
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string()))], ["repo_id", "file_path", "start_line", "told", "doc"])

    python = F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), F.when(F.lower("path").endswith(".py"), F.lit("python"))) == "python"
    kept = files.where(python & F.col("content").isNotNull()).select("repo_id", "path", "content")
    found = kept.mapInArrow(run, "repo_id int, file_path string, start_line int, told boolean, doc string")
    return found.select("repo_id", "file_path", "start_line", "told", _digest("doc").alias("digest"))


def _digest(text: str) -> F.Column:
    """A docstring's words, whatever its indentation, as one hash."""
    return F.xxhash64(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n\x0b\x0c")), r"\s+", " "))


def documented_symbols(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(symbol_id, repo_id, qualified_name, signature, docstring) of each function or method whose docstring tells something.

    ``files`` holds the sources: a symbol is joined with the island at its place, which tells or doesn't.  Without files, or where the island is
    missing or documents otherwise, the symbol's own docstring is parsed.  Null, empty and trivial docstrings give no pair; rows without
    an id are left out; a symbol delivered twice counts once; a null name or signature has no words of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [tells(d, q or n, s) if t is None else t for n, q, s, d, t in zip(*(b.column(c).to_pylist() for c in ("name", "qualified_name", "signature", "docstring", "told")))]
            yield b.filter(pa.array(keep, pa.bool_())).select(["symbol_id", "repo_id", "qualified_name", "signature", "docstring"])

    wanted = symbols.where(F.col("symbol_id").isNotNull() & F.col("type").isin("function", "method") & (F.length(F.trim("docstring")) > 0))
    wanted = wanted.select("symbol_id", "repo_id", "file_path", "start_line", "name", "qualified_name", "signature", "docstring")
    if files is None:
        met = wanted.withColumn("told", F.lit(None).cast("boolean"))
    else:
        met = wanted.withColumn("digest", _digest("docstring")).join(_source_islands(files), ["repo_id", "file_path", "start_line", "digest"], "left")
    met = met.where("told is null or told").select("symbol_id", "repo_id", "name", "qualified_name", "signature", "docstring", "told")
    return met.mapInArrow(run, "symbol_id bigint, repo_id int, qualified_name string, signature string, docstring string").dropDuplicates(["symbol_id"])


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, language, qualified_name, signature, docstring, line) of the functions in source files whose documentation tells something.

    Null contents and unknown languages give none.  A file that breaks off still gives the functions before the break.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            rows = []
            for i, path, language, content in zip(*(block.column(c).to_pylist() for c in ("file_id", "path", "language", "content"))):
                language = language_of(language, path)
                if language in ISLANDS:
                    rows += [(i, language, q, s, d, n) for q, s, d, n in ISLANDS[language](content) if tells(d, q, s)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file_id", "language", "qualified_name", "signature", "docstring", "line"])

    kept = files.select("file_id", "path", "language", "content").where("file_id is not null and content is not null")
    return kept.mapInArrow(run, "file_id bigint, language string, qualified_name string, signature string, docstring string, line int").dropDuplicates(["file_id", "line", "qualified_name"])
