"""Python sources parsed once a file into symbols, chunks, syntax nodes, calls and parse errors.

One Arrow-backed pass emits tagged rows; everything after it is relational.  Broken sources never fail: top-level blocks that
parse are used as they are, and in those that don't, definitions with a complete header are kept and flagged.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.functions.tokens import TOKEN_RE
from codeloom.session import written

MAX_TOKENS = 512
# fixed value: what stands at the end of the header of a later part
CONTINUED = "  # ... continued"

_COLUMNS: list[tuple[str, str, pa.DataType]] = [
    ("file_id", "bigint", pa.int64()), ("repo_id", "int", pa.int32()), ("file_path", "string", pa.string()), ("tag", "string", pa.string()), ("ord", "int", pa.int32()), ("name", "string", pa.string()), ("type", "string", pa.string()),
    ("start_line", "int", pa.int32()), ("end_line", "int", pa.int32()), ("start_col", "int", pa.int32()), ("end_col", "int", pa.int32()), ("signature", "string", pa.string()), ("docstring", "string", pa.string()), ("decorators", "array<string>", pa.list_(pa.string())), ("bases", "array<string>", pa.list_(pa.string())),
    ("is_async", "boolean", pa.bool_()), ("parent_symbol", "string", pa.string()), ("qualified_name", "string", pa.string()), ("import_source", "string", pa.string()), ("import_alias", "string", pa.string()), ("import_module", "string", pa.string()), ("is_wildcard_import", "boolean", pa.bool_()), ("has_parse_error", "boolean", pa.bool_()),
    ("content", "string", pa.string()), ("chunk_kind", "string", pa.string()), ("token_count", "int", pa.int32()), ("part", "int", pa.int32()), ("total_parts", "int", pa.int32()), ("is_continuation", "boolean", pa.bool_()), ("overlap_header", "string", pa.string()), ("callee", "string", pa.string()),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS)
SYMBOL_COLUMNS = ["file_id", "repo_id", "name", "type", "file_path", "start_line", "end_line", "signature", "docstring", "decorators", "bases", "is_async", "parent_symbol", "qualified_name", "import_source", "import_alias", "import_module", "is_wildcard_import", "has_parse_error", "ord"]
CHUNK_COLUMNS = ["file_id", "repo_id", "content", "file_path", "start_line", "end_line", "parent_symbol", "qualified_name", "chunk_kind", "token_count", "part", "total_parts", "is_continuation", "overlap_header", "has_parse_error", "ord"]


def count_tokens(text: str) -> int:
    return len(TOKEN_RE.findall(text))


@dataclass
class _Piece:
    """A statement or comment: its text and lines."""

    text: str
    start: int
    end: int
    node: ast.stmt | None = None


@dataclass
class Source:
    """A parsed text and what is read from it; ``max_tokens`` is the chunks' budget."""

    text: str
    max_tokens: int = MAX_TOKENS
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.text = self.text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", " ")
        self.lines = self.text.split("\n")
        self.bytes = [line.encode() for line in self.lines]
        self.order = {"symbol": 0, "chunk": 0, "call": 0, "node": 0, "error": 0}
        self.comments: list[tuple[int, int, str]] = []
        try:
            for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
                if t.type == tokenize.COMMENT:
                    self.comments.append((t.start[0], t.start[1], t.string))
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
        self.trees: list[ast.Module] = []
        self.broken: list[tuple[int, int]] = []  # first and last line of each block that doesn't parse
        tree = self._parsed(self.text)
        if tree is not None:
            self.trees.append(tree)
        else:
            self._by_blocks()

    @staticmethod
    def _parsed(text: str) -> ast.Module | None:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    def _by_blocks(self) -> None:
        """Top-level blocks on their own: a block begins at a line without indentation that continues nothing."""
        starts = [i for i, line in enumerate(self.lines) if line and not line[0].isspace() and line[0] not in ")]}#" and not re.match(r"(?:else|elif|except|finally)\b", line)]
        merged: list[int] = []
        for i in starts:
            if merged and self.lines[merged[-1]].startswith("@") and all(x.startswith("@") for x in self.lines[merged[-1] : i] if x.strip()):
                continue  # decorators stay with what they decorate
            merged.append(i)
        for a, b in zip(merged, [*merged[1:], len(self.lines)]):
            tree = self._parsed("\n" * a + "\n".join(self.lines[a:b]))
            if tree is not None:
                self.trees.append(tree)
            else:
                self.broken.append((a + 1, b))

    # --- text ---------------------------------------------------------------------------------------------

    def span(self, line: int, col: int, end_line: int, end_col: int) -> str:
        """Source text; columns are byte offsets, as in the syntax tree."""
        if line == end_line:
            return self.bytes[line - 1][col:end_col].decode("utf-8", "replace")
        parts = [self.bytes[line - 1][col:], *self.bytes[line : end_line - 1], self.bytes[end_line - 1][:end_col]]
        return b"\n".join(parts).decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.span(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def start_of(self, node: ast.stmt) -> tuple[int, int]:
        """Where a definition begins, decorators included."""
        decorators = getattr(node, "decorator_list", None)
        if decorators:
            line = decorators[0].lineno
            return line, self.bytes[line - 1].index(b"@")
        return node.lineno, node.col_offset

    def header(self, node: ast.stmt) -> str:
        """From the definition's keyword up to the colon before its body."""
        body = node.body[0]
        line, col = self.start_of(body) if hasattr(body, "decorator_list") else (body.lineno, body.col_offset)
        text = self.span(node.lineno, node.col_offset, line, col)
        depth, quote = 0, ""
        for m in re.finditer(r"\"\"\"|'''|\\.|[\"'()\[\]{}:#\n]", text):
            c = m[0]
            if quote:
                quote = "" if c == quote or quote == "#" and c == "\n" else quote
            elif c in ('"', "'", '"""', "'''", "#"):
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and not depth:
                return text[: m.start()].strip()
        return text.rstrip().rstrip(":")

    def docstring(self, node: ast.stmt) -> str | None:
        """The raw text of the first statement if it is a string: quotes and prefix dropped, escapes not evaluated, pieces joined."""
        first = node.body[0] if node.body else None
        if not isinstance(first, ast.Expr) or not isinstance(first.value, ast.Constant) or not isinstance(first.value.value, (str, bytes)):
            return None
        raw = self.of(first.value)
        pieces = re.findall(r"[rRbBuU]{0,2}(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')", raw)
        return "".join(p[3:-3] if p[:3] in ('"""', "'''") and len(p) >= 6 else p[1:-1] for p in pieces).strip()

    # --- symbols -------------------------------------------------------------------------------------------

    def add(self, tag: str, **values: object) -> None:
        self.rows.append({"tag": tag, "ord": self.order[tag], **values})
        self.order[tag] += 1

    def symbols(self) -> None:
        found: list[tuple[int, dict]] = []

        def emit(node: ast.AST, **values: object) -> None:
            found.append((node.lineno, {"start_line": node.lineno, "end_line": node.end_lineno, "decorators": [], "bases": [], "is_async": False, "is_wildcard_import": False, "has_parse_error": False, **values}))

        def walk(nodes: list, parent: str | None, inside: str | None) -> None:
            """``inside`` is class or function, the kind of the nearest definition."""
            for n in nodes:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    name = n.name if parent is None else f"{parent}.<locals>.{n.name}" if inside == "function" else f"{parent}.{n.name}"
                    is_class = isinstance(n, ast.ClassDef)
                    emit(
                        n, name=n.name, type="class" if is_class else "method" if inside == "class" else "function", signature=None if is_class else self.header(n), docstring=self.docstring(n), decorators=[self.of(d) for d in n.decorator_list],
                        bases=[self.of(b) for b in n.bases] if is_class else [], is_async=isinstance(n, ast.AsyncFunctionDef), parent_symbol=parent, qualified_name=name,
                    )
                    walk(n.body, name, "class" if is_class else "function")
                elif isinstance(n, ast.Import):
                    for a in n.names:
                        emit(a, name=a.asname or a.name, type="import", import_source=a.name, import_alias=a.asname, import_module=a.name)
                elif isinstance(n, ast.ImportFrom):
                    if n.module == "__future__":
                        continue
                    module = "." * n.level + (n.module or "")
                    for a in n.names:
                        if a.name == "*":
                            emit(n, name="*", type="import", import_source=module, import_module=module, is_wildcard_import=True)
                        else:
                            emit(a, name=a.asname or a.name, type="import", import_source=f"{module}.{a.name}" if a.asname else module, import_alias=a.asname, import_module=module)
                else:
                    for block in ("body", "orelse", "finalbody"):
                        if isinstance(getattr(n, block, None), list):
                            walk(getattr(n, block), parent, inside)
                    for h in getattr(n, "handlers", None) or getattr(n, "cases", None) or []:
                        walk(h.body, parent, inside)

        for tree in self.trees:
            walk(tree.body, None, None)
        for a, b in self.broken:
            found += self._scanned(a, b)
        for _, values in sorted(found, key=lambda x: x[0]):
            self.add("symbol", **values)

    def _scanned(self, first: int, last: int) -> list[tuple[int, dict]]:
        """Definitions with a complete header in lines that don't parse."""
        text = "\n".join(self.lines[first - 1 : last])
        out, scopes = [], []
        for m in re.finditer(r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)[ \t]*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?[ \t]*(->[^:\n]+)?(?::|[ \t]*$)", text, re.M):
            kind = m[2].split()[-1]
            if kind == "def" and not m[4]:
                continue
            width = len(m[1].expandtabs(8))
            while scopes and scopes[-1][0] >= width:
                scopes.pop()
            parent, inside = (scopes[-1][1], scopes[-1][2]) if scopes else (None, None)
            name = m[3] if parent is None else f"{parent}.<locals>.{m[3]}" if inside == "def" else f"{parent}.{m[3]}"
            line = first + text.count("\n", 0, m.start())
            end = line
            for i in range(line, last):
                if self.lines[i].strip() and len(self.lines[i]) - len(self.lines[i].lstrip()) <= len(m[1]):
                    break
                end = i + 1 if self.lines[i].strip() else end
            bases = [b.strip() for b in (m[4] or "()")[1:-1].split(",") if b.strip() and "=" not in b] if kind == "class" else []
            out.append((line, {
                "start_line": line, "end_line": max(end, line), "decorators": [], "bases": bases, "is_async": m[2].startswith("async"), "is_wildcard_import": False, "has_parse_error": True, "name": m[3], "type": "class" if kind == "class" else "method" if inside == "class" else "function",
                "signature": None if kind == "class" else m[0].strip().removesuffix(":").strip(), "parent_symbol": parent, "qualified_name": name, **self._around(text, m),
            }))
            scopes.append((width, name, kind))
        return out

    @staticmethod
    def _around(text: str, m: re.Match[str]) -> dict:
        """Decorators before and documentation after a scanned header."""
        above = []
        for line in reversed(text[: m.start()].split("\n")[:-1]):
            if not line.strip().startswith("@"):
                break
            above.insert(0, line.strip()[1:])
        doc = re.compile(r"\s*[rRbBuU]{0,2}(?:\"\"\"([\s\S]*?)(?:\"\"\"|\Z)|'''([\s\S]*?)(?:'''|\Z)|\"([^\"\n]*)\"|'([^'\n]*)')").match(text, m.end())
        return {"decorators": above, "docstring": next((g for g in doc.groups() if g is not None), "").strip() if doc else None}

    # --- chunks --------------------------------------------------------------------------------------------

    def pieces(self, body: list[ast.stmt], first: int, last: int) -> list[_Piece]:
        """Statements of a body and the comments beside them, in order."""
        out = [_Piece(self.span(*self.start_of(n), n.end_lineno, n.end_col_offset), self.start_of(n)[0], n.end_lineno, n) for n in body]
        ranges = [(p.start, p.end, p.node.end_col_offset) for p in out]
        for line, col, text in self.comments:
            if first <= line <= last and not any(a <= line <= b and (line < b or col < c) for a, b, c in ranges):
                out.append(_Piece(text, line, line))
        return sorted(out, key=lambda p: (p.start, p.node is None))

    def chunks(self) -> None:
        for tree in self.trees:
            if not tree.body and self.broken:
                continue
            first = min((self.start_of(n)[0] for n in tree.body), default=1) if self.broken else 1
            last = max((n.end_lineno for n in tree.body), default=0) if self.broken else len(self.lines)
            waiting: list[_Piece] = []
            for p in self.pieces(tree.body, first, last):
                if isinstance(p.node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    self._module(waiting)
                    waiting = []
                    self._definition(p.node, None)
                else:
                    waiting.append(p)
            self._module(waiting)

    def _packed(self, pieces: list[_Piece], budget: int) -> list[tuple[list[_Piece], int]]:
        """Greedy packing: a piece that would overflow a group that isn't empty begins the next one."""
        groups: list[tuple[list[_Piece], int]] = []
        now: list[_Piece] = []
        total = 0
        for p in pieces:
            n = count_tokens(p.text)
            if now and total + n > budget:
                groups.append((now, total))
                now, total = [], 0
            now.append(p)
            total += n
        return [*groups, (now, total)] if now else groups

    def _module(self, pieces: list[_Piece]) -> None:
        groups = self._packed(pieces, self.max_tokens)
        for k, (group, total) in enumerate(groups):
            self.add(
                "chunk", content="\n".join(p.text for p in group), start_line=group[0].start, end_line=group[-1].end, chunk_kind="continuation" if k else "module", token_count=total, part=k + 1, total_parts=len(groups), is_continuation=k > 0, has_parse_error=False,
            )

    def _definition(self, node: ast.stmt, parent: str | None) -> None:
        name = node.name if parent is None else f"{parent}.{node.name}"
        line, col = self.start_of(node)
        content = self.span(line, col, node.end_lineno, node.end_col_offset)
        tokens = count_tokens(content)
        common = {"parent_symbol": parent, "qualified_name": name, "has_parse_error": False}
        if tokens <= self.max_tokens:
            self.add("chunk", content=content, start_line=line, end_line=node.end_lineno, chunk_kind="definition", token_count=tokens, part=1, total_parts=1, is_continuation=False, **common)
        else:
            body = node.body[0]
            at = self.start_of(body) if hasattr(body, "decorator_list") else (body.lineno, body.col_offset)
            header = self.span(line, col, *at).rstrip()
            pieces = self.pieces(node.body, node.body[0].lineno, node.end_lineno)
            groups = self._packed(pieces, self.max_tokens - count_tokens(header))
            for k, (group, _) in enumerate(groups):
                text = header + (CONTINUED if k else "") + "\n" + "\n".join(p.text for p in group)
                self.add("chunk", content=text, start_line=group[0].start, end_line=group[-1].end, chunk_kind="continuation" if k else "definition", token_count=count_tokens(text), part=k + 1, total_parts=len(groups), is_continuation=k > 0, overlap_header=header, **common)
        if isinstance(node, ast.ClassDef):
            for n in node.body:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    self._definition(n, name)

    # --- calls and nodes -----------------------------------------------------------------------------------

    def calls(self) -> None:
        """Calls with their owner, and as ``target`` the called name with its receiver replaced by the class it was made of, where the scope tells."""
        found: list[tuple[int, int, str, str | None, str | None]] = []

        def made_of(value: ast.expr | None) -> str | None:
            """The dotted name that an expression calls: ``K`` of ``K(1)``."""
            return dotted(value.func) if isinstance(value, ast.Call) else None

        def dotted(e: ast.expr | None) -> str | None:
            if isinstance(e, ast.Name):
                return e.id
            if isinstance(e, ast.Attribute):
                inner = dotted(e.value)
                return inner and f"{inner}.{e.attr}"
            return e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) and e.value.isidentifier() else None

        def receivers(node: ast.AST, own_class: bool = False) -> dict[str, str]:
            """Names (and attributes of self) that a scope gives an object of a known class: last assignment wins."""
            out: dict[str, str] = {}
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                    if (name := dotted(a.annotation)) is not None:
                        out[a.arg] = name
            stack = list(ast.iter_child_nodes(node))
            while stack:
                n = stack.pop()
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)) and not own_class:
                    continue
                pairs = [(t, n.value) for t in n.targets] if isinstance(n, ast.Assign) else [(n.target, n.value)] if isinstance(n, (ast.AnnAssign, ast.NamedExpr)) else [(i.optional_vars, i.context_expr) for i in n.items] if isinstance(n, (ast.With, ast.AsyncWith)) else []
                for target, value in pairs:
                    name, cls = dotted(target) if isinstance(target, (ast.Name, ast.Attribute)) else None, made_of(value) or (dotted(n.annotation) if isinstance(n, ast.AnnAssign) else None)
                    if name and cls and (name.startswith("self.") or not own_class and "." not in name):
                        out[name] = cls
                stack.extend(ast.iter_child_nodes(n))
            return out

        def target_of(func: ast.expr, known: dict[str, str]) -> str | None:
            if isinstance(func, ast.Attribute) and (cls := made_of(func.value)) is not None:
                return f"{cls}.{func.attr}"
            name = dotted(func)
            for r in (known if name else ()):
                if name.startswith(r + "."):
                    return known[r] + name[len(r) :]
            return name

        def walk(node: ast.AST, owner: str | None, inside: str | None, known: dict[str, str]) -> None:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    name = n.name if owner is None else f"{owner}.<locals>.{n.name}" if inside == "function" else f"{owner}.{n.name}"
                    is_class = isinstance(n, ast.ClassDef)
                    walk(n, name, "class" if is_class else "function", {**known, **receivers(n, is_class)})
                    continue
                if isinstance(n, ast.Call):
                    found.append((n.lineno, n.col_offset, self.of(n.func), owner, target_of(n.func, known)))
                walk(n, owner, inside, known)

        for tree in self.trees:
            walk(tree, None, None, receivers(tree))
        for line, col, callee, owner, target in sorted(found, key=lambda x: x[:2]):
            self.add("call", callee=callee, name=target, qualified_name=owner, start_line=line, start_col=col)

    def nodes(self) -> None:
        """Syntax nodes in pre-order, lines from 1 and columns from 0 (bytes)."""
        for tree in self.trees:
            stack = list(reversed(tree.body))
            while stack:
                n = stack.pop()
                if hasattr(n, "lineno"):
                    self.add("node", type=type(n).__name__, start_line=n.lineno, end_line=n.end_lineno, start_col=n.col_offset, end_col=n.end_col_offset)
                stack.extend(reversed(list(ast.iter_child_nodes(n))))

    def errors(self) -> None:
        for a, b in self.broken:
            self.add("error", type="ERROR", start_line=a, end_line=b, content="\n".join(self.lines[a - 1 : b]))


def parse_source(text: str, tags: tuple[str, ...] = ("symbol", "chunk", "call", "error"), max_tokens: int = MAX_TOKENS) -> list[dict]:
    """Tagged rows of one text."""
    source = Source(text, max_tokens)
    for tag in tags:
        getattr(source, {"symbol": "symbols", "chunk": "chunks", "call": "calls", "node": "nodes", "error": "errors"}[tag])()
    return source.rows


#: Repeated keys up to which they are broadcast; beyond that Spark chooses the join.
FEW_KEYS = 1_000_000


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Rows delivered more than once, once: keys alone are counted, and only the rows of repeated keys are shuffled.

    An input of fewer splits than there are cores is small; it is spread over the cores by key, which makes it distinct as well.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, key).dropDuplicates([key])
    repeated = written(rows.groupBy(key).agg(F.count("*").alias("deliveries")).where("deliveries > 1").select(key), "repeated")
    few = repeated.count()
    if not few:
        return rows
    if few <= FEW_KEYS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key]))


def parse_files(files: DataFrame, tags: tuple[str, ...] = ("symbol", "chunk", "call", "error"), max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tagged rows of every Python file (by language, or by extension where it is null).

    Input: file_id, repo_id, path, language, content.  Files of other languages and null contents give no rows; an
    empty file gives none; rows without an id are left out; a file delivered twice is parsed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            rows = []
            for i, repo, path, content in zip(*(block.column(c).to_pylist() for c in ("file_id", "repo_id", "path", "content"))):
                rows += [{"file_id": i, "repo_id": repo, "file_path": path, **r} for r in parse_source(content, tags, max_tokens)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, _, t in _COLUMNS], [n for n, _, _ in _COLUMNS])

    python = F.coalesce(F.lower(F.trim("language")), F.when(F.lower("path").endswith(".py"), F.lit("python"))) == "python"
    kept = files.select("file_id", "repo_id", "path", "language", "content").where(python & F.col("file_id").isNotNull() & F.col("content").isNotNull())
    return _once(kept.drop("language"), "file_id").mapInArrow(run, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.where("tag = 'symbol'").select(SYMBOL_COLUMNS)


def chunks(parsed: DataFrame) -> DataFrame:
    return parsed.where("tag = 'chunk'").select(CHUNK_COLUMNS)


def calls(parsed: DataFrame) -> DataFrame:
    """(repo_id, call_site_file, caller, callee_expr, target, call_site_line); caller is null in module code, target where the callee has no name."""
    return parsed.where("tag = 'call'").select("repo_id", F.col("file_path").alias("call_site_file"), F.col("qualified_name").alias("caller"), F.col("callee").alias("callee_expr"), F.col("name").alias("target"), F.col("start_line").alias("call_site_line"))


def rejects(files: DataFrame) -> DataFrame:
    """Files that have no parser here, with the reason; what the pass above leaves out."""
    language = F.coalesce(F.lower(F.trim("language")), F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1))
    return files.select("file_id", "path", language.alias("language")).where(~language.isin("python", "py")).withColumn("reason", F.concat(F.lit("unsupported language: "), "language")).distinct()
