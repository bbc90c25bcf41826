from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import parse_errors as P
from codeloom.llm.derivatives import Grammar
from codeloom.llm.grammars import grammar, python_kinds
from tests.conftest import clashing

VALID = {
    "python": ["", "\ufeffx = 1\r\ny = 2", "\f\ndef f(): pass", "async def f(*, a: int = 1, **k) -> None:\n    async with a as b, c: await d\n    return [x async for x in y if z], {**a}, lambda *p, q=1: p\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nelse:\n  x: int = 1\nfinally:\n  del a[0], b.c\n", "x = a if b else c; y = (z := 3)\nprint(*a, **b, c=1)\n@d\nclass C(A, metaclass=M):\n\tx = 0x_1f + 1_0.5e-3j\n", "match x:\n  case {'a': [1, *_]} | C(y=2) if z:\n    pass\nmatch = case = 1\n", "a[1:2, ::3, ...] @= b\nx = y = *z, 1\nfor i, (j, k) in e: continue\n", "if x:\n    pass\n  # odd comment\nelse:\n    y\n", "global_ = f'{a!r:>{w}}' 'b' \\\n  'c'\n"],
    "javascript": ["", "'use strict';\nimport a, * as b from 'c'\nexport default class extends A { #p = 1; static async *g() {} get x() { return this.#p } static { f() } }", "let {a, ...b} = c ?? d, [e, , f = 1] = g\nfor (const x of y) if (x) continue; else break\na ||= b?.c?.[d]?.(e)", "const r = /[/]\\/x/gi.test(s) / 2, t = `a${`b${c}`}d`, n = 1_000n\nlabel: for (;;) { break label }", "const f = async ({a}, ...b) => ({ a, [b]: 1, get c() { return 1 }, async *d() {} })\nnew F\nnew (g())(1).h", "x = <div a=\"b\" {...c}>it's {d && <e.f/>} &amp; <></></div>", "export { a as default, b } from './x'; export * as ns from 'y'\ndo x++; while (x < 5)\nvar y = function* () { yield* z }"],
    "typescript": ["interface A<T> extends B, C<T> { readonly a?: string; [k: string]: any; (x: number): void; m<U>(u: U): U }", "type X<T> = T extends (infer U)[] ? { [K in keyof T]?: U } : typeof a.b | `x${string}`; enum E { A = 1, B = 'x' }", "export abstract class Q<T> extends R<T> implements S { private x!: number; constructor(private readonly y?: string) { super() } abstract z(): void; static w = <any>null as unknown as string }".replace("<any>null", "null"), "declare module 'm' { export const x: number }\nnamespace N.M { export type T = string }\nimport type { A } from 'b'\nfunction f(this: W, a: string): a is 'x' { return g<T>(a)! satisfies boolean }", "const f = <T,>(x: T): Promise<Array<Map<string, T>>> => x as any; let u: [a: string, b?: number, ...c: any[]]; @dec() class D { @p q = 1 }"],
}
INVALID = {
    "python": ["def f(:\n  pass", "x = (1", "print 'a'", "if x\n  y", "  x = 1", "x = 'a", "f() = 1", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "def f():\nreturn 1", "x = 012", "else:\n  pass", "a = ‘b’", "class C:\n", "import", "if x:\n    a\n  b\n", "x = 1 2", "for x in y { }", "try:\n  x\n"],
    "javascript": ["let a: number = 1", "function f() {", "const x = ;", "const = 1", "if (a { }", "x = 'a", "interface A { }", "import os\nfrom x import y", "<<<<<<< HEAD\n", "a b c", "}", "`a${b +}`", "var x = <div><p></div>", "for (const x of) {}", "const s = ‘a’;", "if (a &lt; 1) { b() }", "class { }", "x = {a: 1, b}; y = [1, 2;"],
    "typescript": ["interface A { a: }", "let x: = 1", "type = 5 5", "function f(a: string {", "def f():\n  pass", "enum E { A = , B }", "class A { x: number y: string }", "const f = (a: number): => a"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert P.failure(text, language) is None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert P.failure(text, language) is not None


def test_javascript_is_typescript_without_types():
    for text in VALID["javascript"]:
        assert P.failure(text, "typescript") is None


def test_failing_token_and_truncation():
    assert P.failure("x = (1 +", "python")[2] and P.failure("function f() { g(", "javascript") == (7, "end", True)
    assert P.failure("a = 1\nb = = 2\n", "python") == (6, "=", False)


def test_python_agrees_with_the_exact_parser(sf):
    rows = duckdb.sql(f"SELECT content FROM '{Path(sf)}/files.parquet' WHERE path LIKE '%.py'").fetchall()
    for (text,) in rows:
        try:
            ast.parse(text.removeprefix("\ufeff"))
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        assert (grammar("python").failure(python_kinds(text.removeprefix("\ufeff"))) is None) == valid


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "(", ")", ",", "+"]), max_size=9))
def test_derivatives_agree_with_a_recursive_recogniser(tokens):
    g = Grammar("start = expr ; expr = term ( '+' term )* ; term = 'a' | 'b' '('? ')'? | '(' ( expr ( ',' expr )* )? ')' ;", "start")

    def ends(at: int) -> set[int]:
        out = set(term(at))
        todo = list(out)
        while todo:
            i = todo.pop()
            if i < len(tokens) and tokens[i] == "+":
                new = term(i + 1) - out
                out |= new
                todo += new
        return out

    def term(at: int) -> set[int]:
        if at >= len(tokens):
            return set()
        if tokens[at] == "a":
            return {at + 1}
        if tokens[at] == "b":
            out = {at + 1}
            for c in "()":
                out |= {i + 1 for i in out if i < len(tokens) and tokens[i] == c}
            return out
        if tokens[at] != "(":
            return set()
        out = {at + 1}
        inner = ends(at + 1)
        todo = list(inner)
        while todo:
            i = todo.pop()
            if i < len(tokens) and tokens[i] == ",":
                new = ends(i + 1) - inner
                inner |= new
                todo += new
        out |= inner
        return {i + 1 for i in out if i < len(tokens) and tokens[i] == ")"}

    assert (g.failure(tokens) is None) == (len(tokens) in ends(0))


def test_rows(spark):
    rows = [(1, 1, "a.py", "Python", "x = 1"), (2, 1, "b.py", None, "x = ("), (2, 1, "b.py", None, "x = ("), (3, 1, "c.js", "javascript", "let a: b"), (4, 2, "d.tsx", None, ""), (5, 2, "e.rb", None, "x ="), (6, None, None, None, "x"), (7, 1, "f.py", "python", None), (None, 1, "g.py", "python", "("), (8, 2, "h.ts", "TypeScript", "let a: = 1"), (9, 1, "deep.py", "python", "x = " + "(" * 5000)]
    df = clashing(spark.createDataFrame(rows, "file_id bigint, repo_id int, path string, language string, content string"))
    assert sorted(r.file_id for r in P.invalid_files(df).collect()) == [2, 3, 8, 9]
    rates = {(r.repo_id, r.language): (r.files, r.invalid, r.rate) for r in P.failure_rates(df).collect()}
    assert rates == {(1, "python"): (3, 2, 0.666667), (1, "javascript"): (1, 1, 1.0), (2, "typescript"): (2, 1, 0.5)}
    assert P.invalid_files(df.limit(0)).count() == 0
