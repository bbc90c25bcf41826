from __future__ import annotations

import ast
from pathlib import Path

import pytest

from codeloom.llm import doc_pairs as D
from tests.conftest import clashing

TRIVIAL = ["", "   ", "TODO", "TBD.", "...", "-----", "#", "None", "No description.", "Undocumented.", "docs pending", "FIXME write docs", "TODO: document this", "load_user", "Loads the user.", "LOAD USER", "<load user>", "This function will load user.", "Method load_user of class Store.", ":param name:\n:return:\n:rtype:", "Args:\n    name:\n\nReturns:", "_summary_\n\nArgs:\n    name (_type_): _description_", "load_user(name)", "Description goes here", "Loading users", "load_user.\n\nTODO", "Wait.", "asdf qwer", "Foo lorem ipsum", "Raises:\n    OddError: TODO", "Args:\n    name (Mapping): _description_\n    other: TBD"]
TELLING = ["Safe to call twice: a second call leaves the cache untouched.", "Raises KeyError when the row was never sealed.", "Devuelve el primer elemento que todavía no fue procesado.", "Wartet, bis jeder Eintrag geschrieben wurde.", "Args:\n    name: the key that the index is sorted by", ":param name: sorted keys\n:return: cached rows", "Loads the user, falling back to guests.", "読み込みます"]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert not D.tells(doc, "Store.load_user", "def load_user(self, name: str) -> User")


@pytest.mark.parametrize(("doc", "name"), [("Applys the plan.", "apply_plan"), ("Closes the brisk barrel.", "close_brisk_barrel"), ("Closed barrels", "close_barrel"), ("Rendered rows", "render_row"), ("Processes queries", "process_query"), ("Copies, copying the copied", "copy"), ("Wrapping of wraps", "wrap")])
def test_inflections(doc, name):
    assert not D.tells(doc, name, f"def {name}()")


@pytest.mark.parametrize("doc", TELLING)
def test_telling(doc):
    assert D.tells(doc, "Store.load_user", "def load_user(self, name: str) -> User")


def test_python_islands():
    text = '@deco(\n  x)\nasync def f(a: dict = {"k": (1, 2)}, *b) -> list[int]:\n    """One\n        two."""\n\n\nclass C:\n    x = "def no(): pass"\n    def m(self):\n        def inner(): \'\'\'In.\'\'\'\n        return (\n\ndef broken(a\n'
    got = {q: (s, d, n) for q, s, d, n in D.python_islands(text)}
    assert got["f"] == ('async def f(a: dict = {"k": (1, 2)}, *b) -> list[int]', "One\ntwo.", 3)
    assert set(got) == {"f", "C.m", "C.m.<locals>.inner"} and got["C.m.<locals>.inner"][1] == "In."


def test_script_islands():
    text = "/**\n * Adds two.\n * @param a first\n */\nexport async function add<T>(a: T, b = {x: 1}): Promise<T> {\n  return a;\n}\nclass K {\n  /** Reads it. */\n  static get(x) { return /[{]/; }\n}\n// Makes one\nconst make = (a, b) => a;\n/** A constant */\nconst y = 5;\n/** call */\nfoo(1);\n"
    got = {q: (s, d, n) for q, s, d, n in D.script_islands(text)}
    assert got["add"] == ("export async function add<T>(a: T, b = {x: 1}): Promise<T>", "Adds two.\n@param a first", 5)
    assert got["K.get"][1] == "Reads it." and got["make"][1] == "Makes one" and set(got) == {"add", "K.get", "make"}


def test_docstring_islands():
    doc = "Reads it.\n\nArgs:\n    name (str): the key\n      of the row\n    other: TODO\n\nReturns\n-------\nNothing: of note\n:param x y: far\n@throws {Odd} when late"
    assert D.docstring_islands(doc) == [
        ("prose", "Reads it."), ("section", "Args:"), ("entry", "name (str):"), ("prose", " the key"), ("prose", "      of the row"), ("entry", "other:"), ("prose", " TODO"), ("section", "Returns"), ("rule", "-------"),
        ("prose", "Nothing: of note"), ("field", ":param x y:"), ("prose", " far"), ("field", "@throws {Odd}"), ("prose", " when late"),
    ]


def test_broken_sources():
    text = 'def open_header(a\n    x = 1\n\ndef no_colon(a, b)\n    """Told."""\n\ndef cut(a):\n    """Starts and\n    breaks off'
    got = {q: (s, d, n) for q, s, d, n in D.python_islands(text)}
    assert got == {"no_colon": ("def no_colon(a, b)", "Told.", 4), "cut": ("def cut(a)", "Starts and\nbreaks off", 7)}


# what bodies, annotations and water decide: source, (name, documentation) of its functions
SOURCES = {
    "a statement closes a class": ('class Cache:\n    size = 0\n\nif Cache.size:\n    def load():\n        """Cache."""\n', [("load", "Cache.")]),
    "a comment closes nothing": ('class Cache:\n    size = 0\n# note\n    def load(self):  # note\n        # note\n        """Told."""\n', [("Cache.load", "Told.")]),
    "brackets close nothing": ('class Cache:\n    sizes = [\n1,\n]\n    text = "a\\\nb"\n    def load(self):\n        """Told."""\n', [("Cache.load", "Told.")]),
    "a string is water": ('T = """\ndef fake():\n    \'\'\'No code.\'\'\'\n"""\ndef f(): pass\n', [("f", None)]),
    "documentation is no code": ('def f():\n        """An example:\n\n        def g():\n            pass\n\n        def h(): pass\n        """\n', [("f", "An example:\n\ndef g():\n    pass\n\ndef h(): pass")]),
    "an annotation is no code": ('@deco("""\ndef fake():\n    \'\'\'No code.\'\'\'\n""")\ndef f():\n    "Told."\n', [("f", "Told.")]),
    "an expression is no documentation": ('def f():\n    "a,b".split(",")\n\ndef g(x):\n    f"Made of {x}."\n\ndef h():\n    "a", "b"\n', [("f", None), ("g", None), ("h", None)]),
    "a string below a body is none of it": ('def f(): pass\n"""Of the module."""\ndef g():\n"""Not indented."""\n', [("f", None), ("g", None)]),
    "documentation in pieces": ('def f():\n    ("One "  # note\n     r"two");\n\ndef g(): "On " \\\n  "a line"; x = 1\n', [("f", "One two"), ("g", "On a line")]),
    "quotes within fields": ('class Cache:\n    x = f"{"#(".join(y):{">"}{3}}"\n\nif x:\n    def f(a=f"{b!r:\'^3}"):\n        """Told."""\n', [("f", "Told.")]),
    "a mark and carriage returns": ('\ufeffdef f():\r\n    """One\r\n    two."""\r\n', [("f", "One\ntwo.")]),
    "an open bracket ends at a statement": ("class Cache:\n    x = (1,\n\nimport y\nif y:\n    def f():\n        'Told.'\n", [("f", "Told.")]),
    "documentation never closed": ('class K:\n    def cut(self):\n        """Starts\n        return 1\n\n    @deco\n    def g(self):\n        """Told."""\n', [("K.cut", "Starts\nreturn 1"), ("K.g", "Told.")]),
    "a string never closed": ('x = """open\n\ndef f():\n    """\n    Told.\n    """\n', [("f", "Told.")]),
    "fields never closed": ('x = f"{a("\ndef f():\n    "Told."\n', [("f", "Told.")]),
}


@pytest.mark.parametrize("source", SOURCES)
def test_python_bodies_and_water(source):
    text, expected = SOURCES[source]
    assert [(q, d) for q, _, d, _ in D.python_islands(text)] == expected


def test_definitions_equal_the_syntax_tree():
    """Place, end, annotations and documentation of each function of the package."""
    for path in sorted(Path(D.__file__).parents[1].rglob("*.py")):
        text = path.read_text()
        nodes = sorted((n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda n: n.lineno)
        got = D.python_definitions(text)
        assert [(i.line, i.end_line, i.annotations) for i in got] == [(n.lineno, n.end_lineno, tuple(ast.get_source_segment(text, d) for d in n.decorator_list)) for n in nodes], path
        assert [i.documentation for i in got] == [ast.get_docstring(n) for n in nodes] or "\\" in text, path


def test_a_statement_ends_the_class_whose_words_are_known(spark):
    """The function isn't the class's, so the class's name in its documentation tells something."""
    text = SOURCES["a statement closes a class"][0]
    symbols = spark.createDataFrame([(1, 1, "a.py", 5, "load", "function", "load", "def load()", "Cache.")], SYMBOLS)
    files = spark.createDataFrame([(1, 1, "a.py", "python", text)], "file_id bigint, repo_id int, path string, language string, content string")
    assert [r.symbol_id for r in D.documented_symbols(symbols, files).collect()] == [1]


SYMBOLS = "symbol_id bigint, repo_id int, file_path string, start_line int, name string, type string, qualified_name string, signature string, docstring string"


def test_rows(spark):
    good = "Blocks until the queue is empty."
    rows = [(1, 1, "f", "function", "f", "def f()", good), (1, 1, "f", "function", "f", "def f()", good), (2, 1, "g", "method", None, None, good), (3, 1, "h", "class", "h", None, good), (4, 1, "k", "function", "k", "def k()", None), (5, 1, "k", "function", "k", "def k()", "k"), (None, 1, "z", "function", "z", "def z()", good), (6, None, None, "function", None, None, good * 5000)]
    df = clashing(spark.createDataFrame([(*r[:2], "s.py", 1, *r[2:]) for r in rows], SYMBOLS))
    assert sorted(r.symbol_id for r in D.documented_symbols(df).collect()) == [1, 2, 6]
    assert D.documented_symbols(df.limit(0)).count() == 0
    files = spark.createDataFrame([(1, "a.py", None, f'def f():\n    """{good}"""\n'), (2, "a.txt", None, "x"), (3, None, "Python", None), (4, "b.ts", None, f"/** {good} */\nfunction q() {{}}\n")], "file_id bigint, path string, language string, content string")
    assert {(r.file_id, r.qualified_name, r.language) for r in D.documented_functions(files).collect()} == {(1, "f", "python"), (4, "q", "typescript")}


def test_islands_of_files_decide(spark):
    """A symbol without signature takes the words of its island's; where the island is missing or documents otherwise, its own docstring decides."""
    files = [(1, 1, "a.py", None, 'def load(radius):\n    """Loads the radius."""\n\n\ndef keep(x):\n    """Blocks until\n        it is empty."""\n'), (1, 1, "a.py", None, 'def load(radius):\n    """Loads the radius."""\n'), (2, 2, "a.py", "Python", None), (3, None, None, None, "x = 1\n")]
    rows = [
        (1, 1, "a.py", 1, "load", "function", "load", None, "Loads the radius."), (2, 1, "a.py", 5, "keep", "function", "keep", "def keep(x)", "Blocks until\nit is empty."),
        (3, 2, "a.py", 1, "load", "function", "load", None, "Loads the radius."), (4, 1, "a.py", 1, "load", "function", "load", None, "Waits for a lock."), (5, None, None, None, "f", "method", None, None, "Waits for a lock."),
    ]
    symbols = clashing(spark.createDataFrame(rows, SYMBOLS))
    sources = clashing(spark.createDataFrame(files, "file_id bigint, repo_id int, path string, language string, content string"))
    assert {r.symbol_id for r in D.documented_symbols(symbols, sources).collect()} == {2, 3, 4, 5}
    assert {r.symbol_id for r in D.documented_symbols(symbols).collect()} == {1, 2, 3, 4, 5}
    assert {r.symbol_id for r in D.documented_symbols(symbols, sources.limit(0)).collect()} == {1, 2, 3, 4, 5}
