from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.functions.repair import Grammar
from codeloom.llm import generated as G
from codeloom.llm import leakage as L
from codeloom.llm import qa_defects as Q
from codeloom.llm import residue as R
from tests.conftest import clashing

# --- generated files -------------------------------------------------------------------------------------------


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=40), min_size=1, max_size=5))
def test_grammars_derive_their_sequences(sequences):
    flat = np.array([x for s in sequences for x in s], np.uint64)
    bounds = np.cumsum([0, *map(len, sequences)])
    g = Grammar(flat, bounds)
    assert (g.final <= g.length).all() and (g.uses >= 2 * g.rules).all() and (g.covered <= g.length).all()
    assert (g.length - g.uses == g.final).all()  # every use of a rule shortens its sequence by one
    alone = [Grammar(np.array(s, np.uint64), np.array([0, len(s)])) for s in sequences]
    assert [int(a.final[0]) for a in alone] == g.final.tolist()  # sequences don't touch each other


def test_repetition_shows():
    rng = np.random.default_rng(0)
    noise, same = rng.integers(0, 2**60, 300).astype(np.uint64), np.tile(np.arange(10, dtype=np.uint64), 30)
    g = Grammar(np.concatenate((noise, same)), np.array([0, 300, 600]))
    assert g.ratio()[0] == 1 and g.ratio()[1] <= 0.2 and g.covered[1] == 300


HAND = '"""Generator of stubs; every output starts with an auto-generated banner."""\nimport os\n\nBANNER = "# Code generated by a tool. DO NOT EDIT."\n# hand-tuned table, not generated: please edit with care\nTABLE = [1, 2, 3]\n\n\ndef emit(name):\n    """Writes the banner and the name."""\n    return BANNER + name + str(TABLE[0])\n'
UNWRITTEN = [
    ("a.py", "# Code generated by toolx v1.2; DO NOT EDIT.\nx = 1\n", "generated"), ("a.py", "# @generated from a/b.proto\nx = 1\n", "generated"), ("a.ts", "// This file was written by toolx. Changes will be lost at the next run.\nlet a = 1\n", "generated"), ("a.py", "# <auto-generated tool=x />\nx = 1\n", "generated"),
    ("vendor/a/b.py", HAND, "vendored"), ("lib/left-pad-1.3/b.js", "let a = 1", "vendored"), ("utils/a.py", "# Copy of libx/a.py at release 1.1\n# Upstream authors keep all rights.\nx = 1\n", "vendored"), ("a.js", "/*! libx 3.1.4 */\nlet a = 1\n", "vendored"), ("compat/a.py", "# libx - things\n# Bundled with this project; report problems to the libx maintainers.\nx = 1\n", "vendored"),
    ("a.js", "!function(e,t){" + "".join(f"var a{i}=function(o){{return n.f({i})+t}};" for i in range(60)) + "}(this,1);", "minified"),
    ("t.py", "T = [\n" + "".join(f"  0x{i * 7919 % 65536:04x}, {i * 31 % 251},\n" for i in range(90)) + "]\n", "data"),
    ("static/b.js", "(() => {\n  var mods = {\n" + "".join(f"    {i}: (module, exports, load) => {{\n      exports.f{i} = load({i % 7}).g{i};\n    }},\n" for i in range(30)) + "  };\n})();\n", "generated"),
]


def test_unwritten_files(spark):
    rows = [(i + 1, i % 3, path, text) for i, (path, text, _) in enumerate(UNWRITTEN)]
    rows += [(100, 1, "generated_by_x.py", HAND), (100, 1, "generated_by_x.py", HAND), (101, 1, "min_x.js", "let a = 1\n"), (102, 1, None, None), (103, 1, "vendors/a.py", HAND), (None, 1, "vendor/a.py", HAND), (104, 1, "__init__.py", ""), (105, None, "outbuild/dist_x.py", HAND)]
    rows += [(106, 1, "log.py", "".join(f"2031-02-17 17:5{i} INFO done id={i}\n" for i in range(9)))]  # no code at all: it doesn't parse, which is problem 4
    df = clashing(spark.createDataFrame(rows, "file_id bigint, repo_id int, path string, content string"))
    got = {r.file_id: r["kind"] for r in G.unwritten_files(df.drop("kind")).collect()}
    assert got == {i + 1: kind for i, (_, _, kind) in enumerate(UNWRITTEN)}
    assert G.unwritten_files(df.limit(0)).count() == 0


def test_what_the_grammar_decides(spark):
    """Without grammars, bundles and data are lost; without marks, what reads like any other code is."""
    rows = [(i, i % 3, path, text) for i, (path, text, _) in enumerate(UNWRITTEN)]
    df = spark.createDataFrame(rows, "file_id bigint, repo_id int, path string, content string")
    kinds = {i: kind for i, (_, _, kind) in enumerate(UNWRITTEN)}
    alone = {r.file_id: r["kind"] for r in G.unwritten_files(df, marks=False).collect()}
    without = {r.file_id: r["kind"] for r in G.unwritten_files(df, grammars=False).collect()}
    data, bundle = (next(i for i, k in kinds.items() if UNWRITTEN[i][0] == name) for name in ("t.py", "static/b.js"))
    assert alone[data] == "data" and alone[bundle] == "generated" and not {data, bundle} & set(without)
    assert not any(kinds[i] == "vendored" for i in alone) and {**without, **alone}.keys() == kinds.keys()


def test_rules_shared_across_repositories(spark):
    """A file with many long rules that all occur in another repository is a copy; with rules of its own it isn't."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))

    def library() -> str:
        phrases = [" ".join(word() for _ in range(12)) for _ in range(60)]
        order = phrases * 2
        rng.shuffle(order)
        return "\n".join(f"{p} ({word()})" for p in order)

    copied, own = library(), library()
    rows = [(1, 1, "a.py", copied), (2, 2, "b.py", copied + "\nx = 1\n"), (3, 3, "c.py", own), (4, 3, "d.py", own), (5, None, "e.py", own)]
    got = {r.file_id: (r.kind, r.decided) for r in G.unwritten_files(spark.createDataFrame(rows, "file_id bigint, repo_id int, path string, content string")).collect()}
    assert got == {1: ("vendored", "shared"), 2: ("vendored", "shared")}


def test_whole_heads_are_read():
    notice = "".join(f"# line {i} of a long licence\n" for i in range(60))
    assert G.by_marks("a.py", notice + "# Code generated by toolx. DO NOT EDIT.\nx = 1\n", 9, 1.0)[0] == "generated"


def test_shared_rules_support_weak_marks(spark):
    body = "# Copyright 2020 Ann Other\n" + "".join(f"def f{i}(a, b):\n    check(a, b, strict=True)\n    return combine(a, b, {i})\n\n\n" for i in range(4))
    rows = [(1, 1, "a.py", body), (2, 2, "b.py", body), (3, 3, "c.py", body.replace("check(a, b, strict=True)", "verify(b, mode=a)").replace("combine", "merge"))]
    got = {r.file_id: r.kind for r in G.unwritten_files(spark.createDataFrame(rows, "file_id bigint, repo_id int, path string, content string")).collect()}
    assert got.get(1) == got.get(2) == "vendored"


# --- question and answer pairs -----------------------------------------------------------------------------------

QUESTION = "Where is fill_roster defined?"
PAIRS = [
    (QUESTION, None, "empty"), (QUESTION, "", "empty"), (QUESTION, " \n​", "empty"), (QUESTION, "N/A", "empty"), (QUESTION, "**Answer**\n\n", "empty"), (QUESTION, "<answer></answer>", "empty"), (QUESTION, "(no response)", "empty"), (QUESTION, "```\n```", "empty"), (QUESTION, "...", "empty"),
    (QUESTION, "WHERE IS FILL_ROSTER DEFINED?", "copy"), (QUESTION, "Q: Where is `fill_roster` defined?", "copy"), (QUESTION, "You asked: Where is fill_roster defined?", "copy"), (QUESTION, "> Where is fill_roster defined? Where is fill_roster defined?", "copy"),
    (QUESTION, "I'm sorry, but I can't help with that.", "refusal"), (QUESTION, QUESTION + "\n\nI must decline to describe fill_roster.", "refusal"), ("Wo ist a_b definiert?", "Tut mir leid, dabei kann ich nicht helfen.", "refusal"),
    (QUESTION, "fill_roster está en el paquete a_b y la llama QuietTower.", "wrong_language"), (QUESTION, "漢字仮名交文漢字仮名。", "wrong_language"), ("¿Dónde está definida a_b?", "a_b está no pacote c_d e é chamada por QuietTower. Desde a versão 2 a função não é mais chamada.", "wrong_language"),
    (QUESTION, "fill_roster is defined in the core package and called from X. The step reads each b", "truncated"), (QUESTION, "It is here:\n\n```python\nx = 1", "truncated"), (QUESTION, "It is called twice. [a/b.py:12-", "truncated"), (QUESTION, "Three places exist.\n- a.py\n- ", "truncated"), (QUESTION, "It moves. The callers are:", "truncated"), (QUESTION, "It works. For example,", "truncated"),
    (QUESTION, "fill_roster is defined in the core package. [a/b.py:12-14]", None), (QUESTION, "`core/a.py`", None), (QUESTION, "a.x, b.y and c.z", None), (QUESTION, "Three places:\n- a.py\n- b.py", None), (QUESTION, "No. The bin refuses unsigned input, so fill_roster never sees it.", None), (QUESTION, "Sorry for the wait: fill_roster is called by X and by nothing else.", None),
    (QUESTION, 'fill_roster raises XError with the text "I cannot help with that" whenever it is open.', None), (QUESTION, "I cannot see a second caller: fill_roster is used in x.py only.", None), (QUESTION + " Please answer in Spanish.", "fill_roster está en el paquete a_b y la llama QuietTower.", None), (QUESTION, "It is here.\n\n```python\nx = f(1)\n```", None),
]


@pytest.mark.parametrize(("query", "response", "expected"), PAIRS)
def test_defects(query, response, expected):
    assert Q.defect(query, response) == expected


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        ("It is here:\n\n```python\nx = f(1,\n```", True), ("It is here:\n\n```js\nf(this.#x, `a(`, {\n```", True), ('So:\n\n```python\nx = ["a"]\ny = """b\n```', True), ("It is called twice (once by X in the core package. Then by Y.", True), ("It moves rows.\n- a (see b.", True),
        ("It is here:\n\n```python\nx = f(1)  # don't (\n```", False), ("It is here:\n\n```js\nf(this.#x); // can't (\n```", False), ("Run:\n\n```text\na) it's (\n```", False), ("See a:\n\n```python\nf(\n```\n\nIt ends there.", False), ("Sad :( but any x in (0, 1] is kept.", False), ("1) It opens with `(` and '['.\n2) It's done.", False),
    ],
)
def test_delimiters(response, expected):
    assert Q.is_truncated(response) is expected


@settings(deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12), st.integers(1, 4))
def test_suffix_automaton(text, words, least):
    expected = [any(any(words[a:b] == text[k : k + b - a] for k in range(len(text))) for a in range(i + 1) for b in range(i + 1, len(words) + 1) if b - a >= least) for i in range(len(words))]
    assert Q.SuffixAutomaton(text).copied(words, least) == expected


def test_pairs(spark):
    rows = [(1, QUESTION, None), (1, QUESTION, None), (2, QUESTION, "`a.py`"), (3, None, "I can't help with that."), (4, None, None), (None, QUESTION, None), (5, "", ""), (6, QUESTION, "It moves on. " + "word " * 60_000)]
    df = clashing(spark.createDataFrame(rows, "id int, query_text string, response_text string"))
    assert {(r.id, r.defect) for r in Q.defective_pairs(df).collect()} == {(1, "empty"), (3, "refusal"), (4, "empty"), (5, "empty"), (6, "truncated")}
    assert Q.defective_pairs(df.limit(0)).count() == 0


# --- leaks ---------------------------------------------------------------------------------------------------------


def shared(a: str, b: str, run: int) -> bool:
    x, y = L.words_of(a), L.words_of(b)
    windows = {tuple(x[i : i + run]) for i in range(len(x) - run + 1)}
    return any(tuple(y[i : i + run]) in windows for i in range(len(y) - run + 1))


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))) for i in range(12)] + [(3, "again " * 9), (None, "w1 " * 9), (20, None)]
    documents = [(i, " ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    documents += [(100, "x " + items[5][1].upper().replace(" ", "\n> ") + " y"), (100, "x " + items[5][1].upper().replace(" ", "\n> ") + " y"), (101, None), (102, ""), (None, items[5][1]), (103, items[6][1].replace(" ", "_")), (104, "again " * 40)]
    run = 5
    expected = {(d, i) for d, t in documents for i, s in items if d is not None and i is not None and shared(s or "", t or "", run)}
    df, ev = clashing(spark.createDataFrame(documents, "doc_id bigint, text string")), clashing(spark.createDataFrame(items, "item_id int, text string"))
    for words in (L.BLOCK_WORDS, 20):
        assert {(r.doc_id, r.item_id) for r in L.leaked_spans(df, ev, run, words).collect()} == expected
    monkeypatch.setattr(L, "SHARD_BYTES", 300)
    spans = L.leaked_spans(df, ev, run).collect()
    assert {(r.doc_id, r.item_id) for r in spans} == expected and all(r.words >= run for r in spans)
    assert [(r.first_word, r.words) for r in spans if r.doc_id == 104] == [(0, 40)]
    assert L.leaks(df.limit(0), ev, run).count() == 0 and L.leaks(df, ev.limit(0), run).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 6), min_size=2, max_size=2), min_size=1, max_size=6))
def test_fm_index(text, phrases):
    index = L.FMIndex(np.array(text))
    low, high = index.search(np.array(phrases) if max(map(max, phrases)) <= max(text) else np.minimum(np.array(phrases), max(text)))
    for (a, b), p in zip(zip(low, high), np.minimum(np.array(phrases), max(text))):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 1) if text[i : i + 2] == p.tolist()]


def test_refusals_by_what_stands_beside_them():
    asked = "What would break if I changed the even estate? Who calls the mixed parcel? Why is the queue full?"
    assert Q.is_refusal(asked + " Noted. I must decline to say more.", asked)  # the fifth sentence; all before it is the question
    assert not Q.is_refusal(asked + " I must decline to say more.", "Is it open?")  # without the automaton these sentences would count as an answer
    assert not Q.is_refusal("I can't help with the first part. The second one is simple: the reader opens every page, counts its rows and hands them to the writer.", asked)


@pytest.mark.parametrize(("query", "response", "wrong"), [
    ("Quelles fonctions appellent x ?", "Hay tres funciones que llaman a x, casi todas en el mismo lugar.", True), ("Quelles fonctions appellent x ?", "Il y en a trois, la plupart dans le même endroit.", False),
    ("Quais funções chamam x?", "Es gibt drei davon, die meisten in einem anderen Teil.", True), ("Who calls x?", "It is called by y and by nothing else.", False),
])
def test_function_words_vote(query, response, wrong):
    assert Q.is_wrong_language(query, response) is wrong


# --- residue -------------------------------------------------------------------------------------------------------

RESIDUE = [
    "# {{ name }}\n\nTests cover the path; the branch still needs a cell.", "Welcome to ${project}, the home of __OWNER__.", "Hello [your team name], your order <YOUR ID> is ready.", "Maintained by %(owner)s since {% date %}.", "undefined\n\nnull\n\n[object Object] - x", "Lorem ipsum dolor sit amet elit sed tempus ferat velo dolor.", "Your text here.\n\nBlah blah blah.", "# tool\n\n## Overview\n\nTBD\n\n## Usage\n\nExplain how to use it.\n",
    "Page not found. The address may have changed. (a.b.example)", "503 Service Unavailable\n\nnginx/1.2", 'Traceback (most recent call last):\n  File "/srv/a.py", line 7, in f\nValueError: no', "Fatal error: could not render page 'x' in /var/www/a.tpl on line 3", "You need to enable JavaScript to run this app.", "Access denied. Sign in to a.example to read this page.", "Checking your browser before accessing a.example ... this takes 5 seconds.", "Session expired. Log in again to continue.", "Seite nicht gefunden. Bitte aktivieren Sie JavaScript.",
]
CONTENT = [
    "", "ok", "The engine replaces `{{ name }}` with the title; leave the braces alone in a.html.", 'A missing row must answer "404 Not Found" and log it, while the reader retries a 503 only once.', "Our linter flags the words lorem ipsum in fixtures and any `${NAME}` left in a readme.", "Write TODO(me) next to code that helper should take over, never [INSERT NAME] in a heading.", "# x\n\n```html\n<h1>{{ a.b }}</h1>\n{% for b in c %}\n```\n\nIt took 5 minutes to trim the graph.",
    "We moved parse out of `x.py` because two modules imported each other. It took 5 minutes.\n\nPlease enable JavaScript to view the comments.", "Callers of f should expect ValueError, not a bare list.\n\n```\nTraceback (most recent call last):\n  File \"a.py\", line 1\nValueError: x\n```", "Every row carries an id and a line range.\n\n> Page not found.\n\nError loading sidebar.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert R.residue(text) is not None


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert R.residue(text) is None


@pytest.mark.parametrize(
    "text",
    ["The page could not be found.", "The requested URL cannot be found on a.example.", "This file can't be found.", "The resource could not be loaded.", "You must be signed in to read this.", "You must be logged in.", "You don't have access.", "nginx/10.2", "jk jk jk", "# x\n\nlkj hjkl"],
)
def test_residue_without_common_words(text):
    assert R.residue(text) is not None


@pytest.mark.parametrize("pattern", [*R._ERROR, *R._NOTICE, *R._STUB, R.SLOT.pattern])
def test_matching_sentences_are_hinted(pattern):
    expression = re.compile(pattern if pattern == R.SLOT.pattern else r"\W*(?:" + pattern + ")", 0 if pattern == R.SLOT.pattern else re.I)

    @settings(deadline=None, max_examples=10, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(expression, fullmatch=True))
    def check(sentence):
        assert R.hinted(sentence)

    check()


def test_hints_decide_nothing(monkeypatch):
    texts = [*RESIDUE, *CONTENT, "---\n\nAccess denied.", "2024-01-05\n\nSign `x` in.", "- `a`: NaN\n- at `b`"]
    before = [R.residue(t) for t in texts]
    monkeypatch.setattr(R, "hinted", lambda sentence: True)
    assert [R.residue(t) for t in texts] == before


def test_documents(spark):
    rows = [(i, t, "h") for i, t in enumerate(RESIDUE)] + [(100 + i, t, "h") for i, t in enumerate(CONTENT)] + [(0, RESIDUE[0], "h"), (500, None, None), (None, RESIDUE[0], "h"), (501, RESIDUE[8], None), (502, "word " * 50_000 + "\n{{ name }}", "h")]
    # a footer that recurs on a host is none of its content: what is left of 600 is a notice
    footer = "All pages of this site are kept by the people of the press office and its many friends since 2001."
    rows += [(600 + i, ("Access denied." if not i else f"Body {'abcdefgh'[i]} tells what the {'klmnopqr'[i]} module does with each row that it reads.") + "\n" + footer, "press") for i in range(7)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = {r.doc_id for r in R.residual_documents(df).collect()}
    assert got == {*range(len(RESIDUE)), 501, 502, 600}
    assert R.residual_documents(df.limit(0)).count() == 0


def test_recurrent_notices_are_subtracted(spark):
    """Notices below every page of a host are its boilerplate: without the counts all of these pages would be excluded, with them only what says nothing else."""
    below = "\nPlease enable JavaScript to view the comments.\nYou must sign in to leave a reply.\nSomething went wrong."
    rows = [(i, f"The {w} module reads rows.{below}", "talk") for i, w in enumerate("first second third fourth fifth sixth".split())]
    rows += [(10, below.strip(), "talk"), (11, "Error 503: service unavailable." + below, "talk"), (12, "Try {{ module_name }} now." + below, "talk")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in R.residual_documents(df).collect()} == {10, 11, 12}
    assert {r.doc_id for r in R.residual_documents(df, least=1000).collect()} == {r[0] for r in rows}


def test_copies_are_no_boilerplate(spark):
    sound = "Every row carries an id and a line range.\nThe reader retries a lost page once, and the writer never does so.\nPlease enable JavaScript to view the comments."
    footer = "All pages of this site are kept by the people of the press office and its many friends since 2001."
    rows = [(i, sound if i % 2 else "  " + sound.replace("\n", " \n") + "\n", "h") for i in range(12)] + [(0, sound, "h")] + [(20 + i, f"Body {'abcdefgh'[i]} tells what the module does.\n{footer}", "h") for i in range(5)] + [(40, "Access denied.\n" + footer, "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in R.residual_documents(df).collect()} == {40}
    assert R.residue("A page of the office.\n" + "One two three four five six seven.\n" * 2 + "Access denied.", {0}) is None  # a subtracted line leads all the same
