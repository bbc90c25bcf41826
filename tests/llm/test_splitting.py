from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions.tokens import TOKEN_RE
from codeloom.llm.splitting import oversized_ids, split_oversized, split_text
from tests.conftest import clashing

SCHEMA = "chunk_id bigint, content string, language string, overlap_header string, file_path string"


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab_ \n()[]{}'\"#é,;", max_size=400), st.sampled_from(["python", "javascript", None]), st.one_of(st.none(), st.just("def f(a):")), st.integers(12, 40))
def test_round_trip_and_limit(text, language, header, limit):
    pieces = split_text(text, language, header, limit, 4)
    assert "".join(text[a:b] for a, b, _, _ in pieces) == text
    for k, (a, b, overlap, tokens) in enumerate(pieces):
        assert tokens == len(TOKEN_RE.findall(overlap + text[a:b])) <= limit
        if k and header:
            assert overlap == header + "\n"
        if k and not header:
            assert len(TOKEN_RE.findall(overlap)) == min(4, len(TOKEN_RE.findall(text[:a])))


def test_cuts_lie_between_statements():
    body = "".join(f"    value_{i} = call({i},\n        {i})\n" for i in range(40))
    pieces = split_text("def f():\n" + body, "python", "def f():", 60)
    assert len(pieces) > 5
    for a, _, _, _ in pieces[1:]:
        assert ("def f():\n" + body)[a:].startswith("    value_")


def test_a_long_line_is_cut_between_tokens():
    text = " ".join(f"w{i}" for i in range(1000))
    pieces = split_text(text, None, None, 512, 32)
    assert [t for *_, t in pieces] == [512, 512, 40]


def test_edge_rows(spark):
    long = "x = 1\n" * 300
    rows = [(1, long, "python", None), (1, long, "python", None), (2, None, None, None), (3, "", None, "h"), (None, long, None, None), (4, "x " * 512, None, None), (5, "x " * 513, None, ""), (6, "y " * 600, None, "z " * 400)]
    df = clashing(spark.createDataFrame([(*r, None) for r in rows], SCHEMA))
    out = split_oversized(df).collect()
    assert {r.chunk_id for r in out} == {1, 5, 6}
    assert len([r for r in out if r.chunk_id == 1]) == len({r.piece for r in out if r.chunk_id == 1})
    assert all(r.token_count <= 512 and r.is_continuation == (r.piece > 1) for r in out)
    for i, text in ((1, long), (5, "x " * 513), (6, "y " * 600)):
        assert "".join(r.content[r.overlap_chars :] for r in sorted(out, key=lambda r: r.piece) if r.chunk_id == i) == text
    assert oversized_ids(df).count() == 3
    assert split_oversized(df.limit(0)).count() == 0


def test_a_null_language_is_told_by_the_path(spark):
    body = "function run() {\n" + "".join(f"  if (value_{i}) {{\n    call({i});\n  }}\n" for i in range(60)) + "}\n"
    df = spark.createDataFrame([(1, body, None, None, "a/b.js"), (2, body, "javascript", None, None), (3, body, None, None, None)], SCHEMA)
    cuts = {i: [r.start_char for r in split_oversized(df, 128, 8).where(f"chunk_id = {i}").orderBy("piece").collect()] for i in (1, 2)}
    assert cuts[1] == cuts[2] and len(cuts[1]) > 3
