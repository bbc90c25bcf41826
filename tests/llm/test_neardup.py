from __future__ import annotations

import random

import pytest

from codeloom.functions.tokens import TOKEN_RE
from codeloom.llm import neardup as N
from tests.conftest import clashing

SCHEMA = "chunk_id bigint, repo_id int, file_path string, start_line int, end_line int, qualified_name string, total_parts int, content string"


def corpus(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[7].split()
            for _ in range(rng.randrange(0, 14)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[3:] + text[:3]
        else:
            text = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        rows.append((i + 1, i % 3, f"f{i % 7}.py", i, i + 2, "f", 1, " ".join(text)))
    return rows


def gram_set(text: str, ngram: int) -> set[tuple[str, ...]]:
    tokens = TOKEN_RE.findall(text.lower())
    return set(zip(*(tokens[i:] for i in range(ngram))))


def brute(rows: list[tuple], threshold: float = 0.7) -> set[tuple[int, int]]:
    sets = {r[0]: gram_set(r[7], 3) for r in rows}
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and not (a[1] == b[1] and a[2] == b[2] and a[3] <= b[4] and b[3] <= a[4]):
                x, y = sets[a[0]], sets[b[0]]
                if len(x & y) >= threshold * len(x | y) - 1e-9:
                    out.add((a[0], b[0]))
    return out


def test_all_pairs_of_brute_force(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        found = N.similar_definitions(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {(r.chunk_id_a, r.chunk_id_b) for r in found} == brute(rows)
        assert len(found) == len(brute(rows))


def test_hot_grams_are_salted(spark, monkeypatch):
    """Every gram that two texts of the sample share is split over salts; pairs within and between salts are all counted."""
    rows = corpus(5)
    monkeypatch.setattr(N, "HOT_MEMBERS", 1)
    monkeypatch.setattr(N, "HOT_SEEN", 2)
    monkeypatch.setattr(N, "BLOCK_GRAMS", 400)
    found = N.similar_definitions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.chunk_id_a, r.chunk_id_b) for r in found} == brute(rows) and len(found) == len(brute(rows))


def test_similarity_is_the_sum_over_segments(spark):
    rows = corpus(6)
    sets = {r[0]: gram_set(r[7], 3) for r in rows}
    for r in N.similar_definitions(spark.createDataFrame(rows, SCHEMA)).collect():
        x, y = sets[r.chunk_id_a], sets[r.chunk_id_b]
        assert abs(r.similarity - len(x & y) / len(x | y)) < 1e-9


def test_groups_are_components_of_the_pairs(spark):
    rows = corpus(2)
    rows += [(1000 + i, 5, f"g{i % 4}.py", 1, 9, "f", 1, rows[i % 3][7]) for i in range(9)]  # copies, some over the same lines
    rows += [(2000, 9, "only.py", 1, 9, "f", 1, "q " * 50), (2001, 9, "only.py", 2, 8, "f", 1, "q " * 50)]  # overlap and nothing else
    pairs = brute(rows)
    links, label = {}, {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.chunk_id: (r.group_id, r.links) for r in N.definition_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (label[k], links[k]) for k in links}


def test_fragments_don_t_change_the_result(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(N, "FRAGMENT_GRAMS", 50)
    found = N.similar_definitions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.chunk_id_a, r.chunk_id_b) for r in found} == brute(rows)


@pytest.mark.parametrize("salt_members", [1000, 2])
def test_copies_and_edges(spark, monkeypatch, salt_members):
    monkeypatch.setattr(N, "SALT_MEMBERS", salt_members)
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(i, 1, f"{i}.py", 1, 9, "f", 1, text.upper() if i % 2 else text) for i in range(1, 6)]
    rows += [(6, 1, "1.py", 2, 3, "f", 1, text), (6, 1, "1.py", 2, 3, "f", 1, text), (7, 1, "7.py", 1, 9, None, 1, text), (8, 1, "8.py", 1, 9, "f", 2, text), (9, 1, "9.py", 1, 9, "f", 1, "short text"), (10, 1, "10.py", 1, 9, "f", 1, None), (None, 1, "11.py", 1, 9, "f", 1, text), (12, None, None, None, None, "f", 1, text), (13, 1, "13.py", 1, 9, "f", 1, "")]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    found = {(r.chunk_id_a, r.chunk_id_b) for r in N.similar_definitions(df).collect()}
    ids = [1, 2, 3, 4, 5, 6, 12]
    assert found == {(a, b) for a in ids for b in ids if a < b} - {(1, 6)}  # 1 and 6 overlap in one file
    groups = N.definition_groups(df).collect()
    assert {r.group_id for r in groups} == {1} and len(groups) == 7
    assert N.similar_definitions(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)]
    out = {r.node: r.component for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert all(out[i] == 1 for i in range(1, 41)) and {out[100], out[101], out[102]} == {100}


def test_unfinished_components_are_an_error(spark):
    with pytest.raises(RuntimeError):
        N.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint"), "a", "b", rounds=1)
