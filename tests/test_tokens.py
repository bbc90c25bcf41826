from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions.blocks import blocks
from codeloom.functions.tokens import TOKEN_RE, code_points, column_token_counts, token_counts, token_ends, token_hashes, token_starts

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB_1 \n\t.(é漢ー  😀'\"", max_size=30)), max_size=12)


@settings(deadline=None)
@given(TEXTS)
def test_counts_agree_with_the_regular_expression(texts):
    expected = [len(TOKEN_RE.findall(t or "")) for t in texts]
    assert token_counts(texts).tolist() == expected
    assert column_token_counts(pa.array(texts, pa.string())).tolist() == expected
    assert column_token_counts(pa.array([None, *texts], pa.string()).slice(1)).tolist() == expected


@settings(deadline=None)
@given(TEXTS)
def test_tokens_and_hashes(texts):
    points, offsets = code_points(texts)
    starts = token_starts(points)
    ends = token_ends(points, starts)
    joined = "".join(map(chr, points.tolist())) if len(points) else ""
    tokens = [joined[a:b] for a, b in zip(starts, ends)]
    assert tokens == TOKEN_RE.findall(joined)
    hashes = token_hashes(points, starts, ends).tolist()
    assert len(set(zip(tokens, hashes))) == len(set(tokens)) == len(set(hashes))


def test_blocks_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * (i * 7 % 50) if i % 9 else None for i in range(100)])], ["i", "t"])
    out = list(blocks(iter([batch, batch.slice(0, 0)]), "t", 60))
    assert np.concatenate([b.column("i").to_numpy() for b in out]).tolist() == list(range(100))
    assert len(out) > 10
