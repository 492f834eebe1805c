"""Encoding against the public library, packing against its promises."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import encoding as E
from vellum.llm import packing as P

tiktoken = pytest.importorskip("tiktoken")
RANKS = E.read_ranks(E.vocabulary_path())
LIBRARY = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BYTES = {v: k for k, v in RANKS.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_equals_library(text):
    got = E.Encoder(RANKS).ids(text)
    assert got == LIBRARY.encode_ordinary(text)
    assert b"".join(BYTES[i] for i in got) == text.encode()


def test_long_pieces():
    rnd = random.Random(1)
    for text in ("a" * 30000, "ab" * 9000, "".join(rnd.choice("三百𡨸ấ") for _ in range(6000)), " " * 5000, "<|endoftext|>"):
        assert E.Encoder(RANKS).ids(text) == LIBRARY.encode_ordinary(text)


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (3, "百 trăm", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in E.encode(df).collect()]
    assert got == [(1, []), (2, []), (3, LIBRARY.encode_ordinary(" ")), (3, LIBRARY.encode_ordinary("百 trăm")), (None, LIBRARY.encode_ordinary("x"))]
    assert E.encode(df.limit(0)).count() == 0


def test_boundaries_are_optimal():
    rnd = np.random.default_rng(2)
    counts = np.zeros(15, dtype=np.int64)
    counts[1:] = rnd.integers(0, 5, 14)
    counts[14] = 1
    from itertools import combinations

    def cost(bounds):
        return sum(int(counts[s]) * (min(b for b in bounds if b >= s) - s) for s in range(1, 15))

    best = min(cost((*c, 14)) for c in combinations(range(1, 14), 3))
    assert cost(P.boundaries(counts, 4)) == best
    assert P.boundaries(np.zeros(5, dtype=np.int64)) == []


def check(rows, sizes, capacity):
    by, docs = {}, {}
    for r in rows:
        assert 0 <= r.n_tokens <= capacity
        by[r.container_id] = by.get(r.container_id, 0) + r.n_tokens
        docs.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
    assert max(by.values()) <= capacity
    for d, n in sizes.items():
        parts = sorted(docs[d])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == n
        assert len(parts) == max(1, -(-n // capacity))
        assert all(p[1] == k * capacity for k, p in enumerate(parts))
    return len({c for c, n in by.items() if n})


def test_pack(spark):
    rnd = random.Random(5)
    for sizes, capacity in (({i: int(rnd.lognormvariate(4, 1.2)) for i in range(1500)}, 512), ({i: 7 for i in range(900)}, 64), ({1: 0, 2: 5000, 3: 100}, 100), ({1: 0}, 10), ({}, 10)):
        df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int")
        rows = P.pack(df, capacity=capacity, part=9).collect()
        if sizes:
            used = check(rows, sizes, capacity)
            if len(sizes) > 1000:
                assert used <= 1.03 * -(-sum(sizes.values()) // capacity)
        else:
            assert rows == []


def test_pack_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, 30), (1, 30), (None, 5), (2, None), (3, -4)], "doc_id long, n_tokens int")
    rows = P.pack(df, capacity=40, part=50).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == [(-1, 5), (1, 30), (1, 30), (2, 0), (3, 0)]
    by = {}
    for r in rows:
        by[r.container_id] = by.get(r.container_id, 0) + r.n_tokens
    assert max(by.values()) <= 40
