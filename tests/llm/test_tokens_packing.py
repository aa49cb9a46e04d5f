import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import packing as K
from newsloom.llm import tokens as T

SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def enc():
    return T.encoder(T.default_vocabulary())


@given(st.text(max_size=400) | st.text(alphabet="ab 1'.\n \té中ก้s", max_size=300))
@settings(max_examples=300, deadline=None)
def test_closed_positions_are_exact(text):
    e = T.encoder(T.default_vocabulary())
    parts = T.split_closed(text)
    if parts:
        assert "".join(parts) == text
        assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


def test_cuts_depend_on_content_only():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdef ghi. ") for _ in range(9000))
    a, b = T.cuts([shared, "xyz" * 33 + shared])
    assert set(x + 99 for x in a) <= set(b) and len(a) > 5
    assert T.cuts(["", "a"]) == [[], []]


def test_corpus(spark, enc):
    rng = random.Random(3)
    passage = " ".join(rng.choice(["river", "rose", "über", "桥没了。", "don't", "12,5", "  ", "\n"]) for _ in range(3000))
    texts = [passage, "start " + passage, passage[5000:] + passage, "a" * 5000, "", None, " ", "<|endoftext|>", "中" * 4000, "🧯" * 900, passage]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, passage, "clash"), (None, "no id", "x"), (None, "no id", "x")]
    got = T.encode_corpus(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: list(r.ids) for r in got if r.doc_id is not None}
    assert by == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert [list(r.ids) for r in got if r.doc_id is None] == [enc.encode_ordinary("no id")] * 2 and len(got) == len(texts) + 2
    assert T.encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_chunk_is_salted(spark, enc, monkeypatch):
    monkeypatch.setattr(T, "SALT_EVERY", 1)
    df = spark.createDataFrame([(i, "the same text again and again", "") for i in range(50)], SCHEMA)
    assert {tuple(r.ids) for r in T.encode_corpus(df).collect()} == {tuple(enc.encode_ordinary("the same text again and again"))}


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        value = np.r_[0.0, rng.random(12) * (rng.random(12) > 0.4)]
        counts = K.knapsack(value)
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [best[c - s] + value[s] for s in range(1, c + 1)])
        assert counts @ np.arange(13) <= 12 and abs(counts @ value - best[12]) < 1e-9


def check(df, sizes, capacity):
    rows = df.toPandas()
    assert rows.groupby("container_id").n_tokens.sum().max() <= capacity
    assert not rows.duplicated(["container_id", "position"]).any() and not rows.duplicated(["doc_id", "piece_no"]).any()
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == {k: n for k, n in sizes if n}
    split = rows.groupby("doc_id").size()
    assert all(n > capacity for k, n in sizes if split.get(k, 0) > 1)
    for r in rows.itertuples():
        assert r.token_start == r.piece_no * capacity
    return rows.container_id.nunique()


def test_pack(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(0, 900, 3000))] + [(5000, 2048), (5001, 4096), (5002, 4097), (5003, 2047)]
    n = check(K.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), shard_items=1000), sizes, 2048)
    assert n <= 1.01 * sum(s for _, s in sizes) / 2048 + 4
    same = [(i, 1025) for i in range(50)]
    assert check(K.pack(spark.createDataFrame(same, "doc_id bigint, n_tokens int")), same, 2048) == 50
    assert K.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0
    assert K.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens int")).count() == 0


def test_sizes(spark, enc):
    df = spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (2, "", ""), (3, None, ""), (None, "x", ""), (None, "y z", "")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in K.token_sizes(df).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_cover_and_bound():

    demand = np.zeros(65, dtype=np.int64)
    for size, n in ((40, 30), (24, 50), (20, 10), (7, 90), (64, 4)):
        demand[size] = n
    got = K.solve(demand, rounds=600)
    made = sum(n * counts for counts, n in got.patterns)
    assert all(int(counts @ np.arange(65)) <= 64 for counts, _ in got.patterns) and (made <= demand + 1e-6).all()
    assert demand @ np.arange(65) / 64 <= got.bound + 1e-9 <= got.value + 2e-9 and got.gap < 0.1  # 30 of 40+24, 20 of 24, ...
    assert made.sum() >= 0.9 * demand.sum()
    assert K.solve(np.zeros(5, dtype=np.int64)).patterns == []
    with pytest.raises(ValueError):
        T.encoder("/nowhere/other_vocabulary.tiktoken")


def test_reuse(spark):
    text = "the river rose by two metres in a night and fell again. " * 60
    r = T.reuse(spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id bigint, text string")).collect()[0]
    assert r.n_chars == 2 * len(text) and 0.4 < r.reused_share < 1 and r.n_distinct < r.n_chunks
    assert T.reuse(spark.createDataFrame([], "doc_id bigint, text string")).collect()[0].n_chunks == 0
