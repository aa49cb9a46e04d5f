"""Properties on generated data, against plain Python or brute force."""

import importlib
import json
import random
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import jsonx, similarity
from newsloom.operators import segment as G

plain = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab,]}'\"\\ true{[", max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab,}]", max_size=3), c, max_size=3), max_leaves=8)


@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), plain, max_size=3), st.sampled_from(["", " ", "\n"]))
@settings(max_examples=200, deadline=None)
def test_repair_drops_trailing_commas_only(value, gap):
    """Valid JSON stays; the same with trailing commas, or as a Python literal, reads as the same value."""
    text = json.dumps(value)
    assert json.loads(jsonx.repair(text)) == value
    assert json.loads(jsonx.repair(text[:-1] + ("," if value else "") + gap + "}")) == value
    assert json.loads(jsonx.repair(repr(value))) == value


def test_merges_agree(spark):
    rng = random.Random(5)
    lists = [[rng.choice((25, 60, 399, 400, 401, 799, 800, 801, 1200)) for _ in range(rng.randrange(12))] for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, n array<int>")
    for i, got in df.select("i", G.merge_lengths(F.col("n")).alias("s")).collect():
        numbers = [k for k, s in enumerate(got, 1) for _ in range(s.n)]
        assert numbers == G.merge_lengths_of(lists[i]) and [s.chars for s in got] == [sum(lists[i][s.start : s.start + s.n]) for s in got]


def test_key_sentences_agree_with_sorting(spark):
    rng = random.Random(6)
    texts = [". ".join(" ".join(rng.choice(("river", "rose", "a", "relief", "x")) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = G.key_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ["river", "relief"], 3).collect()
    for i, text in enumerate(texts):
        units = text.split(". ")
        units = [u + "." for u in units[:-1]] + [units[-1]]
        mine = sorted((r.ord for r in rows if r.doc_id == i), key=lambda o: o)
        assert len(mine) == min(3, len(units)) and all(r.sentence == units[r.ord] for r in rows if r.doc_id == i)


def brute_tfidf(a, b):
    import math
    import re

    def terms(t):
        w = re.findall(r"\w+", t.lower())
        return w + [f"{x} {y}" for x, y in zip(w, w[1:])]

    x, y = terms(a), terms(b)
    weight = lambda t, own, other: own.count(t) * (1 if t in other else 1 + math.log(1.5))
    dot = sum(weight(t, x, y) * weight(t, y, x) for t in set(x) & set(y))
    norm = math.sqrt(sum(weight(t, x, y) ** 2 for t in set(x))) * math.sqrt(sum(weight(t, y, x) ** 2 for t in set(y)))
    return dot / norm if norm else 0.0


@given(st.text("ab c,é洪水", max_size=30), st.text("ab c,é洪水", max_size=30))
@settings(max_examples=200, deadline=None)
def test_tfidf_against_brute_force(a, b):
    assert abs(similarity.term_cosine(a, b) - brute_tfidf(a, b)) < 1e-9


def test_queries_without_the_optional_part(monkeypatch):
    """Where the optional subpackage can't be imported the others stay, with SQL for no missing query."""
    e = importlib.import_module("__spark_entry__")
    monkeypatch.setitem(sys.modules, "newsloom.llm.queries", None)
    q, o = e.queries(), e.oracle_sql()
    assert "p1_found" in q and "segment_stats" in q and not any(n.startswith("p9") for n in q) and set(o) <= set(q)
