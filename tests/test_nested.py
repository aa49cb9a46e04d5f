import json

from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.operators import nested as N

SCHEMA = "rec_table string, rec_id bigint, root string, within string, doc string"


def rows(spark, docs):
    df = spark.createDataFrame([("t", i, r, w, d) for i, (r, w, d) in enumerate(docs)], SCHEMA)
    return {(x.rec_id, x.parent_path, x.path) for x in N.label_nodes(df).collect()}


def test_uneven_forms(spark):
    inner = json.dumps([{"attempt": 1}, None, {"attempt": 2}])
    doc = {"rewritten_versions": {"segments": [None, {"history": inner}]}, "other": [{"x": 1}]}
    got = rows(spark, [(None, None, json.dumps(doc)), ("alignment", None, '[{"text": "a"}, null, {"text": "b"}]'), (None, "injected_versions", '{"injected_versions": {"v1": {"conflicts": {"candidates": [{"a": 1}]}}}, "conflicts": [{"b": 2}]}')])
    assert got == {
        (0, "$", "rewritten_versions[0]"),
        (0, "rewritten_versions[0]", "rewritten_versions[0].segments[1]"),
        (0, "rewritten_versions[0].segments[1]", "rewritten_versions[0].segments[1].history[0]"),
        (0, "rewritten_versions[0].segments[1]", "rewritten_versions[0].segments[1].history[2]"),
        (1, "$", "alignment[0]"),
        (1, "$", "alignment[2]"),
        (2, "$", "injected_versions.v1.conflicts[0]"),
        (2, "injected_versions.v1.conflicts[0]", "injected_versions.v1.conflicts[0].candidates[0]"),
    }


def test_null_empty_and_unreadable(spark):
    assert rows(spark, [(None, None, None), (None, None, ""), (None, None, "{"), (None, None, "[" * 5000), (None, None, "3"), (None, None, '{"tool_calls": "no json"}')]) == set()
    assert N.label_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_node_table_casts_and_extra_columns(spark):
    df = spark.createDataFrame([("t", 1, "alignment", None, '[{"sent_idx": 1, "text": "a"}, {"sent_idx": "x"}]', 7)], SCHEMA + ", path int")
    t = N.node_table(N.label_nodes(df), "alignment", {"sent_idx": "int", "text": "string"}).orderBy("pre").collect()
    assert [(r.sent_idx, r.text) for r in t] == [(1, "a"), (None, None)]


values = st.recursive(st.none() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["tags", "conflicts", "a"]), c, max_size=3), max_leaves=12)


@given(values)
@settings(max_examples=60, deadline=None)
def test_intervals_nest(value):
    nodes = N.label({"conflicts": value})
    for i, p in enumerate(N.link_by_containment(nodes)):
        around = [j for j, n in enumerate(nodes) if n[0] < nodes[i][0] and n[1] > nodes[i][1]]
        assert p == (max(around, key=lambda j: nodes[j][0]) if around else -1)


def test_arrays_of_scalars_and_plain_objects_are_kept(spark):
    doc = {"tool_calls": [{"node": "n", "input": {"ids": ["a", "é"], "deep": {"x": 1.5, "none": None}}, "tags": [{"tag_id": "t"}], "history": '[{"attempt": 1}]', "empty": [], "mixed": [1, {"y": 2}], "flag": True}]}
    got = {r.path: r for r in N.label_nodes(spark.createDataFrame([("t", 1, None, None, json.dumps(doc))], SCHEMA)).collect()}
    assert got["tool_calls[0]"].attrs == {"node": "n", "input.ids": '["a","é"]', "input.deep.x": "1.5", "empty": "[]", "mixed": '[1,{"y":2}]', "flag": "true"}
    assert set(got) == {"tool_calls[0]", "tool_calls[0].tags[0]", "tool_calls[0].history[0]", "tool_calls[0].mixed[1]"}
    flat = N.node_table(N.label_nodes(spark.createDataFrame([("t", 1, None, None, json.dumps(doc))], SCHEMA)), "tags", {"tag_id": "string"}).collect()[0]
    assert flat.parent_pre == got["tool_calls[0]"].pre and flat.pre == got["tool_calls[0].tags[0]"].pre


def test_unreadable_documents_are_reported(spark):
    docs = [None, "null", "{}", "", "{", '{"a": 1', "[" * 100000, "3"]
    df = spark.createDataFrame([("t", i, None, None, d) for i, d in enumerate(docs)], SCHEMA)
    assert {(r.rec_id, r.reason) for r in N.unreadable(df).collect()} == {(3, "not_json"), (4, "not_json"), (5, "not_json"), (6, "too_deep")}
