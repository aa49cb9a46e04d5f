import json

from newsloom.operators import drift as D

RECORDS = "line_id bigint, feed_id bigint, batch_no int, payload string"
ALIASES = [("item", "id", "id"), ("item", "id", "news_id"), ("item", "rewrite_versions", "rewrites"), ("item", "rewrite_versions", "top_rewrites"), ("entry", "final_rewritten_text", "final_text"), ("entry", "final_rewritten_text", "text")]


def frames(spark, files):
    lines = [(i, f, b, json.dumps(p) if not isinstance(p, (str, type(None))) else p) for i, (f, b, p) in enumerate(files)]
    return spark.createDataFrame(lines, RECORDS), spark.createDataFrame(ALIASES, "place string, canonical string, alias string")


def found(spark, *files):
    return {(r.feed_id, r.batch_no, r.drift, r.field_path) for r in D.drift(*frames(spark, files)).collect()}


def test_changes(spark):
    got = found(
        spark,
        (1, 1, {"id": 1, "rewrites": [{"text": "a", "score": 1}], "model_name": "m", "gone": 1, "same": None}),
        (1, 3, {"news_id": "x", "top_rewrites": [{"final_text": "a", "score": {"v": 1}}], "modelName": "m", "new": {"deep": 1}, "same": None}),
        (2, 1, {"a": 1}),
    )
    assert got == {
        (1, 3, "renamed", "news_id"), (1, 3, "retyped", "news_id"), (1, 3, "renamed", "top_rewrites"), (1, 3, "renamed", "top_rewrites[].final_text"),
        (1, 3, "retyped", "top_rewrites[].score"), (1, 3, "renamed", "modelName"), (1, 3, "removed", "gone"), (1, 3, "added", "new"),
    }


def test_elements_and_nulls(spark):
    assert found(spark, (1, 1, {"rewrites": [], "x": 1}), (1, 2, {"rewrites": [{"text": "a"}], "x": 2})) == set()
    assert found(spark, (1, 1, {"rewrites": ["a"]}), (1, 2, {"rewrites": [{"text": "a"}]})) == {(1, 2, "retyped", "rewrites[]")}
    assert found(spark, (1, 1, {"a": 1}), (1, 1, {"a": "x"}), (1, 2, {"a": 1})) == {(1, 2, "retyped", "a")}
    assert found(spark, (1, 1, None), (1, 2, "not json"), (1, 3, {})) == set()
    assert found(spark, (None, 1, {"a": 1}), (1, None, {"b": 1})) == set()


def test_empty(spark):
    records, aliases = frames(spark, [(1, 1, {})])
    for f in (D.drift, D.typed_items, D.typed_versions, D.cast_failures):
        assert f(records.limit(0), aliases.limit(0)).count() == 0


def test_typed_tables(spark):
    records, aliases = frames(spark, [(1, 1, {"news_id": 5, "attemptCount": "3", "rewrites": ["a", {"text": {"value": "b"}, "version_score": "2/3", "final_passed": "yes"}]}), (1, 1, "broken")])
    items = {r.line_id: r for r in D.typed_items(records.unionByName(records), aliases).collect()}
    assert items[0].id == "5" and items[0].attempt_count == 3 and items[1].id is None and len(items) == 2
    versions = D.typed_versions(records, aliases).orderBy("version_no").collect()
    assert [(v.final_rewritten_text, v.final_passed) for v in versions] == [("a", None), ("b", True)]
    assert {(r.column_name, r.reason) for r in D.cast_failures(records, aliases).collect()} == {("version_score", "string is not double"), ("payload", "no JSON object")}


def test_path_values(spark):
    r = D.path_values(frames(spark, [(1, 1, {"a": [{"b": 1}, {"b": "x"}]})])[0]).collect()[0]
    assert {p: (x.kind, x.value) for p, x in r["values"].items()} == {"a": ("array", None), "a[0]": ("object", None), "a[0].b": ("number", "1"), "a[1]": ("object", None), "a[1].b": ("string", "x")}


def test_records_survive_the_maps():
    record = {"a": [{"b": 1}, None, "x", []], "[1]": True, "c": {"[]": {}, "d": 0.5}, "none": None}
    assert D.rebuilt(D.path_value_map(record)) == {"a": [{"b": 1}, None, "x", []], "[1]": True, "c": {"[]": {}, "d": 0.5}}
    assert D.path_value_map(None) == D.path_value_map({}) == {} and D.path_value_map([1]) == {"[0]": ("number", 1)}


def test_rewrites_in_uneven_forms(spark):
    rows = [{"rewrites": {"text": "a"}}, {"rewrites": '[{"text": "b"}, "c"]'}, {"rewrites": "no json"}, {"rewrites": [{"text": "d"}]}]
    records = spark.createDataFrame([(i, 1, 1, json.dumps(r)) for i, r in enumerate(rows)], "line_id bigint, feed_id bigint, batch_no int, payload string")
    aliases = spark.createDataFrame([("item", "rewrite_versions", "rewrites"), ("entry", "final_rewritten_text", "text")], "place string, canonical string, alias string")
    got = sorted((r.line_id, r.version_no, r.final_rewritten_text) for r in D.typed_versions(records, aliases).collect())
    assert got == [(0, 1, "a"), (1, 1, "b"), (1, 2, "c"), (3, 1, "d")]
    assert D.typed_items(records, aliases).filter("line_id = 2").collect()[0].other_fields == {"rewrites": '"no json"'}
