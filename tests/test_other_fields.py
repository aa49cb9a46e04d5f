import json

from newsloom.operators import drift as D

ALIASES = [("item", "id", "id"), ("item", "id", "news_id"), ("item", "rewrite_versions", "rewrites"), ("entry", "final_rewritten_text", "text")]


def test_values_without_a_column_are_kept(spark):
    payloads = [
        {"id": 1, "overall_stats": {"n_calls": 3, "by": {"m": [1, 2]}, "none": None, "e": {}}, "rewrites": [{"text": {"value": "a", "unit": "u"}, "tone": "calm"}, 7, None]},
        {"news_id": 2, "id": 3, "OVERALL-STATS": {"nCalls": 4}, "overall_stats": {"n_calls": 5}},
    ]
    records = spark.createDataFrame([(i, 1, 1, json.dumps(p)) for i, p in enumerate(payloads)] + [(2, 1, 1, "broken")], "line_id bigint, feed_id bigint, batch_no int, payload string")
    aliases = spark.createDataFrame(ALIASES, "place string, canonical string, alias string")
    items = {r.line_id: r for r in D.typed_items(records, aliases).collect()}
    assert items[0].other_fields == {"overallstats.ncalls": "3", "overallstats.by.m": "[1, 2]", "overallstats.e": "{}"}
    assert items[1].id == "3" and items[1].other_fields == {"newsid": "2", "overallstats.ncalls": "4", "overallstats.ncalls#2": "5"}
    assert items[2].other_fields is None
    versions = D.typed_versions(records, aliases).orderBy("version_no").collect()
    assert [(v.final_rewritten_text, v.other_fields) for v in versions] == [("a", {"tone": '"calm"', "text.unit": '"u"'}), (None, {"entry": "7"})]
    failed = {(r.line_id, r.version_no, r.field_name) for r in D.cast_failures(records, aliases).filter("reason = 'no column'").collect()}
    assert failed == {(0, None, k) for k in items[0].other_fields} | {(1, None, k) for k in items[1].other_fields} | {(0, 1, "tone"), (0, 1, "text.unit"), (0, 2, "entry")}
