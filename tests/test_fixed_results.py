"""Results that once went wrong: lists of rewrites, repaired JSON, repeated news rows, cut tables."""

import json
import os

from pyspark.sql import functions as F

from newsloom.functions import jsonx
from newsloom.operators import versions as V
from newsloom.sources import session

ENTRY = "array<struct<final_rewritten_text: string, text: string>>"
ITEMS = f"id string, input_text string, rewritten_v1 string, rewritten_v2 string, rewrite_versions array<string>, top_rewrites {ENTRY}, final_text string, alt_rewrite_1 string"


def test_a_list_of_rewrites_is_taken_whole(spark):
    x, y, z = ("x", None), (None, "y"), ("", "z")
    rows = [
        ("lists", "t", None, None, ["a", ""], [x, y, z], "f", None),
        ("second", "t", None, None, ["", ""], [x, y], "f", None),
        ("first empty", "t", None, None, [], [x, None, z, x], "f", None),
        ("legacy", "", None, None, None, None, "f", "g"),
        ("direct", "t", "", "d", ["a"], [x], "f", "g"),
        ("none", None, None, None, None, [None], None, None),
    ]
    got = {r.id: (r.rewritten_v1, r.rewritten_v2, r.rewritten_v3) for r in V.normalise_versions(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {"lists": ("a", "", ""), "second": ("x", "y", ""), "first empty": ("x", "", "z"), "legacy": ("f", "g", ""), "direct": ("", "d", ""), "none": ("", "", "")}
    assert V.normalise_versions(spark.createDataFrame([], ITEMS)).count() == 0


def test_repair_keeps_quoted_texts():
    assert json.loads(jsonx.repair('{"a": "it is true and null, ]", "b": [1, 2,],}')) == {"a": "it is true and null, ]", "b": [1, 2]}
    assert json.loads(jsonx.repair("{'a': 'false, }', 'b': true, 'c': [null,]}")) == {"a": "false, }", "b": True, "c": [None]}
    assert json.loads(jsonx.repair("{'a': 'don\\'t \"x, ]\"', \"b\": 'é'}")) == {"a": 'don\'t "x, ]"', "b": "é"}
    assert jsonx.repair('{"a": "ok"}') == '{"a": "ok"}' and jsonx.repair("{broken") is None
    assert jsonx.extract('say {"a": "x, }",} done') == ('{"a": "x, }"}', "repaired")


def test_cut_tables_are_deleted(spark):
    session.drop_cuts(spark)
    df = session.cut(spark.range(3), "few")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.agg(F.sum("id").alias("s")).collect()[0].s == 3 and os.path.isdir(path)
    assert session.drop_cuts(spark) == 1 and not os.path.exists(path)


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and session.spread(one).count() == 100
    many = spark.range(100, numPartitions=9)
    assert session.spread(many) is many
    grouped = one.groupBy("id").count()
    assert session.spread(grouped) is grouped
