"""Readers and writers of news files: JSON lists or single objects, wrapped lists, reports, one file set a row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.nested import parse
from newsloom.operators.versions import normalise_versions

NEWS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "title", "content", "url", "publish_date", "seendate", "source", "year", "is_disaster_related", "main_topic")] + [T.StructField("keywords_found", T.ArrayType(T.StringType()))]
)
ENTRY = T.StructType([T.StructField("version_id", T.StringType()), T.StructField("version_score", T.DoubleType()), T.StructField("success_ratio", T.DoubleType()), T.StructField("quality_label", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("final_rewritten_text", "final_text", "text", "content", "summary")])
VERSION_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "news_id", "item_id", "input_text", "text", "original_text", "input", "rewritten_v1", "rewritten_v2", "rewritten_v3", "final_rewritten_text", "final_text", "alt_rewrite_1", "alt_rewrite_2")]
    + [T.StructField(c, T.ArrayType(ENTRY)) for c in ("rewrite_versions", "top_rewrites", "rewrites")]
)

FUSED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "input_text", "fused_content", "rewritten_v1", "rewritten_v2", "rewritten_v3", "rewrite_1", "rewrite_2", "rewrite_3")])


def read_news(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """News items of a JSON list or object (``lines``: one object a line); unreadable files give no rows.

    Lines scale: a list is one split, so large feeds should come as lines or parquet.
    """
    return spark.read.schema(NEWS_SCHEMA).option("mode", "DROPMALFORMED").json(path, multiLine=not lines)


def read_versions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items with versions, whatever fields they come in, as ``(id, input_text, rewritten_v1..3)``."""
    return normalise_versions(spark.read.schema(VERSION_SCHEMA).option("mode", "DROPMALFORMED").json(path, multiLine=not lines))


#: Fields that tell a record, and those that tell a list of records, when the root of a file is looked at.
_RECORD = ("rewrite_versions", "top_rewrites", "rewrites", "rewritten_v1")
_LISTED = ("rewrite_versions", "top_rewrites", "rewritten_v1", "input_text", "id")
_ENTRY_TEXT = ("final_rewritten_text", "final_text", "text", "content", "summary")
_PLAIN = [f.name for f in VERSION_SCHEMA.fields if f.dataType == T.StringType()]
_LISTS = ("rewrite_versions", "top_rewrites", "rewrites")


def records_of(data) -> list:
    """The records of a parsed file: the elements of a list; an object that is a record; else its first list of records; else the object."""
    if isinstance(data, list):
        return data
    if not isinstance(data, dict):
        return []
    if not any(k in data for k in _RECORD):
        for v in data.values():
            if isinstance(v, list) and v and isinstance(v[0], dict) and any(k in v[0] for k in _LISTED):
                return [x for x in v if isinstance(x, dict)]
    return [data]


def _entry(e) -> str:
    if isinstance(e, dict):
        return next((e[k] for k in _ENTRY_TEXT if isinstance(e.get(k), str) and e[k]), "")
    return e if isinstance(e, str) else ""


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with versions of files in any of the shapes that ``records_of`` knows, as ``(id, input_text, rewritten_v1..3)``.

    An element of a list that is a text is an item with that input text, one of another kind an empty item. A file that
    can't be read gives no items (``unreadable_files`` tells). A file is one task; large feeds should come as lines.
    """
    fields = ", ".join([f"{c}: string" for c in _PLAIN] + [f"{c}: array<string>" for c in _LISTS])

    @F.pandas_udf(f"array<struct<{fields}>>")
    def unwrap(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            items = []
            for r in records_of(parse(text)):
                r = r if isinstance(r, dict) else {"input_text": r if isinstance(r, str) else ""}
                item = {c: None if r.get(c) is None else r[c] if isinstance(r[c], str) else json.dumps(r[c], ensure_ascii=False) for c in _PLAIN}
                items.append(item | {c: [_entry(e) for e in r[c]] if isinstance(r.get(c), list) else None for c in _LISTS})
            out.append(items)
        return pd.Series(out)

    files = spark.read.text(path, wholetext=True)
    return normalise_versions(files.select(F.explode(unwrap("value")).alias("r")).select("r.*"))


def read_wrapped(spark: SparkSession, path: str, list_field: str) -> DataFrame:
    """Items of an object that holds them in one of its lists."""
    wrapped = T.StructType([T.StructField(list_field, T.ArrayType(VERSION_SCHEMA))])
    return normalise_versions(spark.read.schema(wrapped).json(path, multiLine=True).select(F.inline(list_field)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Items of a list of bare texts: only ``input_text`` is known."""
    texts = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("input_text"))
    return texts.select(F.lit("").alias("id"), "input_text", *[F.lit("").alias(f"rewritten_v{i}") for i in (1, 2, 3)])


def read_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files whose root is a list; a file with another root, or none that can be read, gives no rows (``unreadable_files`` tells)."""
    files = spark.read.text(path, wholetext=True).filter(F.col("value").rlike(r"^\s*\["))
    records = files.select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r"))
    return records.filter("r is not null").select("r.*")


def unreadable_files(spark: SparkSession, path: str, lists_only: bool = False) -> DataFrame:
    """``(file, reason)`` of files that give no records: ``not_json``, or ``not_a_list`` if only lists are taken."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    kind = F.when(F.try_parse_json("value").isNull(), "not_json")
    if lists_only:
        kind = kind.when(~F.col("value").rlike(r"^\s*\["), "not_a_list")
    return files.select("file", kind.alias("reason")).filter("reason is not null")


def articles(news: DataFrame) -> DataFrame:
    """Items with content, stripped."""
    from newsloom.functions.text import strip

    return news.withColumn("content", strip("content")).filter("content <> ''")


def cleaned_news(segmented: DataFrame) -> DataFrame:
    """The eleven fields of cleaned news; content is the cleaned content where there is one."""
    return segmented.select("id", "title", F.coalesce("cleaned_content", "content").alias("content"), "url", "publish_date", "seendate", "source", "year", "is_disaster_related", "main_topic", "keywords_found")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_by_item(df: DataFrame, path: str, key: str) -> None:
    """One folder for each item, as results and summaries of single articles are looked up by item."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def write_results(results: DataFrame, summaries: DataFrame, trace: DataFrame, path: str, key: str) -> None:
    """A result and a summary for each item, and the trace as a table of its own, so that nothing overwrites anything."""
    write_by_item(results, f"{path}/result", key)
    write_by_item(summaries, f"{path}/summary", key)
    trace.write.mode("overwrite").json(f"{path}/trace")


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` items in a stated order; all of them if ``n`` isn't positive."""
    return df.orderBy(order).limit(n) if n > 0 else df
