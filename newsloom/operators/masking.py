"""Tags and masks: keep lists, anti and semi joins, automatic tags, seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_union(keeps: DataFrame, by: list[str], tag: str = "tag_id") -> DataFrame:
    """The tags that any segment keeps, sorted, for each group."""
    return keeps.groupBy(*by).agg(F.sort_array(F.collect_set(tag)).alias("keep_tag_ids"))


def full_tag_ids(keeps: DataFrame, tags: DataFrame) -> DataFrame:
    """Keep rows ``(doc, seg, tag_id)`` with the full id of their tag; an unknown one gets segment and id joined by ``_``."""
    known = tags.select("doc", "seg", "tag_id", "full_tag_id")
    return keeps.join(known, ["doc", "seg", "tag_id"], "left").withColumn("full_tag_id", F.coalesce("full_tag_id", F.concat_ws("_", "seg", "tag_id")))


def mask(tags: DataFrame, keeps: DataFrame, keys: list[str]) -> DataFrame:
    """Tags that aren't kept (anti join): what is removed from the text."""
    return tags.join(keeps.select(*keys).distinct(), keys, "left_anti")


def masked(tags: DataFrame, mask_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tags that stand in the mask (semi join)."""
    return tags.join(mask_rows.select(*keys), keys, "left_semi")


def apply_mask(segments: DataFrame, mask_rows: DataFrame) -> DataFrame:
    """Segments ``(doc, seg, text)`` without their masked tags' sentences ``(doc, seg, sentence)``."""
    gone = mask_rows.groupBy("doc", "seg").agg(F.sort_array(F.collect_set("sentence")).alias("gone"))
    left = F.aggregate(F.coalesce("gone", F.array().cast("array<string>")), F.col("text"), lambda acc, s: F.replace(acc, s, F.lit("")))
    return segments.join(gone, ["doc", "seg"], "left").select("doc", "seg", F.trim(F.regexp_replace(left, "[ ]{2,}", " ")).alias("text"))


def uncovered(paragraphs: DataFrame, tags: DataFrame) -> DataFrame:
    """Paragraphs ``(doc, ord, paragraph)`` that hold no tagged sentence; they get an automatic tag ``auto_<ord>``.

    A document's tagged sentences are gathered once, so the containment test needs no join by content.
    """
    sentences = tags.groupBy("doc").agg(F.collect_set("sentence").alias("sentences"))
    open_ = F.col("sentences").isNull() | ~F.exists("sentences", lambda s: (s != "") & F.contains(F.col("paragraph"), s))
    return paragraphs.join(sentences, "doc", "left").filter(open_).select("doc", "ord", "paragraph", F.concat(F.lit("auto_"), F.col("ord")).alias("tag_id"))


def sample_tags(tags: DataFrame, by: list[str], tag: str = "tag_id", seed: str = "42", part: int = 3) -> DataFrame:
    """A third of each group's tags, at least one, by a seeded hash: the same on every run and partitioning."""
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, tag)], F.lit(seed)), 256)
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_key", tag))
    return tags.withColumn("_key", key).select("*", n.alias("_n"), rank.alias("_r")).filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / part))).drop("_key", "_n", "_r")
