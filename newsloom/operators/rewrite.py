"""Scores of rewritten versions, the best ones and overall counts; the loop that makes them is in ``graph``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.score import quality_label


def version_scores(segments: DataFrame, by: list[str]) -> DataFrame:
    """Scores of versions from segment rows ``(by, final_passed, used_fallback, ok)``; ``ok`` marks a successful rewrite."""
    ratio = F.avg(F.col("ok").cast("double"))
    out = segments.groupBy(*by).agg(
        F.count("*").alias("total_segments"), F.count_if("ok").alias("successful_segments"), ratio.alias("success_ratio"), F.avg(F.col("used_fallback").cast("double")).alias("fallback_ratio"), F.bool_and("final_passed").alias("final_passed")
    )
    return out.withColumn("quality_label", quality_label(F.col("success_ratio")))


def top_versions(versions: DataFrame, by: str, score: str, order: list[str], k: int = 3) -> DataFrame:
    """The ``k`` best versions of each item with ``rank``; ties in ``order``, missing scores last."""
    w = Window.partitionBy(by).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), *order)
    return versions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overall_stats(versions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return versions.groupBy(*(by or [])).agg(F.count("*").alias("total_versions"), F.count_if(F.col("success_ratio") == 1.0).alias("fully_successful_versions"), F.avg("success_ratio").alias("average_success_ratio"))
