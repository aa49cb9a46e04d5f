"""Command for each stage: ``python -m newsloom.cli STAGE IN OUT [--sample N] [--model KIND]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import blank_line_segments
from newsloom.models.providers import REGISTRY, HashEmbedder, PatternEntities, TextModel, stage_model
from newsloom.operators import graph, stages
from newsloom.operators.versions import VERSIONS, long_versions
from newsloom.sources import io
from newsloom.sources.session import ship

STAGES = ("segment", "rewrite", "fuse", "align", "inject", "inject-shared", "evaluate")


def rewrite(news: DataFrame, kind: str, path: str) -> None:
    """The rewriting graph on articles: a result and a summary for each, and the trace of its attempts."""
    rows = io.articles(news).select("id", F.explode(blank_line_segments("content")).alias("s")).select(F.col("id").alias("doc"), "s.segment_id", "s.text")
    numbered = rows.withColumn("doc", F.xxhash64("doc"))
    model: TextModel = stage_model(kind, "rewrite")
    analyst = stage_model(kind, "analyze")
    versions, summaries = graph.rewrite_graph(numbered, model, analyst, graph.WordJudge(), graph.WordJudge(least=0.2, diversity=True))
    names = rows.select("doc").distinct().select(F.xxhash64("doc").alias("_n"), F.col("doc").alias("id"))
    named = lambda df: df.join(names, df["doc"] == names["_n"]).drop("doc", "_n")
    trace = versions.groupBy("doc").agg(F.count("*").alias("n_versions"), F.sum("total_segments_count").alias("n_segments"))
    io.write_results(named(versions), named(summaries), named(trace), path, "id")


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="newsloom")
    args.add_argument("stage", choices=STAGES)
    args.add_argument("input")
    args.add_argument("output")
    args.add_argument("--sample", type=int, default=0)
    args.add_argument("--model", choices=sorted(REGISTRY), default="stub")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("newsloom").getOrCreate()
    ship(spark)
    model = stage_model(a.model, a.stage.split("-")[0])
    if a.stage in ("segment", "rewrite"):
        news = io.head(io.read_news(spark, a.input), a.sample, "id")
        if a.stage == "rewrite":
            rewrite(news, a.model, a.output)
            return 0
        out = stages.segment_news(news, HashEmbedder())
    elif a.stage == "evaluate":
        out = stages.evaluate_items(io.head(io.read_list(spark, a.input, io.FUSED_SCHEMA), a.sample, "id"), model, HashEmbedder())
    else:
        items = io.head(io.read_items(spark, a.input), a.sample, "id")
        if a.stage.startswith("inject"):
            out = stages.inject(long_versions(items, "id", VERSIONS), model, PatternEntities(), a.stage == "inject-shared")
        else:
            out = stages.fuse(items, model)
            out = stages.align(out, model) if a.stage == "align" else out
    io.write_json(out, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
