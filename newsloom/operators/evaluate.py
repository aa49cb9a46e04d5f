"""Evaluation: tasks as cross products with small dimensions, problem counts, similarity means, corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import similarity
from newsloom.functions.text import strip

#: Problem kinds as codes; the first five concern a whole text, the other eight a sentence.
GLOBAL_PROBLEMS = ["coherence", "style", "structure", "redundancy", "focus"]
SENTENCE_PROBLEMS = ["completeness", "core_data", "attribution", "time_order", "location", "causality", "conflict", "wording"]


def tasks(items: DataFrame, problems: list[str]) -> DataFrame:
    """Each item once for each problem kind; the kinds are a literal array, so nothing is joined."""
    return items.select("*", F.explode(F.array(*map(F.lit, problems))).alias("problem"))


def problem_counts(found: DataFrame, id_col: str, level: str) -> DataFrame:
    """``(id, level, problem, n)`` of rows whose ``problem_exists`` is true, with a total (null problem) in the same pass."""
    rows = found.filter("problem_exists")
    return rows.groupingSets([[F.col(id_col), F.col("problem")], [F.col(id_col)]], F.col(id_col), F.col("problem")).agg(F.count("*").alias("n")).withColumn("level", F.lit(level))


def similarity_columns(a: Column | str, b: Column | str) -> dict[str, Column]:
    """Word, word-pair and edit similarity of texts of any length."""
    return {"jaccard": similarity.jaccard(a, b), "tfidf": similarity.tfidf(a, b), "levenshtein": similarity.levenshtein_long(a, b)}


def candidates(items: DataFrame, id_col: str, fused: str = "fused_content", original: str = "input_text") -> DataFrame:
    """``(id, version_id, fused, text)``: the fused text beside the original and each version that isn't blank.

    ``rewritten_v<i>`` comes before ``rewrite_<i>``. Items whose fused or original text is blank have no rows.
    """
    have = set(items.columns)
    named = [("original", F.col(original))]
    for i in (1, 2, 3):
        names = [n for n in (f"rewritten_v{i}", f"rewrite_{i}") if n in have]
        if names:
            texts = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
            name = F.when(F.coalesce(F.nullif(F.col(names[0]), F.lit("")), F.lit("")) != "", names[0]).otherwise(names[-1])
            named.append((name, texts))
    usable = items.filter((strip(F.coalesce(F.col(fused), F.lit(""))) != "") & (strip(F.coalesce(F.col(original), F.lit(""))) != ""))
    pairs = F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("version_id"), t.alias("text")) for n, t in named])
    rows = usable.select(id_col, F.col(fused).alias("fused"), F.explode(pairs).alias("c")).select(id_col, "c.version_id", "fused", "c.text")
    return rows.filter(strip(F.coalesce("text", F.lit(""))) != "")


def method_means(rows: DataFrame, id_col: str, methods: list[str], main: str) -> DataFrame:
    """One row of each item of ``rows(id, version_id, *methods)``: the mean of each method over the candidates that have it,
    the verdict on the mean of ``main``, ``methods_differ`` (population variance of the means above 0.1), ``original_low``,
    and ``observations``: these two and what to look at, as codes.
    """
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in methods]
    out = rows.groupBy(id_col).agg(*means, F.max(F.when(F.col("version_id") == "original", F.col(main))).alias("_original"))
    mean = sum((F.col(m) for m in methods[1:]), F.col(methods[0])) / len(methods)
    variance = sum(((F.col(m) - mean) * (F.col(m) - mean) for m in methods[1:]), (F.col(methods[0]) - mean) * (F.col(methods[0]) - mean)) / len(methods)
    out = out.withColumn("methods_differ", F.round(variance, 9) > 0.1).withColumn("verdict", similarity.verdict(F.round(main, 9)))
    out = out.withColumn("original_low", F.coalesce(F.round("_original", 9) < 0.5, F.lit(False))).drop("_original")
    remarks = [F.when(F.col("original_low"), "original_low"), F.when(F.col("methods_differ"), "methods_differ"), F.when(F.round(main, 9) < 0.6, "check_key_facts")]
    if "jaccard" in methods:
        remarks.append(F.when(F.round("jaccard", 9) < 0.3, "check_wording"))
    return out.withColumn("observations", F.array_compact(F.array(*remarks)))


def analysis(items: DataFrame, means: DataFrame, id_col: str) -> DataFrame:
    """``items``' keys with their means; an item without any gets the empty result: ``success`` false, all else null."""
    return items.select(id_col).distinct().join(means.withColumn("success", F.lit(True)), id_col, "left").withColumn("success", F.coalesce("success", F.lit(False)))


def classify(found: DataFrame, id_col: str) -> DataFrame:
    """``(id, by_type, total_count)`` of problem rows ``(id, problem, problem_exists)``; an item without problems has an empty map."""
    n = found.groupBy(id_col, "problem").agg(F.count_if("problem_exists").alias("n"))
    by = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("problem", "n")))))
    return n.groupBy(id_col).agg(by.alias("by_type"), F.sum("n").alias("total_count"))


def type_totals(classified: DataFrame, level: str, success: str = "evaluation_success") -> DataFrame:
    """``(level, problem, n)``: the problems of each type over successful evaluations, with their total (null problem)."""
    rows = classified.filter(success).select(F.explode("by_type").alias("problem", "n"))
    return rows.groupingSets([[F.col("problem")], []], F.col("problem")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(level).alias("level"), "problem", "n")


def batch_tally(evaluated: DataFrame, batch: str) -> DataFrame:
    """Successes, problem totals and mean similarity of each batch; only successful evaluations count towards the totals."""
    ok = F.coalesce("evaluation_success", F.lit(False))
    part = lambda c: F.coalesce(F.sum(F.when(ok, F.coalesce(c, F.lit(0)))), F.lit(0))
    n = F.count_if(ok)
    return evaluated.groupBy(batch).agg(
        F.count("*").alias("n_items"), n.alias("n_success"), part("global_problem_count").alias("total_global_problems"), part("sentence_problem_count").alias("total_sentence_problems"),
        F.when(n > 0, F.sum(F.when(ok, F.coalesce("semantic_similarity", F.lit(0.0)))) / n).otherwise(0.0).alias("average_semantic_similarity"),
    )


def corpus_report(evaluated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, means and extremes over successful evaluations; a missing similarity counts as 0 in the mean."""
    ok = evaluated.filter("evaluation_success")
    sim = F.coalesce("semantic_similarity", F.lit(0.0))
    return ok.groupBy(*(by or [])).agg(
        F.count("*").alias("total_news_evaluated"), F.round(F.avg("global_problem_count"), 2).alias("average_global_problems"), F.round(F.avg("sentence_problem_count"), 2).alias("average_sentence_problems"),
        F.round(F.avg(F.col("global_problem_count") + F.col("sentence_problem_count")), 2).alias("average_total_problems"),
        F.round(F.avg(sim), 3).alias("avg_semantic_similarity"), F.min(sim).alias("min_semantic_similarity"), F.max(sim).alias("max_semantic_similarity"),
    )


def fusion_stats(fused: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many items there are and how many got a fused text."""
    return fused.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("fused_content") != "", F.lit(False))).alias("success"))
