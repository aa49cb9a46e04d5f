"""The rewriting graph: segment analysis, tags and masks, reduced versions, rewrites with two judges, routing, summaries.

Each step takes and returns DataFrames with one row for each segment, version or document; what belongs to one document
stays in its row, so only the steps that bring segments or versions together shuffle, by document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import jsonx
from newsloom.functions.score import quality_label
from newsloom.functions.text import collapse_blank_lines, non_blank, remove_tagged, safe_id, strip, strip_markup, wrap_all
from newsloom.models.providers import RetryPolicy, TextModel, apply_model, complete

ANALYSIS = (
    "tags array<struct<tag_id: string, tag_type: string, text: string, sentence: string, reason: string>>, "
    "reduced_versions array<struct<version_id: string, keep_tag_ids: array<string>, suggestions: string, reason: string>>"
)
TAG = ("tag_id", "full_tag_id", "safe_tag", "tag_type", "text", "sentence", "reason")


def _tag(seg: Column, local: Column, kind: Column, text: Column, sentence: Column, reason: Column) -> Column:
    full = F.concat(seg, F.lit("_"), local)
    values = (local, full, safe_id(full), kind, text, sentence, reason)
    return F.struct(*[v.alias(n) for n, v in zip(TAG, values)])


def analyze_segments(segments: DataFrame, model: TextModel, system: str = "Tag the key information of the paragraph and list versions to keep, as JSON.") -> DataFrame:
    """``tags``, ``reduced_versions``, ``tagged_text`` and ``error`` of segments ``(doc, segment_id, text)``.

    Tags without an id are numbered. Kept ids are completed by the segment's. Each tagged sentence is wrapped once, by its
    first tag; a paragraph that holds none gets a tag ``auto_<n>`` of its own. A blank text or an unusable answer has no
    tags, no versions and an empty tagged text.
    """
    got = apply_model(segments.withColumn("_prompt", F.when(strip("text") != "", F.col("text"))), "_prompt", model, system, "_answer")
    got = got.withColumn("_x", jsonx.extract_object("_answer")).withColumn("_j", F.from_json(F.col("_x.json"), ANALYSIS))
    seg = F.col("segment_id")
    blank = F.array().cast(f"array<struct<{', '.join(f'{n}: string' for n in TAG)}>>")
    local = lambda t, i: F.coalesce(F.nullif(strip(t["tag_id"]), F.lit("")), F.concat(F.lit("tag_"), (i + 1).cast("string")))
    tags = F.transform("_j.tags", lambda t, i: _tag(seg, local(t, i), t["tag_type"], t["text"], strip(t["sentence"]), t["reason"]))
    got = got.withColumn("_tags", F.coalesce(tags, blank))
    sentences = F.array_distinct(F.filter(F.transform("_tags", lambda t: F.coalesce(t["sentence"], F.lit(""))), lambda s: s != ""))
    got = got.withColumn("_sentences", sentences)
    paragraphs = non_blank(F.split("text", r"\n[ \t\f\r]*\n"))
    bare = F.filter(paragraphs, lambda p: ~F.exists("_sentences", lambda s: F.contains(p, s)))
    auto = F.transform(bare, lambda p, i: _tag(seg, F.concat(F.lit("auto_"), (i + 1).cast("string")), F.lit("background_auto"), p, p, F.lit("untagged paragraph")))
    got = got.withColumn("_auto", F.when(F.col("_j").isNotNull(), auto).otherwise(blank))
    first = lambda s: F.get(F.filter("_tags", lambda t: t["sentence"] == s), F.lit(0))["safe_tag"]
    wrapped = wrap_all(F.col("text"), F.transform("_sentences", lambda s: F.struct(s.alias("sentence"), first(s).alias("tag"))))
    wrapped = wrap_all(wrapped, F.transform("_auto", lambda t: F.struct(t["sentence"].alias("sentence"), t["safe_tag"].alias("tag"))))

    def kept(k: Column) -> Column:
        own = F.get(F.filter("_tags", lambda t: (t["tag_id"] == k) | (t["full_tag_id"] == k)), F.lit(0))["full_tag_id"]
        return F.when(F.startswith(k, F.concat(seg, F.lit("_"))), k).otherwise(F.coalesce(own, F.concat(seg, F.lit("_"), k)))

    def version(v: Column, i: Column) -> Column:
        ids = F.transform(F.filter(F.coalesce(v["keep_tag_ids"], F.array().cast("array<string>")), lambda k: k.isNotNull()), lambda k: kept(strip(k)))
        return F.struct(F.coalesce(v["version_id"], F.concat(F.lit("reduced_v"), (i + 1).cast("string"))).alias("version_id"), F.array_distinct(ids).alias("keep_tag_ids"), v["suggestions"].alias("suggestions"), v["reason"].alias("reason"))

    versions = F.coalesce(F.transform("_j.reduced_versions", version), F.array().cast("array<struct<version_id: string, keep_tag_ids: array<string>, suggestions: string, reason: string>>"))
    error = F.when(F.col("_prompt").isNotNull() & F.col("_j").isNull(), F.coalesce("_answer_error", F.col("_x.reason")))
    return got.select(
        *segments.columns, F.concat("_tags", "_auto").alias("tags"), versions.alias("reduced_versions"), F.when(F.col("_j").isNotNull(), wrapped).otherwise("").alias("tagged_text"), error.alias("error"),
    )


def masks(analyzed: DataFrame, n_versions: int = 3, seed: str = "42") -> DataFrame:
    """``(doc, version_no, version_id, keep_tag_ids, suggestions, mask, segs)``: what each version of a document keeps and removes.

    The versions are those of the first segment that names any, else ``reduced_v1`` to ``reduced_v<n_versions>``. A
    version keeps the union of what its segments keep; the mask is all other tags. Where no version keeps anything, each
    keeps a seeded third of the tags, at least one, and the keep lists stay empty.
    """
    docs = analyzed.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("segment_id", "text", "tagged_text", "tags", "reduced_versions"))).alias("segs"))
    ids = F.filter(F.transform("segs", lambda s: F.transform(F.filter(s["reduced_versions"], lambda v: v["version_id"].isNotNull()), lambda v: v["version_id"])), lambda x: F.size(x) > 0)
    given = F.coalesce(F.array_distinct(F.get(ids, F.lit(0))), F.array(*[F.lit(f"reduced_v{i + 1}") for i in range(n_versions)]))
    docs = docs.withColumn("_all", F.flatten(F.transform("segs", lambda s: F.transform(s["tags"], lambda t: t["full_tag_id"])))).withColumn("_given", given)
    of = lambda vid, f: F.flatten(F.transform("segs", lambda s: F.transform(F.filter(s["reduced_versions"], lambda v: v["version_id"] == vid), f)))
    versions = F.transform("_given", lambda vid: F.struct(vid.alias("version_id"), F.array_distinct(F.flatten(of(vid, lambda v: v["keep_tag_ids"]))).alias("keep_tag_ids"), F.filter(of(vid, lambda v: v["suggestions"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("suggestions")))
    docs = docs.withColumn("_versions", versions).withColumn("_any", F.exists("_versions", lambda v: F.size(v["keep_tag_ids"]) > 0))
    rows = docs.select("doc", "segs", "_all", "_any", F.posexplode("_versions").alias("_i", "_v")).select("doc", "segs", "_all", "_any", (F.col("_i") + 1).alias("version_no"), "_v.*")
    drawn = F.array_sort(F.transform("_all", lambda x: F.struct(F.sha2(F.concat_ws("|", F.col("doc").cast("string"), F.col("version_no").cast("string"), x, F.lit(seed)), 256).alias("key"), x.alias("id"))))
    third = F.when(F.size("_all") > 0, F.greatest(F.lit(1), F.floor(F.size("_all") / 3))).otherwise(0).cast("int")
    keep = F.when(F.col("_any"), F.col("keep_tag_ids")).otherwise(F.transform(F.filter(drawn, lambda x, i: i < third), lambda x: x["id"]))
    return rows.select("doc", "version_no", "version_id", "keep_tag_ids", "suggestions", F.filter("_all", lambda x: ~F.array_contains(keep, x)).alias("mask"), "segs")


def apply_masks(masked: DataFrame) -> DataFrame:
    """``(doc, version_no, version_id, text, segments, mask, keep_tag_ids, suggestions)``: each version without its masked tags' sentences."""

    def reduced(s: Column) -> Column:
        gone = F.transform(F.filter(s["tags"], lambda t: F.array_contains("mask", t["full_tag_id"])), lambda t: t["safe_tag"])
        source = F.when(s["tagged_text"] != "", s["tagged_text"]).otherwise(s["text"])
        return F.struct(s["segment_id"].alias("segment_id"), F.coalesce(remove_tagged(source, gone), strip(collapse_blank_lines(strip_markup(s["text"]))), F.lit("")).alias("text"))

    rows = masked.withColumn("segments", F.transform("segs", reduced))
    return rows.select("doc", "version_no", "version_id", F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n").alias("text"), "segments", "mask", "keep_tag_ids", "suggestions")


class Judge(Protocol):
    """Judge of a rewrite: ``passed``, ``score``, ``feedback`` and, for faithfulness, ``missing``, ``extra``, ``suggested_edits``."""

    def judge(self, source: str, rewrite: str) -> dict: ...


@dataclass
class ModelJudge:
    """A judge that asks a model for a record with the field ``passed``; an unusable answer doesn't pass and scores 0."""

    model: TextModel
    system: str
    retry: RetryPolicy = RetryPolicy(tries=2)

    def judge(self, source: str, rewrite: str) -> dict:
        if not source.strip() or not rewrite.strip():
            return {"passed": False, "score": 0.0, "feedback": "reference or rewritten text is empty"}
        answer, error = complete(self.model, self.system, f"Reference: {source}\nRewrite: {rewrite}", self.retry)
        found = jsonx.extract(answer)[0]
        record = json.loads(found) if found else None
        if isinstance(record, dict) and "passed" in record:
            return record
        return {"passed": False, "score": 0.0, "feedback": error or "no record in the answer"}


@dataclass
class WordJudge:
    """Offline stand-in: the share of the reference's words in the rewrite; for diversity, of the rewrite's words that are new."""

    least: float = 0.5
    diversity: bool = False

    def judge(self, source: str, rewrite: str) -> dict:
        a, b = source.lower().split(), rewrite.lower().split()
        one, other = (b, set(a)) if self.diversity else (a, set(b))
        share = sum(w in other for w in one) / max(len(one), 1)
        score = round(1 - share if self.diversity else share, 6)
        gone = list(dict.fromkeys(w for w in a if w not in set(b)))
        return {"passed": score >= self.least, "score": score, "feedback": "", "missing": [] if self.diversity else [{"text": w, "where_hint": ""} for w in gone]}


#: Headings of the feedback to a model. Fixed values.
FAITHFULNESS, ADD, DELETE, EDIT, DIVERSITY = "Faithfulness issues: ", "Content to add:", "Content to delete or correct:", "Specific modification suggestions:", "Diversity suggestions: "


def compose_feedback(faithful: dict, diverse: dict) -> str:
    """Feedback of one attempt for the next. Faithfulness comes first, as only it decides; both are left out after a pass."""
    lines: list[str] = []
    place = lambda x, hint: f"{x.get('text', '')} (position: {x.get(hint, '')})"
    if not faithful.get("passed"):
        if faithful.get("feedback"):
            lines.append(FAITHFULNESS + faithful["feedback"])
        for head, name, line in (
            (ADD, "missing", lambda x: f"- {place(x, 'where_hint')}"), (DELETE, "extra", lambda x: f"- {place(x, 'where_hint')}"), (EDIT, "suggested_edits", lambda x: f"- {x.get('action', 'Modify')}: {place(x, 'position_hint')}"),
        ):
            if faithful.get(name):
                lines += [head, *map(line, faithful[name])]
    if not diverse.get("passed") and diverse.get("feedback"):
        lines.append(DIVERSITY + diverse["feedback"])
    return "\n".join(lines)


ATTEMPT = "struct<attempt: int, rewritten_text: string, faithful: boolean, faithfulness_score: double, diverse: boolean, diversity_score: double, feedback_used: string>"
REWRITE_SCHEMA = f"doc bigint, version_no int, segment_id string, reduced_text string, final_rewritten_text string, final_passed boolean, used_fallback boolean, ok boolean, error string, history array<{ATTEMPT}>"


def rewrite_versions(reduced: DataFrame, model: TextModel, faithful: Judge, diverse: Judge, attempts: int = 3, system: str = "Rewrite the text.") -> DataFrame:
    """``REWRITE_SCHEMA`` of each segment of ``apply_masks``' versions.

    An attempt rewrites the text before (first the source) with the feedback on it, and stops the loop if it is found
    faithful; diversity only advises. An empty answer leaves the text as it was. After the last attempt the source stands
    in, marked as fallback and passed. An empty segment is a fallback that hasn't passed. Runs in batches, no shuffle.
    """

    def judged(judge: Judge, source: str, text: str) -> dict:
        try:
            return judge.judge(source, text)
        except Exception as e:  # a judge may raise anything; the attempt then fails
            return {"passed": False, "score": 0.0, "feedback": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, no, seg, source in pdf.itertuples(index=False):
                source = (source or "").strip()
                if not source:
                    rows.append((doc, no, seg, "", "", False, True, False, "empty text", []))
                    continue
                text, note, error, history, ok = source, "", None, [], False
                for n in range(1, attempts + 1):
                    got, error = complete(model, system, text if not note else f"{text}\n\n{note}")
                    text = (got or "").strip() or text
                    f, d = judged(faithful, source, text), judged(diverse, source, text)
                    history.append({"attempt": n, "rewritten_text": text, "faithful": bool(f.get("passed")), "faithfulness_score": float(f.get("score") or 0), "diverse": bool(d.get("passed")), "diversity_score": float(d.get("score") or 0), "feedback_used": note})
                    if f.get("passed") and got:
                        ok = True
                        break
                    note = compose_feedback(f, d)
                rows.append((doc, no, seg, source, text if ok else source, True, not ok, ok, error, history))
            yield pd.DataFrame(rows, columns=[c.split()[0].rstrip(":") for c in REWRITE_SCHEMA.split(", ")[:9]] + ["history"])

    flat = reduced.select("doc", "version_no", F.explode("segments").alias("s")).select("doc", "version_no", "s.segment_id", "s.text")
    return flat.mapInPandas(run, REWRITE_SCHEMA)


def assemble(rewritten: DataFrame) -> DataFrame:
    """Versions ``(doc, version_no, version_id, final_rewritten_text, scores, quality_label)`` from their segments, in segment order."""
    ok, back = F.avg(F.col("ok").cast("double")), F.avg(F.col("used_fallback").cast("double"))
    parts = F.sort_array(F.collect_list(F.struct("segment_id", "final_rewritten_text")))
    rows = rewritten.groupBy("doc", "version_no").agg(
        F.array_join(F.transform(parts, lambda x: x["final_rewritten_text"]), "\n\n").alias("final_rewritten_text"), F.count("*").alias("total_segments_count"), F.count_if("ok").alias("successful_segments_count"),
        ok.alias("success_ratio"), back.alias("fallback_ratio"), F.bool_and("final_passed").alias("final_passed"),
    )
    return rows.withColumn("version_id", F.concat(F.lit("rewritten_v"), F.col("version_no").cast("string"))).withColumn("version_score", F.col("success_ratio")).withColumn("quality_label", quality_label(F.col("success_ratio")))


def best_versions(versions: DataFrame, by: str = "doc", score: str = "version_score", order: str = "version_no") -> DataFrame:
    """The first version of each document with its highest score; a document whose scores aren't above 0 has none."""
    ranked = versions.filter(F.col(score) > 0).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), order)))
    return ranked.filter("_r = 1").drop("_r")


def evaluate_runs(versions: DataFrame, runs: DataFrame, by: str = "doc") -> DataFrame:
    """``runs(by, attempt, max_attempts)`` with ``n_versions``, ``all_passed`` and ``final_status``.

    A run passes if it has versions and all of them passed. One that hasn't is tried again while attempts are left, else
    it ends in the fallback.
    """
    agg = versions.groupBy(by).agg(F.count("*").alias("n_versions"), F.bool_and(F.coalesce("final_passed", F.lit(False))).alias("all_passed"))
    rows = runs.join(agg, by, "left").withColumn("n_versions", F.coalesce("n_versions", F.lit(0))).withColumn("all_passed", F.coalesce("all_passed", F.lit(False)))
    return rows.withColumn("final_status", F.when(F.col("all_passed"), "success").when(F.col("attempt") < F.col("max_attempts"), "retry").otherwise("fallback"))


def degraded(segments: DataFrame, model: TextModel, share: float = 0.7, system: str = "Rewrite the text.") -> DataFrame:
    """The degraded path ``(doc, text, final_rewritten_text, final_status)``: one rewrite of the first part of a document's segments ``(doc, segment_id, text)``."""
    rows = segments.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("segment_id", "text"))).alias("s"))
    n = F.greatest(F.lit(1), F.floor(F.size("s") * share)).cast("int")
    rows = rows.select("doc", F.array_join(F.transform(F.slice("s", F.lit(1), n), lambda x: x["text"]), "\n\n").alias("text"))
    got = apply_model(rows.withColumn("_prompt", F.when(strip("text") != "", F.col("text"))), "_prompt", model, system, "_r")
    return got.select("doc", "text", F.coalesce(F.nullif(strip(F.col("_r")), F.lit("")), F.col("text")).alias("final_rewritten_text"), F.lit("end_fail").alias("final_status"))


def rewrite_graph(segments: DataFrame, model: TextModel, analyst: TextModel, faithful: Judge, diverse: Judge, n_versions: int = 3, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(versions, summaries) of documents' segments ``(doc, segment_id, text)``: analysis, masks, rewrites and scores in turn.

    A summary holds the three best versions and the overall counts of a document.
    """
    reduced = apply_masks(masks(analyze_segments(segments, analyst), n_versions))
    versions = assemble(rewrite_versions(reduced, model, faithful, diverse, attempts))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("version_score")).alias("_by"), "version_no", "version_id", "version_score", "success_ratio", "quality_label", "final_rewritten_text"))), 1, 3)
    summary = versions.groupBy("doc").agg(top.alias("top_rewrites"), F.count("*").alias("total_versions"), F.count_if(F.col("success_ratio") == 1.0).alias("fully_successful_versions"), F.avg("success_ratio").alias("average_success_ratio"))
    return versions, summary.withColumn("top_rewrites", F.transform("top_rewrites", lambda v: v.dropFields("_by", "version_no")))
