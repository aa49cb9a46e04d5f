"""The model stages end to end: segment, fuse, align, inject conflicts, evaluate. Each takes providers and returns a DataFrame.
The rewriting graph is a module of its own.

Calls go through ``apply_model``: one for each distinct prompt, errors in the row, other rows unaffected. Rows that
need no call are kept out of it by their prompt being null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import jsonx, score, similarity
from newsloom.functions.text import attach, detach, locate_span, paragraphs, strip, strip_prefix, theme
from newsloom.functions.text import sentences as sentence_units
from newsloom.models.providers import Embedder, EntityExtractor, KeywordTokenizer, TextModel, Tokenizer, WordTokenizer, apply_model, embed_column, entity_rows
from newsloom.operators import evaluate as E
from newsloom.operators.segment import merge_lengths_of, merge_vectors
from newsloom.operators.versions import VERSIONS, usable_entities, usable_versions
from newsloom.sources.session import cut

ALIGNMENT = "array<struct<sent_idx: int, text: string, sources: array<int>, evidence: array<string>, conflict_resolved: string>>"
CONFLICTS = "struct<modified_text: string, conflicts: array<struct<entity_text: string, original_span: string, injected_span: string, type: string, note: string, target_entity: string>>>"


def keywords_of(text: str | None, tokenizer: Tokenizer, k: int) -> list[str]:
    """The ``k`` commonest tokens of more than one character, ties in order of appearance; function words are left out."""
    counts = Counter(t for t in tokenizer.tokens(text or "") if len(t) > 1 and t not in score.STOP_WORDS)
    return [t for t, _ in counts.most_common(k)]


def keyword_column(text: str, tokenizer: Tokenizer, k: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([keywords_of(t, tokenizer, k) for t in texts])

    return run(text)


_UNITS = re.compile(r"[。！？!?；;]|[\n\r]+|(?<=[.?!])\s+")


def best_sentences(text: str, keywords: list[str], tokenizer: Tokenizer, k: int = 2, weights: tuple[float, float, float] = (0.3, 0.3, 0.4), in_order: bool = False) -> list[str]:
    """The ``k`` best sentences of a text by length, position and keyword density, best first or in the order of the text."""
    units = [u.strip() for u in _UNITS.split(text) if u and u.strip()]
    known = {w.lower() for w in keywords}
    features = []
    for i, u in enumerate(units):
        tokens = tokenizer.tokens(u)
        features.append((len(u), (len(units) - i) / len(units), sum(t in known for t in tokens) / len(tokens) if tokens else 0.0))

    def scaled(values: tuple) -> list[float]:
        low, high = min(values), max(values)
        return [1.0] * len(values) if abs(high - low) <= 1e-9 * max(abs(high), abs(low)) else [(v - low) / (high - low) for v in values]

    columns = [scaled(c) for c in zip(*features)]
    scores = [sum(w * c[i] for w, c in zip(weights, columns)) for i in range(len(units))]
    best = sorted(range(len(units)), key=lambda i: -scores[i])[:k]
    return [units[i] for i in (sorted(best) if in_order else best)]


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    norm = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / norm if norm else 0.0


SEGMENT = "struct<segment_id: int, content: string, theme: string, char_count: int, token_count: int, importance_score: double, original_paragraphs_count: int, original_indices: array<int>>"


def segment_news(news: DataFrame, embedder: Embedder, lex: score.Lexicon | None = None, tokenizer: Tokenizer = KeywordTokenizer(), tau: float = 0.5) -> DataFrame:
    """``news(id, title, content, main_topic)`` with ``segments``, ``cleaned_content``, ``segment_count``, ``segmentation_stats`` and ``processing_success``.

    Paragraphs pass the decision list (length, title and topic keywords, lexicon, blacklist, confidence against the
    threshold), then join by embeddings, or by lengths alone where the embedder fails. Repeated rows are worked on once
    and each gets the result; rows that differ in anything are kept apart. All is null for an empty content; a text of
    which no paragraph passes is its own cleaned content. Each distinct text is embedded once.
    """
    lex = lex or score.Lexicon()
    keyed = news.withColumn("_row", F.sha2(F.to_json(F.struct("id", "title", "content", "main_topic")), 256))
    items = keyed.select("_row", "title", "main_topic", "content").dropDuplicates(["_row"])
    items = items.withColumn("_words", F.concat(keyword_column("title", tokenizer, 10), keyword_column("main_topic", tokenizer, 10))).withColumn("_kt", keyword_column("title", tokenizer, 10)).withColumn("_km", keyword_column("main_topic", tokenizer, 10))
    pars = items.select("_row", "title", "main_topic", "_words", "_kt", "_km", F.posexplode(paragraphs("content")).alias("ord", "p"))
    p = F.col("p")
    ruled = pars.withColumn("rule", F.when(F.length(p) < score.LEAST_CHARS, "drop").when(score.whitelisted(p, lex, F.col("_words")), "keep").when(score.blacklisted(p, lex), "drop").otherwise("score"))
    ruled = cut(ruled.filter("rule <> 'drop'").withColumn("_kp", keyword_column("p", tokenizer, 10)), "paragraphs")
    texts = ruled.select(F.explode(F.array("p", "title", "main_topic")).alias("text")).filter("text <> ''").distinct()
    vectors = cut(embed_column(texts, "text", embedder, "v"), "vectors")
    for c in ("p", "title", "main_topic"):
        ruled = ruled.join(vectors.select(F.col("text").alias(c), F.col("v").alias(f"v_{c}")), c, "left")
    sim = lambda c: F.coalesce(similarity.cosine("v_p", f"v_{c}"), F.lit(0.0))
    conf = score.confidence(F.greatest(sim("title"), sim("main_topic")), score.keyword_relevance(p, F.col("_kp"), F.col("_kt"), F.col("_km"), lex), score.context_relevance(p, lex), score.content_quality(p))
    kept = ruled.filter((F.col("rule") == "keep") | (conf >= score.threshold(p, lex)))
    rows = kept.groupBy("_row").agg(F.first("title").alias("title"), F.first("main_topic").alias("topic"), F.first("v_title").alias("v_title"), F.first("v_main_topic").alias("v_topic"), F.sort_array(F.collect_list(F.struct("ord", "p", "v_p"))).alias("pars"))
    counter = WordTokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, title, topic, v_title, v_topic, pars in pdf.itertuples(index=False):
                vs, lengths = [x["v_p"] for x in pars], [len(x["p"]) for x in pars]
                if any(v is None for v in vs):
                    numbers = merge_lengths_of(lengths)
                else:
                    numbers = merge_vectors([np.asarray(v, dtype=float) for v in vs], lengths, tau, tau - 0.15)
                groups: dict[int, list] = {}
                for n, x in zip(numbers, pars):
                    groups.setdefault(n, []).append(x)
                made = []
                for n, group in groups.items():
                    content = " ".join(x["p"] for x in group)
                    best = best_sentences(content, keywords_of(content, tokenizer, 20), counter)
                    try:
                        got = [np.asarray(v, dtype=float) for v in embedder.embed([content, *best])]
                    except Exception:  # the embedder failed: no similarity counts
                        got = [np.zeros(1)] * (1 + len(best))
                    near = lambda v, other: _cosine(v, np.asarray(other, dtype=float)) if other is not None and len(other) == len(v) else 0.0
                    at = max(range(len(best)), key=lambda i: (near(got[i + 1], v_title), -i)) if best and title else 0
                    head = re.sub(r"\s+", " ", best[at].strip()) if best else ""
                    head = (head[:57] + "..." if len(head) > 60 else head) if best else (content[:50] + "..." if len(content) > 50 else content)
                    dense = len(keywords_of(content, tokenizer, 5)) / max(1, len(content.split()))
                    weight = near(got[0], v_title) * 0.4 + near(got[0], v_topic) * 0.3 + min(1.0, len(content) / 200) * 0.2 + min(dense * 2, 0.1)
                    made.append({"segment_id": n, "content": content, "theme": head, "char_count": sum(len(x["p"]) for x in group), "token_count": len(counter.tokens(content)), "importance_score": round(weight, 3), "original_paragraphs_count": len(group), "original_indices": [int(x["ord"]) for x in group]})
                out.append((key, made))
            yield pd.DataFrame(out, columns=["_row", "segments"])

    segments = rows.mapInPandas(run, f"_row string, segments array<{SEGMENT}>")
    out = keyed.join(segments, "_row", "left").drop("_row")
    filled = strip(F.coalesce("content", F.lit(""))) != ""
    total = lambda c: F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    n = F.size("segments")
    stats = F.struct(
        total("char_count").alias("total_chars"), F.round(F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["importance_score"]) / n, 3).alias("average_importance"), F.length("content").alias("original_char_count"),
        F.round(1 - total("char_count") / F.length("content"), 3).alias("filtered_ratio"), (total("original_paragraphs_count") / n).alias("average_paragraphs_per_segment"), F.round(total("char_count") / n, 1).alias("average_chars"),
        F.array_min(F.transform("segments", lambda x: x["char_count"])).alias("min_chars"), F.array_max(F.transform("segments", lambda x: x["char_count"])).alias("max_chars"),
    )
    cleaned = F.coalesce(F.array_join(F.transform("segments", lambda x: x["content"]), "\n\n"), F.col("content"))
    return out.withColumn("cleaned_content", F.when(filled, cleaned)).withColumn("segment_count", F.when(filled, F.coalesce(n, F.lit(0)))).withColumn("segmentation_stats", F.when(filled & (n > 0), stats)).withColumn("processing_success", F.when(filled, F.lit(True)))


def themes(segments: DataFrame) -> DataFrame:
    """A heading for each segment ``(id, segment_id, content)``."""
    return segments.withColumn("theme", theme(sentence_units("content"), "content"))


def fuse(items: DataFrame, model: TextModel, system: str = "Fuse the versions into one news text.") -> DataFrame:
    """``fused_content`` and ``fusion_method`` of ``items(rewritten_v1..3)``; with fewer than two usable versions the first one stands, no call is made."""
    rows = usable_versions(items)
    rows = rows.withColumn("_prompt", F.when(F.col("needs_fusion"), F.concat_ws("\n\n", *[F.when(strip(v) != "", F.col(v)) for v in VERSIONS])))
    got = apply_model(rows, "_prompt", model, system, "_fused")
    text = F.coalesce(strip_prefix("_fused"), F.col("fallback_text"))
    method = F.when(~F.col("needs_fusion"), "single_version").when(F.col("_fused").isNotNull(), "model").otherwise("fallback")
    return got.withColumn("fused_content", text).withColumn("fusion_method", method).drop("_prompt", "_fused", "_fused_error", "n_usable", "needs_fusion", "fallback_text")


def align(fused: DataFrame, model: TextModel, system: str = "List every sentence with its sources as JSON.") -> DataFrame:
    """``alignment``, ``raw_alignment``, ``alignment_error`` and ``aligned_text`` (text, separator, JSON) of fused texts.

    A blank text gets the error ``missing_fused_content``; a row with an error has no aligned text.
    """
    rows = fused.withColumn("_prompt", F.when(strip("fused_content") != "", F.col("fused_content")))
    got = apply_model(rows, "_prompt", model, system, "raw_alignment")
    parsed = jsonx.array_after("raw_alignment", ALIGNMENT)
    error = F.when(F.col("_prompt").isNull(), "missing_fused_content").when(F.col("raw_alignment_error").isNotNull(), F.col("raw_alignment_error")).when(F.size("alignment") == 0, "no_alignment")
    got = got.withColumn("alignment", parsed).withColumn("alignment_error", error).drop("_prompt", "raw_alignment_error")
    return got.withColumn("aligned_text", F.when(F.col("alignment_error").isNull(), attach("fused_content", F.col("alignment"))))


def inject(versions: DataFrame, model: TextModel, extractor: EntityExtractor, shared_only: bool = False, system: str = "Change facts and list the changes as JSON.") -> DataFrame:
    """Versions ``(id, version_id, text)`` with ``injected_text`` and ``conflicts``, spans located in the new text.

    ``shared_only`` tells the model the entities that all versions of an item have. An unusable answer keeps the text
    and gives one conflict of type ``unknown``.
    """
    rows = versions
    if shared_only:
        rows_ = entity_rows(versions, "text", extractor).select("id", "version_id", "entity.text", "entity.label", "entity.start_char", "entity.end_char")
        found = usable_entities(rows_, ["id", "version_id"], "start_char").select("id", "version_id", F.col("text").alias("entity")).distinct()
        n = versions.groupBy("id").agg(F.countDistinct("version_id").alias("n"))
        common = found.groupBy("id", "entity").agg(F.count("*").alias("c")).join(n, "id").filter("c = n").groupBy("id").agg(F.sort_array(F.collect_list("entity")).alias("shared_entities"))
        rows = rows.join(common, "id", "left")
        prompt = F.concat_ws("\n", F.col("text"), F.array_join(F.coalesce("shared_entities", F.array().cast("array<string>")), ", "))
    else:
        prompt = F.col("text")
    got = apply_model(rows.withColumn("_prompt", F.when(strip("text") != "", prompt)), "_prompt", model, system, "_answer")
    got = got.withColumn("_j", F.from_json(jsonx.extract_object("_answer")["json"], CONFLICTS.removeprefix("struct<").removesuffix(">").replace("modified_text: string, conflicts:", "modified_text string, conflicts")))
    new = F.coalesce(F.col("_j.modified_text"), F.col("text"))
    unknown = F.array(F.struct(*[F.lit("unknown" if c == "type" else "").alias(c) for c in ("entity_text", "original_span", "injected_span", "type", "note", "target_entity")]))
    got = got.withColumn("injected_text", new).withColumn("_c", F.coalesce(F.col("_j.conflicts"), unknown))

    def located(c):
        start, end = locate_span(c["injected_span"], F.col("injected_text"))
        return F.struct(*[c[x].alias(x) for x in ("entity_text", "original_span", "injected_span", "type", "note", "target_entity")], start.alias("span_start"), end.alias("span_end"))

    return got.withColumn("conflicts", F.transform("_c", located)).drop("_prompt", "_answer", "_answer_error", "_j", "_c")


def check_problems(tasks: DataFrame, model: TextModel, text: str = "text", problem: str = "problem", system: str = "Does the text have the problem? Answer as JSON.") -> DataFrame:
    """``problem_exists`` and ``evidence`` of each task; an unusable answer counts as no problem."""
    got = apply_model(tasks.withColumn("_prompt", F.concat_ws("\n", problem, text)), "_prompt", model, system, "_answer")
    verdict = jsonx.flat_verdict(F.coalesce("_answer", F.lit("")))
    return got.withColumn("_v", verdict).select("*", F.col("_v.problem_exists"), F.col("_v.evidence")).drop("_prompt", "_answer", "_answer_error", "_v")


def version_similarity(fused: DataFrame, id_col: str, embedder: Embedder, text_col: str = "fused_content", original: str = "input_text") -> DataFrame:
    """``(id, version_id, semantic, tfidf, jaccard, levenshtein)``: each fused text beside its original and versions, by four methods.

    Where the embedder fails, word pairs stand in for meaning.
    """
    rows = E.candidates(fused, id_col, text_col, original)
    both = embed_column(embed_column(rows, "text", embedder, "vt"), "fused", embedder, "vf")
    methods = E.similarity_columns("text", "fused")
    out = both.select(id_col, "version_id", similarity.cosine("vt", "vf").alias("_s"), F.col("vt").isNotNull().alias("_e"), *[c.alias(n) for n, c in methods.items()])
    return out.select(id_col, "version_id", F.when(F.col("_e"), F.col("_s")).otherwise(F.col("tfidf")).alias("semantic"), "tfidf", "jaccard", "levenshtein")


METHODS = ["semantic", "tfidf", "jaccard", "levenshtein"]


def parsed_alignment(text: str) -> Column:
    """The alignment after the separator of a text, as an array; empty where there is none or it isn't JSON."""
    rest = detach(text)[1]
    return F.coalesce(F.when(F.try_parse_json(rest).isNotNull(), F.from_json(rest, ALIGNMENT)), F.array().cast(ALIGNMENT))


def evaluate_items(items: DataFrame, model: TextModel, embedder: Embedder, id_col: str = "id") -> DataFrame:
    """One row of each item ``(id, input_text, fused_content, rewritten_v1..3)``: five checks of the whole text, eight of each aligned
    sentence, similarity by four methods.

    An item whose original or fused text is blank isn't evaluated: ``evaluation_success`` is false, its counts are null.
    A repeated id counts once.
    """
    items = items.dropDuplicates([id_col])
    ok = (strip(F.coalesce("input_text", F.lit(""))) != "") & (strip(F.coalesce("fused_content", F.lit(""))) != "")
    good = items.filter(ok)
    body = good.withColumn("fused_content", F.coalesce(detach("fused_content")[0], F.col("fused_content")))
    whole = E.tasks(good.select(id_col, F.concat_ws("\n\n", "input_text", "fused_content").alias("text")), E.GLOBAL_PROBLEMS)
    sentences = good.select(id_col, F.explode(parsed_alignment("fused_content")).alias("s")).select(id_col, F.concat_ws("\n", "s.text", F.array_join("s.evidence", "\n")).alias("text"))
    g = E.classify(check_problems(whole, model), id_col).select(id_col, F.col("by_type").alias("global_problems"), F.col("total_count").alias("global_problem_count"))
    s = E.classify(check_problems(E.tasks(sentences, E.SENTENCE_PROBLEMS), model), id_col).select(id_col, F.col("by_type").alias("sentence_problems"), F.col("total_count").alias("sentence_problem_count"))
    means = E.analysis(body, E.method_means(version_similarity(body, id_col, embedder), id_col, METHODS, "semantic"), id_col)
    means = means.select(id_col, *[F.col(m).alias(f"{m}_similarity") for m in METHODS], "verdict", "methods_differ", "original_low", "observations", F.col("success").alias("similarity_success"))
    out = items.select(id_col, ok.alias("evaluation_success")).join(g, id_col, "left").join(s, id_col, "left").join(means, id_col, "left")
    none, zero = F.create_map().cast("map<string, bigint>"), F.lit(0).cast("bigint")
    for c in ("global_problems", "sentence_problems"):
        out = out.withColumn(c, F.when(F.col("evaluation_success"), F.coalesce(c, none)))
    for c in ("global_problem_count", "sentence_problem_count"):
        out = out.withColumn(c, F.when(F.col("evaluation_success"), F.coalesce(c, zero)))
    return out.withColumn("total_problem_count", F.col("global_problem_count") + F.col("sentence_problem_count"))


def trace_rows(calls: DataFrame) -> DataFrame:
    """A trace table from tool calls: one row for each node and item with calls and seconds, instead of files that overwrite each other."""
    return calls.groupBy("rec_id", "node").agg(F.count("*").alias("n_calls"), F.sum("duration").alias("seconds"))
