"""Paragraphs into segments: greedy merges, key sentences, per-document and corpus statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import paragraphs, sentences, words

IDEAL, LONGEST, LEAST = 400, 800, 25


def split_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ord, paragraph)``, ``ord`` from 0; null and blank texts give no rows."""
    return docs.select(id_col, F.posexplode(paragraphs(text_col)).alias("ord", "paragraph"))


def merge_lengths(lengths: Column, ideal: int = IDEAL, longest: int = LONGEST) -> Column:
    """``array<struct<start, n, chars>>`` of the segments of lengths: the next joins while the segment is below ``ideal`` and the sum within ``longest``.

    A fold inside the JVM. A step adds an element to the accumulator only where a segment ends, so the work is the
    number of lengths and of segments squared over the segments' size, not the lengths squared.
    """
    segment = lambda start, n, chars: F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"), chars.cast("bigint").alias("chars"))
    none = F.array().cast("array<struct<start: int, n: int, chars: bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("out"))

    def step(acc: Column, length: Column) -> Column:
        joins = (acc["n"] > 0) & (acc["chars"] < ideal) & (acc["chars"] + length <= longest)
        ends = (acc["n"] > 0) & ~joins
        out = F.when(ends, F.concat(acc["out"], F.array(segment(acc["at"], acc["n"], acc["chars"])))).otherwise(acc["out"])
        return F.struct(
            F.when(joins, acc["chars"] + length).otherwise(length.cast("bigint")).alias("chars"), F.when(ends, acc["at"] + acc["n"]).otherwise(acc["at"]).alias("at"), F.when(joins, acc["n"] + 1).otherwise(1).alias("n"), out.alias("out")
        )

    return F.aggregate(lengths, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(segment(acc["at"], acc["n"], acc["chars"])))).otherwise(none))


def length_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ideal: int = IDEAL, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``(id, segment_id, char_count, n_paragraphs, original_indices, content)`` of merged paragraphs of at least ``least`` characters.

    ``char_count`` leaves the joining spaces out. No shuffle: a document's paragraphs stay in its row.
    """
    kept = F.filter(F.transform(paragraphs(text_col), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: F.length(x["p"]) >= least)
    rows = docs.select(id_col, kept.alias("kept")).filter(F.size("kept") > 0)
    rows = rows.select(id_col, "kept", F.posexplode(merge_lengths(F.transform("kept", lambda x: F.length(x["p"])), ideal, longest)).alias("no", "s"))
    rows = rows.select(id_col, (F.col("no") + 1).alias("segment_id"), "s", F.slice("kept", F.col("s.start") + 1, F.col("s.n")).alias("m"))
    return rows.select(
        id_col, "segment_id", F.col("s.chars").alias("char_count"), F.col("s.n").alias("n_paragraphs"),
        F.transform("m", lambda x: x["i"]).alias("original_indices"), F.array_join(F.transform("m", lambda x: x["p"]), " ").alias("content"),
    )


def merge_lengths_of(lengths: list[int], ideal: int = IDEAL, longest: int = LONGEST) -> list[int]:
    """``merge_lengths`` of plain numbers."""
    out, seg, size = [], 0, 0
    for n in lengths:
        if seg and size < ideal and size + n <= longest:
            size += n
        else:
            seg, size = seg + 1, n
        out.append(seg)
    return out


def segment_stats(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return segments.groupBy(id_col).agg(
        F.count("*").alias("segment_count"), F.sum("char_count").alias("total_chars"), F.avg("char_count").alias("average_chars"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"),
        F.avg(F.col("n_paragraphs").cast("double")).alias("average_paragraphs"),
    )


def merge_vectors(vectors: list[np.ndarray], lengths: list[int], tau: float, tau_low: float, ideal: int = IDEAL, longest: int = LONGEST) -> list[int]:
    """Segment number of each piece by a running, length-weighted centroid.

    A piece joins if it is similar (``tau``) and the sum fits; or both are below ``ideal`` and similar enough
    (``tau_low``), whatever the sum; or the segment is below half of ``ideal``, similar enough and the sum fits.
    """
    out, seg = [], 0
    centroid, size = None, 0
    for v, n in zip(vectors, lengths):
        if centroid is not None:
            norm = float(np.sqrt(centroid @ centroid) * np.sqrt(v @ v))
            sim = float(centroid @ v) / norm if norm else 0.0
            fits = size + n <= longest
            if (sim >= tau and fits) or (size < ideal and n < ideal and sim >= tau_low) or (size < 0.5 * ideal and sim >= tau_low and fits):
                centroid, size = (centroid * size + v * n) / max(1, size + n), size + n
                out.append(seg)
                continue
        seg += 1
        centroid, size = v, n
        out.append(seg)
    return out


def vector_segments(pieces: DataFrame, tau: float = 0.5, tau_low: float = 0.35, ideal: int = IDEAL, longest: int = LONGEST) -> DataFrame:
    """``(doc, segment_id, first_ord, n_pieces, char_count)`` of ``pieces(doc, ord, char_count, embedding)``; a group is one document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        seg = merge_vectors([np.asarray(v, dtype=float) for v in pdf.embedding], pdf.char_count.tolist(), tau, tau_low, ideal, longest)
        g = pdf.assign(segment_id=seg).groupby("segment_id").agg(doc=("doc", "first"), first_ord=("ord", "min"), n_pieces=("ord", "size"), char_count=("char_count", "sum")).reset_index()
        return g[["doc", "segment_id", "first_ord", "n_pieces", "char_count"]].astype({"segment_id": "int32", "first_ord": "int64", "n_pieces": "int64", "char_count": "int64"})

    return pieces.select("doc", "ord", "char_count", "embedding").groupBy("doc").applyInPandas(run, "doc bigint, segment_id int, first_ord bigint, n_pieces bigint, char_count bigint")


def min_max(values: Column) -> Column:
    """The numbers of an array scaled to 0..1; 1 where all are equal."""
    low, high = F.array_min(values), F.array_max(values)
    equal = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.transform(values, lambda v: F.when(equal, 1.0).otherwise((v - low) / (high - low)))


def key_sentences(docs: DataFrame, keywords: list[str], k: int = 2, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float, float] = (0.3, 0.3, 0.4)) -> DataFrame:
    """``(id, ord, sentence, score)`` of a text's ``k`` best sentences by length, position and keyword density; ties by position.

    A text's sentences stay in its row, so nothing is shuffled; order by ``ord`` for the order of the text.
    """
    rows = docs.select(id_col, sentences(text_col).alias("u")).filter(F.size("u") > 0)
    known = lambda tokens: F.size(F.filter(tokens, lambda t: t.isin(keywords)))
    dense = F.transform(F.transform("u", words), lambda t: F.when(F.size(t) > 0, known(t) / F.size(t)).otherwise(0.0))
    place = F.transform("u", lambda _, i: (F.size("u") - i) / F.size("u"))
    rows = rows.select(id_col, "u", F.transform("u", lambda x: F.length(x).cast("double")).alias("a"), place.alias("b"), dense.alias("c"))
    rows = rows.select(id_col, "u", *[min_max(F.col(c)).alias(c) for c in "abc"])
    score = F.transform("a", lambda x, i: F.round(x * weights[0] + F.get("b", i) * weights[1] + F.get("c", i) * weights[2], 9))
    best = F.slice(F.array_sort(F.transform(score, lambda x, i: F.struct((-x).alias("by"), i.alias("ord")))), 1, k)
    rows = rows.select(id_col, "u", F.explode(best).alias("r"))
    return rows.select(id_col, F.col("r.ord").alias("ord"), F.get("u", F.col("r.ord")).alias("sentence"), (-F.col("r.by")).alias("score"))


def corpus_keywords(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n, n_docs)``: the corpus's ``k`` commonest words; ties in alphabetical order."""
    per_doc = docs.select(id_col, F.explode(words(text_col)).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).orderBy(F.desc("n"), "word").limit(k)


def document_keywords(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, word, weight, rank)``: each document's ``k`` best words by count times smoothed inverse document frequency."""
    counts = docs.select(id_col, F.explode(words(text_col)).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    df = counts.groupBy("word").agg(F.count("*").alias("n_docs"))
    total = docs.select(F.countDistinct(id_col).alias("total"))  # one row
    weight = F.round(F.col("n") * F.log((1 + F.col("total")) / (1 + F.col("n_docs"))), 6)
    rows = counts.join(df, "word").join(F.broadcast(total)).select(id_col, "word", weight.alias("weight"))
    best = Window.partitionBy(id_col).orderBy(F.desc("weight"), "word")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def prefix_segments(segments: DataFrame, share: float = 0.7, id_col: str = "doc_id", ord_col: str = "ord") -> DataFrame:
    """The first part of each document's pieces, at least one: the degraded path."""
    n = F.count("*").over(Window.partitionBy(id_col))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(ord_col))
    return segments.select("*", n.alias("_n"), rank.alias("_r")).filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_r")

