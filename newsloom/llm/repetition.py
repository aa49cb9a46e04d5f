"""Repetition inside single documents: robust multivariate outliers, then the exact share of repeated content.

Every text gets a vector of statistics that vary in ordinary texts too: words (characters where Chinese, Japanese or
Thai writing prevails) used before, groups of five (two) characters used before, how far it compresses, and its length;
shares are transformed by arcsine square root, the length by its logarithm. For every language and source, every
language, and all texts together, a minimum-covariance-determinant estimate is fitted: on a sample of ``SAMPLE`` vectors
of each group (all of smaller ones) concentration steps run from ``STARTS`` random subsets to convergence and the
smallest determinant wins; it then takes one concentration step and the usual reweighting step over all vectors of the
group, as the published scheme for large sets does. A text is rejected if its squared Mahalanobis distance exceeds the
chi-square cutoff, and a statistic of repetition lies above the centre, under the estimate of its language and source or
of its language (which covers sources where most texts repeat themselves); the overall one judges the texts that have
neither. Only rejected texts go on to the exact check: the share of characters in phrases that occurred before, of which
``repetitive`` wants a third.

Scale: texts are read twice where they lie and never shuffled; only vectors and models are. Every step is a partial
aggregation, so a source with a third of all texts is no task of its own. Models have one row for each group.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.session import cut, small_batches, spread, table

WORDS, CHARS = 5, 10
SHARE = 1 / 3
DIMS = 4
#: An estimate needs five vectors for each dimension; smaller groups are judged by the overall one.
LEAST_GROUP = 5 * DIMS
#: Vectors of a group that the random starts run on, the starts, and those of them that run to convergence.
SAMPLE, STARTS, BEST = 1500, 40, 5
#: Chi-square with 4 degrees of freedom at 0.999, 0.975 and 0.5: for rejection, the reweighting step and the inner half.
CUTOFF, REWEIGHT, MEDIAN = 18.467, 11.143, 3.3567
#: Added to each variance: a group's statistics may be all equal.
RIDGE = 0.01**2

_WORD = re.compile(r"[^\s\d!-/:-@\[-`{-~¡-¿‐-⁞।॥،؛؟۔　-〿！-＠［-｀｛-･]+")
_DROP = re.compile(r"[\s\d]+")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")


def inner_factor(inside: float, limit: float) -> float:
    """By which the covariance of the part ``inside`` a squared distance of ``limit`` is too small, for four dimensions."""
    half = limit / 2
    return inside / (1 - math.exp(-half) * (1 + half + half * half / 2))


HALF_FACTOR = inner_factor(0.5, MEDIAN)
WHOLE_FACTOR = inner_factor(0.975, REWEIGHT)


def units_of(text: str) -> tuple[list[str] | str, bool]:
    """(units, dense): words in lower case, or the characters themselves where scripts without spaces prevail."""
    low = text.lower()
    if not low.isascii():
        dense = _DROP.sub("", low)
        if 3 * len(_DENSE.findall(dense)) > len(dense):
            return dense, True
    return _WORD.findall(low), False


def repeated(text: str) -> tuple[int, int]:
    """(characters in repetitions, all characters) of a text.

    Letter case, white space and digits don't count. A phrase is five words, or ten characters where Chinese,
    Japanese or Thai writing prevails; of its occurrences the first is none.
    """
    units, dense = units_of(text)
    n = CHARS if dense else WORDS
    lengths = None if dense else [len(w) for w in units]
    grams = [units[i : i + n] for i in range(len(units) - n + 1)] if dense else list(zip(*(units[i:] for i in range(n))))
    total = len(units) if dense else sum(lengths)
    if not total or len(set(grams)) == len(grams):
        return 0, total
    seen, marked, end = set(), 0, 0
    for i, g in enumerate(grams):
        if g in seen:
            a, b = max(i, end), i + n
            marked += b - a if dense else sum(lengths[a:b])
            end = b
        else:
            seen.add(g)
    return marked, total


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def used_before(letters: str, n: int) -> float:
    """Share of the groups of ``n`` characters that occurred before, by 64-bit sums."""
    m = len(letters) - n + 1
    if m < 1:
        return 0.0
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = codes[:m] * np.uint64(_MULTIPLIERS[0])
    for i in range(1, n):
        h += codes[i : m + i] * np.uint64(_MULTIPLIERS[i])
    h.sort()
    return float(np.count_nonzero(h[1:] == h[:-1])) / m


def vector(text: str) -> tuple[float, ...]:
    """The statistics of a text, transformed; a text without letters has zeros."""
    units, dense = units_of(text)
    letters, n = (units, 2) if dense else ("".join(units), 5)
    words = 1 - len(set(units)) / len(units) if units else 0.0
    raw = text.encode("utf-8", "surrogatepass")
    smaller = 1 - min(len(zlib.compress(raw, 1)) / len(raw), 1.0) if raw else 0.0
    return (*(math.asin(math.sqrt(x)) for x in (words, used_before(letters, n), smaller)), math.log1p(len(letters)))


VECTOR_SCHEMA = "field_name string, row_id bigint, lang string, source string, " + ", ".join(f"x{i} double" for i in range(DIMS))
XS = [f"x{i}" for i in range(DIMS)]
KEYS = ["lang", "source"]
#: Stands for any source or language in the names of wider groups; labels are lower case, so it clashes with none.
ALL = "ALL"
#: Statistics of repetition among the dimensions.
SIGNS = 3


def prepared(texts: DataFrame) -> DataFrame:
    """``texts(field_name, row_id, lang, source, text)`` with labels in lower case; null, empty and blank texts are left out."""
    norm = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c)
    return spread(texts.filter("text is not null and text rlike '(?U)\\\\S'").select("field_name", "row_id", norm("lang"), norm("source"), "text"))


def vectors(texts: DataFrame) -> DataFrame:
    """The vector of each text (``VECTOR_SCHEMA``); of several rows of one key the largest vector counts."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["field_name", "row_id", "lang", "source"]].copy()
            out[XS] = np.array([vector(t) for t in pdf["text"]], dtype=float).reshape(len(pdf), DIMS)
            yield out

    rows = prepared(texts).mapInPandas(run, VECTOR_SCHEMA)
    once = rows.groupBy("field_name", "row_id").agg(F.max(F.struct(*XS, *KEYS)).alias("r"))
    return once.select("field_name", "row_id", *[F.col("r")[c].alias(c) for c in (*KEYS, *XS)])


def distance2(x: list[Column], mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance as one expression."""
    d = [x[i] - mean[i] for i in range(DIMS)]
    out = F.lit(0.0)
    for i in range(DIMS):
        for j in range(DIMS):
            out = out + d[i] * d[j] * precision[i * DIMS + j]
    return out


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step: mean, covariance and log determinant of the ``h`` vectors nearest to an estimate."""
    d = x - mean
    d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + RIDGE * np.eye(DIMS)), d)
    near = x[np.argpartition(d2, h - 1)[:h]]
    cov = np.cov(near, rowvar=False, bias=True)
    return near.mean(axis=0), cov, float(np.linalg.slogdet(cov + RIDGE * np.eye(DIMS))[1])


def smallest_determinant(x: np.ndarray, starts: int = STARTS, best: int = BEST, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Minimum-covariance-determinant estimate (mean, covariance, log determinant) of half of ``x``.

    Two steps from each random start of five vectors, the ``best`` ones to convergence. Deterministic for rows in one order.
    """
    rng = np.random.default_rng(seed)
    h = (len(x) + DIMS + 1) // 2
    tried = []
    for _ in range(starts):
        some = x[rng.choice(len(x), DIMS + 1, replace=False)]
        got = (some.mean(axis=0), np.cov(some, rowvar=False, bias=True), math.inf)
        for _ in range(2):
            got = concentrate(x, *got[:2], h)
        tried.append(got)
    out = []
    for got in sorted(tried, key=lambda g: g[2])[:best]:
        while True:
            now = concentrate(x, *got[:2], h)
            if now[2] >= got[2] - 1e-9:
                break
            got = now
        out.append(got)
    return min(out, key=lambda g: g[2])


MODEL_SCHEMA = "lang string, source string, mean array<double>, precision array<double>"


def fit(v: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Estimate ``(lang, source, mean, precision)`` of each group of ``v`` with at least ``LEAST_GROUP`` vectors: language and
    source, language (source ``ALL``), and all texts (both ``ALL``).

    Two steps run over all vectors, the starts on about ``sample`` of each group, drawn by a hash of the key.
    """
    wider = [F.struct(x.alias("lang"), y.alias("source")) for x, y in ((F.col("lang"), F.col("source")), (F.col("lang"), F.lit(ALL)), (F.lit(ALL), F.lit(ALL)))]
    both = v.select("field_name", "row_id", *XS, F.explode(F.array(*wider)).alias("g"))
    both = both.select("field_name", "row_id", *XS, "g.*")
    counts = both.groupBy(*KEYS).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_GROUP)
    drawn = F.pmod(F.xxhash64("field_name", "row_id"), F.lit(1 << 30)) < F.lit(float(sample) * (1 << 30)) / F.col("n")
    small = both.join(counts, KEYS).filter(drawn | (F.col("n") <= 2 * sample)).groupBy(*KEYS).agg(F.collect_list(F.array(*XS)).alias("xs"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, source, xs in zip(pdf["lang"], pdf["source"], pdf["xs"]):
                x = np.array([list(r) for r in xs], dtype=float)
                if len(x) >= LEAST_GROUP:
                    x = x[np.lexsort(x.T)]
                    mean, cov, _ = smallest_determinant(x)
                    rows.append((lang, source, mean.tolist(), np.linalg.inv(HALF_FACTOR * cov + RIDGE * np.eye(DIMS)).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["lang", "source", "mean", "precision"])

    tasks = max(v.sparkSession.sparkContext.defaultParallelism, int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = cut(small.repartition(tasks, *KEYS).mapInPandas(start, MODEL_SCHEMA), "start")  # small rows, much work: the number keeps them apart
    xs = [F.col(x) for x in XS]
    d2 = distance2(xs, F.col("mean"), F.col("precision"))
    half = both.join(model, KEYS).groupBy(*KEYS).agg(F.percentile_approx(d2, 0.5, 1000).alias("limit"))
    model = cut(_refit(both.join(model.join(half, KEYS), KEYS).filter(d2 <= F.col("limit")), HALF_FACTOR), "step")
    return cut(_refit(both.join(model, KEYS).filter(d2 <= REWEIGHT), WHOLE_FACTOR), "model")


def _refit(kept: DataFrame, factor: float) -> DataFrame:
    """Mean and precision of each group's kept vectors."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    moments = kept.groupBy(*KEYS).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(XS)], *[F.covar_pop(XS[i], XS[j]).alias(f"c{i}{j}") for i, j in pairs])

    @F.pandas_udf("array<double>")
    def inverse(cov: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.inv(factor * np.array(c, dtype=float).reshape(DIMS, DIMS) + RIDGE * np.eye(DIMS)).ravel() for c in cov])

    flat = F.array(*[F.col(f"c{min(i, j)}{max(i, j)}") for i in range(DIMS) for j in range(DIMS)])
    return moments.select(*KEYS, F.array(*[F.col(f"m{i}") for i in range(DIMS)]).alias("mean"), inverse(flat).alias("precision"))


SCORE_SCHEMA = "field_name string, row_id bigint, lang string, source string, n_chars bigint, repeated_chars bigint, share double, distance2 double, rejected boolean"


def scored(texts: DataFrame, every: bool = True) -> DataFrame:
    """``SCORE_SCHEMA`` of each text: its robust distance, whether it is rejected, and its exact share of repeated content.

    ``every`` false leaves out the texts that aren't rejected, without measuring their shares. ``distance2`` is the
    larger of the distances under the estimates that apply; with fewer than ``LEAST_GROUP`` texts in all there is none,
    and every text is rejected. Of several rows of one key the one with the largest share counts.
    """
    small_batches(texts.sparkSession)
    model = fit(cut(vectors(texts), "vectors"))

    @F.pandas_udf("binary")
    def packed(mean: pd.Series, precision: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([m, p]).astype("<f8").tobytes() for m, p in zip(mean, precision)])

    model = cut(model.select(*KEYS, packed("mean", "precision").alias("m")), "packed")
    row = model.filter(F.col("lang") == ALL).take(1)
    overall = bytes(row[0]["m"]) if row else None
    names = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def estimate(m: bytes) -> tuple[np.ndarray, np.ndarray]:
            if m not in known:
                values = np.frombuffer(m, dtype="<f8")
                known[m] = values[:DIMS], values[DIMS:].reshape(DIMS, DIMS)
            return known[m]

        for batch in batches:
            rows = []
            for field, row_id, lang, source, text, own, wider in zip(*(c.to_pylist() for c in batch.columns)):
                largest, rejected = None, True
                estimates = [m for m in (own, wider) if m is not None] or ([overall] if overall else [])
                if estimates:
                    x = np.array(vector(text))
                    d = [(x - mean, precision) for mean, precision in map(estimate, estimates)]
                    d2 = [float(y @ precision @ y) for y, precision in d]
                    largest = max(d2)
                    rejected = any(v > CUTOFF and (y[:SIGNS] > 0).any() for v, (y, _) in zip(d2, d))
                if rejected or every:
                    marked, total = repeated(text)
                    rows.append((field, row_id, lang, source, total, marked, marked / total if total else 0.0, largest, rejected))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    by_lang = model.filter(F.col("source") == ALL).select("lang", F.col("m").alias("wider"))
    judged = prepared(texts).join(model, KEYS, "left").join(by_lang, "lang", "left")
    rows = judged.select("field_name", "row_id", *KEYS, "text", "m", "wider").mapInArrow(run, SCORE_SCHEMA)
    rest = names[2:]
    once = rows.groupBy("field_name", "row_id").agg(F.max(F.struct("share", *[c for c in rest if c != "share"])).alias("r"))
    return once.select("field_name", "row_id", *[F.col("r")[c].alias(c) for c in rest])


def repetitive(texts: DataFrame) -> DataFrame:
    """Rejected texts of which repeated content makes up a third or more."""
    return scored(texts, every=False).filter(F.col("share") >= SHARE)


def news_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = table(spark, sf_dir, "fused_news").select(F.lit("fused_content").alias("field_name"), F.col("fused_id").alias("row_id"), "lang", "source", F.col("fused_content").alias("text"))
    rewrites = table(spark, sf_dir, "top_rewrites").select(F.lit("final_rewritten_text").alias("field_name"), F.col("rewrite_id").alias("row_id"), "lang", "source", F.col("final_rewritten_text").alias("text"))
    return fused.unionByName(rewrites)


def exact_shares(texts: DataFrame) -> DataFrame:
    """``(field_name, row_id, n_chars, repeated_chars)`` of every text, without any estimate; of rows of one key the largest counts."""
    small_batches(texts.sparkSession)
    schema = "field_name string, row_id bigint, n_chars bigint, repeated_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [repeated(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for _, n in got], pa.int64()), pa.array([m for m, _ in got], pa.int64())], names=["field_name", "row_id", "n_chars", "repeated_chars"])

    rows = prepared(texts).select("field_name", F.col("row_id").cast("bigint"), "text").mapInArrow(run, schema)
    return rows.groupBy("field_name", "row_id").agg(F.max("n_chars").alias("n_chars"), F.max("repeated_chars").alias("repeated_chars"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive(news_texts(spark, sf_dir)).select("field_name", "row_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's share of repeated content with its robust distance."""
    return scored(news_texts(spark, sf_dir))


def p6_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, rejected texts and mean repeated share of each field, language and source."""
    return p6_shares(spark, sf_dir).groupBy("field_name", "lang", "source").agg(F.count("*").alias("n_texts"), F.count_if("rejected").alias("n_rejected"), F.avg("share").alias("mean_share"))


def p6_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_shares(news_texts(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_shares": p6_shares, "p6_exact_shares": p6_exact_shares, "p6_by_source": p6_by_source}

#: The definition of repeated content in SQL, phrase by phrase.
SQL = {
    "p6_exact_shares": r"""
    WITH text AS (
      SELECT DISTINCT 'fused_content' AS field_name, fused_id AS row_id, fused_content AS t FROM fused_news
      UNION SELECT DISTINCT 'final_rewritten_text', rewrite_id, final_rewritten_text FROM top_rewrites
    ), low AS (SELECT field_name, row_id, lower(t) AS l, regexp_replace(lower(t), '[\s\p{Z}\x{85}\p{Nd}]+', '', 'g') AS d FROM text WHERE regexp_matches(t, '[^\s\p{Z}\x{85}]')),
    kind AS (SELECT *, 3 * length(regexp_replace(d, '[^\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{0e00}-\x{0e7f}]', '', 'g')) > length(d) AS dense FROM low),
    unit AS (SELECT field_name, row_id, CASE WHEN dense THEN 10 ELSE 5 END AS n, CASE WHEN dense THEN string_split(d, '') ELSE regexp_extract_all(l, '[^\s\p{Z}\x{85}\p{Nd}!-/:-@\[-`{-~\x{a1}-\x{bf}\x{2010}-\x{205e}\x{0964}\x{060c}\x{061b}\x{061f}\x{06d4}\x{3000}-\x{303f}\x{ff01}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}]+') END AS u FROM kind),
    size AS (SELECT field_name, row_id, coalesce(list_sum(list_transform(u, lambda x: length(x))), 0) AS n_chars FROM unit),
    gram AS (SELECT field_name, row_id, n, u, unnest(range(1, len(u) - n + 2)) AS i FROM unit WHERE len(u) >= n),
    keyed AS (SELECT field_name, row_id, n, u, i, array_to_string(u[i:i + n - 1], ' ') AS g FROM gram),
    again AS (SELECT *, row_number() OVER (PARTITION BY field_name, row_id, g ORDER BY i) > 1 AS seen FROM keyed),
    mark AS (SELECT DISTINCT field_name, row_id, p, length(u[p]) AS c FROM (SELECT field_name, row_id, u, unnest(range(i, i + n)) AS p FROM again WHERE seen)),
    total AS (SELECT field_name, row_id, sum(c) AS c FROM mark GROUP BY ALL)
    SELECT s.field_name, s.row_id, max(CAST(s.n_chars AS BIGINT)) AS n_chars, max(CAST(coalesce(c, 0) AS BIGINT)) AS repeated_chars FROM size s LEFT JOIN total USING (field_name, row_id) GROUP BY ALL
""",
}
