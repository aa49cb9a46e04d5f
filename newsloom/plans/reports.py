"""Queries over the news tables from the operators, each with its SQL counterpart for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import jsonx, similarity
from newsloom.functions import score as S
from newsloom.functions import text as X
from newsloom.operators import evaluate as E
from newsloom.operators import masking as M
from newsloom.operators import rewrite as R
from newsloom.operators import segment as G
from newsloom.operators import versions as V
from newsloom.sources.session import small_batches, spread, table

LEX = S.Lexicon()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _terms(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits(column: str, words: list[str]) -> str:
    return f"len(list_filter({_terms(words)}, lambda w: contains({column}, w)))"


_SP = r"[ \t\n\x{0b}\f\r\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def _clean(c: str) -> str:
    return f"list_filter(list_transform({c}, lambda p: {_strip('p')}), lambda p: p <> '')"


_PARAGRAPHS = f"""
    squeezed AS (SELECT doc_id, regexp_replace(text, '[ \\t]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
    ladder AS (SELECT doc_id, {_clean("string_split(t, chr(10) || chr(10))")} AS b, {_clean("string_split(t, chr(10))")} AS l, {_clean("[t]")} AS w FROM squeezed),
    pars AS (SELECT doc_id, CASE WHEN len(b) > 1 THEN b WHEN len(l) > 1 THEN l ELSE w END AS p FROM ladder),
    par AS (SELECT doc_id, unnest(range(len(p))) AS ord, unnest(p) AS paragraph FROM pars)
"""
_MERGE = f"""
    RECURSIVE {_PARAGRAPHS},
    kept AS (SELECT doc_id, length(paragraph) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM par WHERE length(paragraph) >= 25),
    fold AS (
      SELECT doc_id, i, n AS cur, 1 AS seg, n FROM kept WHERE i = 1
      UNION ALL
      SELECT k.doc_id, k.i, CASE WHEN f.cur < 400 AND f.cur + k.n <= 800 THEN f.cur + k.n ELSE k.n END,
             CASE WHEN f.cur < 400 AND f.cur + k.n <= 800 THEN f.seg ELSE f.seg + 1 END, k.n
      FROM fold f JOIN kept k ON k.doc_id = f.doc_id AND k.i = f.i + 1
    ),
    segs AS (SELECT doc_id, seg AS segment_id, CAST(sum(n) AS BIGINT) AS char_count, CAST(count(*) AS INTEGER) AS n_paragraphs FROM fold GROUP BY ALL)
"""


def docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "title"))


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, paragraph FROM par")
def paragraph_split(s, d):
    return G.split_paragraphs(docs(s, d).filter("text is not null"))


@query(rf"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '([.?!])[ \t\n\f\r]+', '\1' || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, {_clean("string_split_regex(t, '[。！？!?；;]|[' || chr(10) || chr(13) || ']+')")} AS p FROM t)
    SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS ord, unnest(p) AS sentence FROM p
""")
def sentence_split(s, d):
    return docs(s, d).filter("text is not null").select("doc_id", F.posexplode(X.sentences("text")).alias("ord", "sentence"))


@query(f"WITH {_MERGE} SELECT doc_id, segment_id, char_count, n_paragraphs FROM segs")
def greedy_length_merge(s, d):
    return G.length_segments(docs(s, d)).select("doc_id", "segment_id", "char_count", "n_paragraphs")


@query(f"""
    WITH {_MERGE} SELECT doc_id, count(*) AS segment_count, CAST(sum(char_count) AS BIGINT) AS total_chars, CAST(avg(char_count) AS DOUBLE) AS average_chars,
      min(char_count) AS min_chars, max(char_count) AS max_chars, CAST(avg(n_paragraphs) AS DOUBLE) AS average_paragraphs FROM segs GROUP BY doc_id
""")
def segment_stats(s, d):
    return G.segment_stats(G.length_segments(docs(s, d)))


@query(f"""
    WITH {_MERGE}, st AS (SELECT doc_id, count(*) AS c, avg(char_count) AS a FROM segs GROUP BY doc_id)
    SELECT count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS n_segments, round(avg(c), 6) AS mean_segments, round(avg(a), 6) AS mean_of_means FROM st
""")
def corpus_segment_stats(s, d):
    st = segment_stats(s, d)
    return st.agg(F.count("*").alias("n_docs"), F.sum("segment_count").alias("n_segments"), F.round(F.avg("segment_count"), 6).alias("mean_segments"), F.round(F.avg("average_chars"), 6).alias("mean_of_means"))


@query("""
    WITH RECURSIVE v AS (
      SELECT vec_id // 10 AS doc, vec_id % 10 AS ord, 20 + (vec_id * 337) % 600 AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    ), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS i FROM v),
    fold AS (
      SELECT doc, i, ord, 1 AS seg, n AS cur, e AS c, n FROM r WHERE i = 1
      UNION ALL
      SELECT doc, i, ord, CASE WHEN j THEN seg ELSE seg + 1 END, CASE WHEN j THEN cur + n ELSE n END,
        CASE WHEN j THEN list_transform(list_zip(c, e), lambda z: (z[1] * cur + z[2] * n) / greatest(1, cur + n)) ELSE e END, n
      FROM (
        SELECT r.doc, r.i, r.ord, f.seg, f.cur, f.c, r.e, r.n,
          (list_cosine_similarity(f.c, r.e) >= 0.2 AND f.cur + r.n <= 800) OR (f.cur < 400 AND r.n < 400 AND list_cosine_similarity(f.c, r.e) >= -0.1)
          OR (f.cur < 200 AND list_cosine_similarity(f.c, r.e) >= -0.1 AND f.cur + r.n <= 800) AS j
        FROM fold f JOIN r ON r.doc = f.doc AND r.i = f.i + 1
      )
    )
    SELECT doc, seg AS segment_id, CAST(min(ord) AS BIGINT) AS first_ord, count(*) AS n_pieces, CAST(sum(n) AS BIGINT) AS char_count FROM fold GROUP BY ALL
""")
def greedy_vector_merge(s, d):
    v = table(s, d, "embeddings").select(F.expr("vec_id div 10").alias("doc"), F.expr("vec_id % 10").alias("ord"), F.expr("20 + (vec_id * 337) % 600").alias("char_count"), "embedding")
    return G.vector_segments(v, 0.2, -0.1)


@query("""
    WITH d AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT r, unnest(w) AS word FROM d), c AS (SELECT r, word, count(*) AS n FROM e GROUP BY ALL)
    SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM c GROUP BY word ORDER BY n DESC, word LIMIT 20
""")
def corpus_keywords(s, d):
    return G.corpus_keywords(docs(s, d))


@query("""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
    f AS (SELECT word, count(*) AS n_docs FROM c GROUP BY word), t AS (SELECT count(DISTINCT doc_id) AS total FROM documents),
    x AS (SELECT doc_id, word, round(n * ln((1 + total) / (1 + n_docs)), 6) AS weight FROM c JOIN f USING (word), t),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS rank FROM x)
    SELECT doc_id, word, weight, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5
""")
def keyword_topk(s, d):
    return G.document_keywords(docs(s, d))


_KEYWORDS = ["the", "of", "water", "from", "to", "relief", "survey"]


@query(rf"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '([.?!])[ \t\n\f\r]+', '\1' || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, {_clean("string_split_regex(t, '[。！？!?；;]|[' || chr(10) || chr(13) || ']+')")} AS p FROM t),
    q AS (SELECT doc_id, unnest(range(len(p))) AS ord, unnest(p) AS sentence, len(p) AS n FROM p),
    w AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS tk FROM q),
    f AS (SELECT doc_id, ord, sentence, CAST(length(sentence) AS DOUBLE) AS a, (n - ord) / n AS b, CASE WHEN len(tk) > 0 THEN len(list_filter(tk, lambda x: list_contains({_terms(_KEYWORDS)}, x))) / len(tk) ELSE 0.0 END AS c FROM w),
    m AS (SELECT *, min(a) OVER v AS a0, max(a) OVER v AS a1, min(b) OVER v AS b0, max(b) OVER v AS b1, min(c) OVER v AS c0, max(c) OVER v AS c1 FROM f WINDOW v AS (PARTITION BY doc_id)),
    s AS (SELECT doc_id, ord, sentence, round(0.3 * CASE WHEN a1 = a0 THEN 1 ELSE (a - a0) / (a1 - a0) END + 0.3 * CASE WHEN b1 = b0 THEN 1 ELSE (b - b0) / (b1 - b0) END + 0.4 * CASE WHEN c1 = c0 THEN 1 ELSE (c - c0) / (c1 - c0) END, 9) AS score FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM s)
    SELECT doc_id, CAST(ord AS INTEGER) AS ord, sentence, round(score, 6) AS score FROM r WHERE k <= 2
""")
def key_sentences_topk(s, d):
    return G.key_sentences(docs(s, d).filter("text is not null"), _KEYWORDS).withColumn("score", F.round("score", 6))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(S.STOP_WORDS)) + "]"
_KEYS = rf"list_filter(list_distinct(regexp_extract_all(lower(coalesce({{0}}, '')), '[\p{{{{L}}}}\p{{{{N}}}}_]+')), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"
_NEWS_PAR = f"""
    news AS (SELECT DISTINCT id, title, main_topic, content, regexp_replace(content, '[ \\t]+', ' ', 'g') AS t FROM news_raw WHERE content IS NOT NULL),
    steps AS (SELECT *, {_clean("string_split(t, chr(10) || chr(10))")} AS b, {_clean("string_split(t, chr(10))")} AS l, {_clean("[t]")} AS w FROM news),
    parts AS (SELECT id, title, main_topic, CASE WHEN len(b) > 1 THEN b WHEN len(l) > 1 THEN l ELSE w END AS ps FROM steps),
    par AS (SELECT id, title, main_topic, CAST(unnest(range(len(ps))) AS INTEGER) AS ord, unnest(ps) AS p FROM parts)
"""


def _news(s, d) -> DataFrame:
    """The paragraphs of each article; repeated rows count once."""
    n = table(s, d, "news_raw").select("id", "title", "main_topic", "content").filter("content is not null").distinct()
    return n.select("id", "title", "main_topic", F.posexplode(X.paragraphs("content")).alias("ord", "p"))


def _keys(c: str):
    """Keywords of a text by its words alone: longer than a character and no function words."""
    return F.filter(F.array_distinct(X.words(F.coalesce(c, F.lit("")))), lambda w: (F.length(w) > 1) & ~w.isin(sorted(S.STOP_WORDS)))


def _context_sql() -> str:
    parts = [f"least({_hits('p', LEX.times)} * 0.1, 0.2)", f"least({_hits('p', LEX.context_places)} * 0.1, 0.2)", "least(len(regexp_extract_all(p, '[0-9]+')) * 0.05, 0.2)", f"least({_hits('p', LEX.context_says)} * 0.1, 0.2)"]
    return "least(" + " + ".join(parts) + ", 1.0)"


def _threshold_sql() -> str:
    urgent, says, places = (f"CASE WHEN {_hits('p', w)} > 0 THEN {v} ELSE 0 END" for w, v in ((LEX.urgent, -0.08), (LEX.threshold_says, -0.03), (LEX.threshold_places, -0.02)))
    return f"greatest(0.05, least(0.5, 0.2 + CASE WHEN length(p) < 50 THEN 0.05 ELSE 0 END + {urgent} + CASE WHEN regexp_matches(p, '[0-9]') THEN -0.05 ELSE 0 END + {says} + {places}))"


def _quality_sql() -> str:
    band = "CASE WHEN length(p) BETWEEN 50 AND 500 THEN 0.3 WHEN length(p) BETWEEN 25 AND 49 OR length(p) BETWEEN 501 AND 800 THEN 0.2 ELSE 0.1 END"
    complete = f"least(len(list_filter(string_split_regex(p, '[。！？!?]'), lambda x: length({_strip('x')}) > 10)) * 0.1, 0.3)"
    tokens = r"len(list_filter(string_split_regex(p, '[ \t\n\f\r]+'), lambda x: x <> ''))"
    return f"least({band} + {complete} + CASE WHEN {tokens} > 0 THEN least(len(regexp_extract_all(p, '[一-鿿]')) / {tokens} * 0.4, 0.4) ELSE 0 END, 1.0)"


def _keep_sql() -> str:
    return f"({_hits('p', LEX.keep)} > 0 OR regexp_matches(p, '{LEX.figures}') OR regexp_matches(p, '{LEX.places}') OR {_hits('p', LEX.says)} > 0)"


def _drop_sql(c: str = "q") -> str:
    return f"(regexp_matches({c}, '{LEX.drop}') OR {_hits(c, LEX.critical)} >= 3 OR (length({c}) < 50 AND {_hits(c, LEX.formal)} > 0))"


@query(f"WITH {_NEWS_PAR} SELECT id, ord, round(CAST({_context_sql()} AS DOUBLE), 6) AS context_score FROM par")
def context_relevance(s, d):
    return _news(s, d).select("id", "ord", F.round(S.context_relevance(F.col("p"), LEX), 6).alias("context_score"))


@query(f"WITH {_NEWS_PAR} SELECT id, ord, length(p) AS n_chars, round(CAST({_quality_sql()} AS DOUBLE), 6) AS quality FROM par")
def paragraph_quality(s, d):
    return _news(s, d).select("id", "ord", F.length("p").cast("bigint").alias("n_chars"), F.round(S.content_quality(F.col("p")), 6).alias("quality"))


@query(f"WITH {_NEWS_PAR} SELECT id, ord, length(p) AS n_chars, round(CAST({_threshold_sql()} AS DOUBLE), 6) AS threshold FROM par")
def dynamic_threshold(s, d):
    return _news(s, d).select("id", "ord", F.length("p").cast("bigint").alias("n_chars"), F.round(S.threshold(F.col("p"), LEX), 6).alias("threshold"))


@query(f"WITH {_NEWS_PAR}, b AS (SELECT id, ord, p, {_strip('p')} AS q FROM par) SELECT id, ord, length(p) AS n_chars, {_keep_sql()} AS whitelisted, {_drop_sql()} AS blacklisted FROM b")
def blacklist_flags(s, d):
    p = F.col("p")
    return _news(s, d).select("id", "ord", F.length("p").cast("bigint").alias("n_chars"), S.whitelisted(p, LEX).alias("whitelisted"), S.blacklisted(p, LEX).alias("blacklisted"))


_SHARE = "CASE WHEN len({0}) > 0 THEN len(list_intersect(own, {0})) / greatest(len(own), 1) ELSE 0.0 END"
_ALIKE = "CASE WHEN len(list_distinct(list_concat(ws, {0}))) = 0 THEN 0.0 ELSE len(list_intersect(ws, {0})) / len(list_distinct(list_concat(ws, {0}))) END"
_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""
    WITH {_NEWS_PAR}, w AS (SELECT *, {_strip('p')} AS q, {_KEYS.format('p')} AS own, {_KEYS.format('title')} AS kt, {_KEYS.format('main_topic')} AS km, {_WORDS.format('p')} AS ws, {_WORDS.format('title')} AS wt, {_WORDS.format('main_topic')} AS wm FROM par),
    b AS (SELECT *, greatest({_ALIKE.format('wt')}, {_ALIKE.format('wm')}) AS sim, least({_SHARE.format('kt')} * 0.4 + {_SHARE.format('km')} * 0.3 + least({_hits('p', LEX.important)} * 0.08, 0.4), 1.0) AS kw FROM w),
    c AS (SELECT *, round(CAST(0.25 * sim + 0.35 * kw + 0.25 * {_context_sql()} + 0.15 * {_quality_sql()} AS DOUBLE), 9) AS score, round(CAST({_threshold_sql()} AS DOUBLE), 9) AS thr, len(list_filter(list_concat(kt, km), lambda k: contains(p, k))) > 0 AS named FROM b)
    SELECT id, ord, round(score, 6) AS score, CASE WHEN length(p) < 25 THEN 'short' WHEN named OR {_keep_sql()} THEN 'keep' WHEN {_drop_sql()} THEN 'blacklist' WHEN score < thr THEN 'irrelevant' ELSE 'keep' END AS decision FROM c
""")
def relevance_decision(s, d):
    """The decision list on every paragraph; shared words stand in for the embedder, so that both engines can compute it."""
    p, wt, wm = F.col("p"), similarity.word_set(F.coalesce("title", F.lit(""))), similarity.word_set(F.coalesce("main_topic", F.lit("")))
    rows = _news(s, d).select("*", _keys("p").alias("own"), _keys("title").alias("kt"), _keys("main_topic").alias("km"), similarity.word_set("p").alias("ws"), wt.alias("wt"), wm.alias("wm"))
    sim = F.greatest(similarity.jaccard_sets("ws", "wt"), similarity.jaccard_sets("ws", "wm"))
    kw = S.keyword_relevance(p, F.col("own"), F.col("kt"), F.col("km"), LEX)
    score = F.round(S.confidence(sim, kw, S.context_relevance(p, LEX), S.content_quality(p)), 9)
    named = S.whitelisted(p, LEX, F.concat("kt", "km"))
    kept = F.when(F.length(p) < S.LEAST_CHARS, "short").when(named, "keep").when(S.blacklisted(p, LEX), "blacklist").when(F.col("score") < F.round(S.threshold(p, LEX), 9), "irrelevant").otherwise("keep")
    return rows.withColumn("score", score).select("id", "ord", F.round("score", 6).alias("score"), kept.alias("decision"))


def _filled(c: str) -> str:
    return f"({c} IS NOT NULL AND {_strip(c)} <> '')"


@query(f"""
    SELECT fused_id, CAST({_filled('rewritten_v1')} AS INTEGER) + CAST({_filled('rewritten_v2')} AS INTEGER) + CAST({_filled('rewritten_v3')} AS INTEGER) AS n_usable,
      CASE WHEN {_filled('rewritten_v1')} THEN rewritten_v1 WHEN {_filled('rewritten_v2')} THEN rewritten_v2 WHEN {_filled('rewritten_v3')} THEN rewritten_v3 ELSE '' END AS fallback_text
    FROM fused_news
""")
def usable_versions(s, d):
    return V.usable_versions(table(s, d, "fused_news")).select("fused_id", "n_usable", "fallback_text")


_SETS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_JACCARD = f"CASE WHEN {_strip('a')} = '' OR {_strip('b')} = '' OR len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END"
_PAIRS = "pair AS (SELECT fused_id, v AS version_id, fused_content AS a, t AS b FROM (SELECT fused_id, fused_content, unnest(['input_text', 'rewritten_v1', 'rewritten_v2', 'rewritten_v3']) AS v, unnest([input_text, rewritten_v1, rewritten_v2, rewritten_v3]) AS t FROM fused_news) WHERE t IS NOT NULL AND fused_content IS NOT NULL)"


def _version_pairs(s, d) -> DataFrame:
    f = spread(table(s, d, "fused_news").select("fused_id", "fused_content", "input_text", *V.VERSIONS).filter("fused_content is not null"))
    rows = f.selectExpr("fused_id", "fused_content as a", "stack(4, 'input_text', input_text, 'rewritten_v1', rewritten_v1, 'rewritten_v2', rewritten_v2, 'rewritten_v3', rewritten_v3) as (version_id, b)")
    return rows.filter("b is not null")


def _word_sets(s, d) -> DataFrame:
    """Word sets of each fused text and of its versions; every text is tokenised once."""
    texts = ["input_text", *V.VERSIONS]
    fused = spread(table(s, d, "fused_news").select("fused_id", "fused_content", *texts).filter("fused_content is not null"))
    sets = fused.select("fused_id", similarity.word_set("fused_content").alias("x"), *[similarity.word_set(t).alias(t) for t in texts])
    return sets.selectExpr("fused_id", "x", f"stack({len(texts)}, {', '.join(f"'{t}', {t}" for t in texts)}) as (version_id, y)").filter("y is not null")


@query(f"WITH {_PAIRS}, w AS (SELECT *, {_SETS.format('a')} AS x, {_SETS.format('b')} AS y FROM pair) SELECT fused_id, version_id, round({_JACCARD}, 6) AS jaccard FROM w")
def jaccard_versions(s, d):
    return _word_sets(s, d).select("fused_id", "version_id", F.round(similarity.jaccard_sets("x", "y"), 6).alias("jaccard"))


@query()
def levenshtein_texts(s, d):
    """Edit similarity of the whole texts in any script; DuckDB's levenshtein counts bytes, so there is no SQL."""
    small_batches(s)
    return _version_pairs(s, d).select("fused_id", "version_id", F.round(similarity.levenshtein_long("a", "b"), 6).alias("similarity"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(s, d):
    e = table(s, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(similarity.cosine("embedding", "other"), 6).alias("cosine"))


_GRAMS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_CANDIDATES = f"""
    item AS (SELECT * FROM fused_news WHERE {_strip("coalesce(fused_content, '')")} <> '' AND {_strip("coalesce(input_text, '')")} <> ''),
    cand AS (SELECT fused_id, v AS version_id, fused_content AS a, t AS b FROM (SELECT fused_id, fused_content, unnest(['original', 'rewritten_v1', 'rewritten_v2', 'rewritten_v3']) AS v, unnest([input_text, rewritten_v1, rewritten_v2, rewritten_v3]) AS t FROM item) WHERE {_strip("coalesce(t, '')")} <> ''),
    words AS (SELECT *, regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}_]+') AS wa, regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}_]+') AS wb FROM cand),
    terms AS (SELECT fused_id, version_id, 0 AS side, unnest({_GRAMS.format('wa')}) AS term FROM words UNION ALL SELECT fused_id, version_id, 1, unnest({_GRAMS.format('wb')}) FROM words),
    counts AS (SELECT fused_id, version_id, term, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM terms GROUP BY ALL),
    sums AS (SELECT fused_id, version_id, sum(na * nb) AS dot, sum(CASE WHEN na > 0 THEN (na * CASE WHEN nb > 0 THEN 1 ELSE 1 + ln(1.5) END) ** 2 ELSE 0 END) AS qa, sum(CASE WHEN nb > 0 THEN (nb * CASE WHEN na > 0 THEN 1 ELSE 1 + ln(1.5) END) ** 2 ELSE 0 END) AS qb FROM counts GROUP BY ALL),
    scored AS (
      SELECT w.fused_id, w.version_id, coalesce(CASE WHEN qa * qb > 0 THEN dot / (sqrt(qa) * sqrt(qb)) ELSE 0 END, 0) AS tfidf,
        CASE WHEN len(list_distinct(list_concat(wa, wb))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(wa), list_distinct(wb))) / len(list_distinct(list_concat(wa, wb))) END AS jaccard
      FROM words w LEFT JOIN sums USING (fused_id, version_id)
    )
"""


def _scored(s, d) -> DataFrame:
    rows = E.candidates(spread(table(s, d, "fused_news").select("fused_id", "fused_content", "input_text", *V.VERSIONS)), "fused_id")
    rows = rows.select("fused_id", "version_id", "fused", "text", similarity.word_set("fused").alias("x"), similarity.word_set("text").alias("y"))
    return rows.select("fused_id", "version_id", similarity.tfidf("fused", "text").alias("tfidf"), similarity.jaccard_sets("x", "y").alias("jaccard"))


@query(f"WITH {_CANDIDATES} SELECT fused_id, version_id, round(tfidf, 6) AS tfidf FROM scored")
def tfidf_similarity(s, d):
    small_batches(s)
    return _scored(s, d).select("fused_id", "version_id", F.round("tfidf", 6).alias("tfidf"))


@query(f"""
    WITH {_CANDIDATES}, m AS (SELECT fused_id, avg(tfidf) AS t, avg(jaccard) AS j, max(tfidf) FILTER (version_id = 'original') AS o FROM scored GROUP BY fused_id)
    SELECT fused_id, round(t, 6) AS tfidf, round(j, 6) AS jaccard, round(((t - j) / 2) ** 2, 9) > 0.1 AS methods_differ,
      CASE WHEN round(t, 9) >= 0.8 THEN 'high' WHEN round(t, 9) >= 0.6 THEN 'medium' WHEN round(t, 9) >= 0.4 THEN 'low' ELSE 'very low' END AS verdict, coalesce(round(o, 9) < 0.5, false) AS original_low,
      array_to_string(list_filter([CASE WHEN coalesce(round(o, 9) < 0.5, false) THEN 'original_low' END, CASE WHEN round(((t - j) / 2) ** 2, 9) > 0.1 THEN 'methods_differ' END, CASE WHEN round(t, 9) < 0.6 THEN 'check_key_facts' END, CASE WHEN round(j, 9) < 0.3 THEN 'check_wording' END], lambda x: x IS NOT NULL), '|') AS observations FROM m
""")
def similarity_by_method(s, d):
    """Means by method over the candidates and the variance of the means, for the two methods that both engines have."""
    small_batches(s)
    m = E.method_means(_scored(s, d), "fused_id", ["tfidf", "jaccard"], "tfidf")
    return m.select("fused_id", F.round("tfidf", 6).alias("tfidf"), F.round("jaccard", 6).alias("jaccard"), "methods_differ", "verdict", "original_low", F.array_join("observations", "|").alias("observations"))


_CONFLICTS = """
    once AS (SELECT injection_id, any_value(id) AS id, any_value(version_id) AS version_id, any_value(injected_text) AS injected_text, any_value(conflicts) AS conflicts FROM injected_versions GROUP BY injection_id),
    con AS (SELECT injection_id, id, version_id, injected_text, unnest(conflicts) AS c, unnest(range(len(conflicts))) AS ord FROM once WHERE conflicts IS NOT NULL),
    conf AS (SELECT injection_id, id, version_id, injected_text, ord, c.entity_text AS entity_text, c.injected_span AS injected_span, c.conflict_type AS conflict_type FROM con WHERE c IS NOT NULL)
"""


def _conflicts(s, d) -> DataFrame:
    rows = table(s, d, "injected_versions").select("injection_id", "id", "version_id", "injected_text", "conflicts").dropDuplicates(["injection_id"])
    rows = rows.select("injection_id", "id", "version_id", "injected_text", F.posexplode("conflicts").alias("ord", "c")).filter("c is not null")
    return rows.select("injection_id", "id", "version_id", "injected_text", F.col("ord").cast("bigint").alias("ord"), "c.entity_text", "c.injected_span", "c.conflict_type")


@query(f"WITH {_CONFLICTS} SELECT coalesce(conflict_type, 'unknown') AS conflict_type, coalesce(version_id, 'unknown') AS version_id, count(*) AS n_conflicts FROM conf GROUP BY CUBE (coalesce(conflict_type, 'unknown'), coalesce(version_id, 'unknown'))")
def conflict_by_type_version(s, d):
    return V.conflict_counts(_conflicts(s, d))


@query(f"""
    WITH {_CONFLICTS} SELECT id, entity_text, array_to_string(list_sort(list(DISTINCT version_id) FILTER (version_id IS NOT NULL)), '|') AS conflict_versions,
      array_to_string(list_sort(list(DISTINCT injected_span) FILTER (injected_span IS NOT NULL)), '|') AS different_values FROM conf WHERE entity_text <> '' GROUP BY id, entity_text HAVING count(DISTINCT version_id) > 1
""")
def entity_conflicts(s, d):
    c = V.entity_conflicts(_conflicts(s, d))
    return c.select("id", "entity_text", F.array_join("conflict_versions", "|").alias("conflict_versions"), F.array_join("different_values", "|").alias("different_values"))


@query(f"""
    WITH {_CONFLICTS}, l AS (SELECT id, entity_text, version_id, arg_max(injected_span, injection_id * 100000 + ord) AS value FROM conf WHERE entity_text <> '' AND version_id IS NOT NULL AND injected_span IS NOT NULL GROUP BY ALL HAVING value <> '')
    SELECT a.id, a.entity_text, a.version_id AS v1, b.version_id AS v2, a.value AS v1_value, b.value AS v2_value FROM l a JOIN l b ON a.id = b.id AND a.entity_text = b.entity_text AND a.version_id < b.version_id AND a.value <> b.value
""")
def version_pair_conflicts(s, d):
    c = _conflicts(s, d).filter("injected_span is not null").withColumn("at", F.col("injection_id") * 100000 + F.col("ord"))
    return V.version_pair_conflicts(c, "at").select("id", "entity_text", "v1", "v2", "v1_value", "v2_value")


@query(f"""
    WITH {_CONFLICTS} SELECT injection_id, ord, injected_span, CAST(CASE WHEN injected_span <> '' AND strpos(injected_text, injected_span) > 0 THEN strpos(injected_text, injected_span) - 1 END AS INTEGER) AS span_start,
      CAST(CASE WHEN injected_span <> '' AND strpos(injected_text, injected_span) > 0 THEN strpos(injected_text, injected_span) - 1 + length(injected_span) END AS INTEGER) AS span_end FROM conf
""")
def span_locate(s, d):
    return V.locate_conflicts(_conflicts(s, d)).select("injection_id", "ord", "injected_span", "span_start", "span_end")


@query(r"""
    WITH l AS (SELECT fused_id, unnest(['v1', 'v2', 'v3']) AS v, unnest([rewritten_v1, rewritten_v2, rewritten_v3]) AS t FROM fused_news),
    u AS (SELECT fused_id, v, t FROM l WHERE t IS NOT NULL AND trim(t) <> ''), e AS (SELECT DISTINCT fused_id, v, unnest(regexp_extract_all(t, '[0-9]+')) AS text FROM u),
    n AS (SELECT fused_id, count(DISTINCT v) AS n_versions FROM e GROUP BY fused_id), k AS (SELECT fused_id, text, count(DISTINCT v) AS c FROM e GROUP BY ALL)
    SELECT fused_id, text, n_versions FROM k JOIN n USING (fused_id) WHERE c = n_versions
""")
def shared_entities(s, d):
    long = V.long_versions(table(s, d, "fused_news"), "fused_id", V.VERSIONS).filter("trim(text) <> ''")
    rows = long.select("fused_id", "version_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).alias("text")).withColumn("label", F.lit("CARDINAL"))
    return V.shared_entities(rows, "fused_id").drop("label")


_TAGS = "tags AS (SELECT l_orderkey AS doc, l_linenumber AS tag_id, l_returnflag = 'N' AS kept FROM lineitem)"


def _tags(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("tag_id"), (F.col("l_returnflag") == "N").alias("kept"))


@query(f"WITH {_TAGS} SELECT doc, tag_id FROM tags WHERE NOT kept AND (doc, tag_id) NOT IN (SELECT (doc, tag_id) FROM tags WHERE kept)")
def mask_ids(s, d):
    t = _tags(s, d)
    return M.mask(t.filter(~F.col("kept")), t.filter("kept"), ["doc", "tag_id"]).select("doc", "tag_id")


@query(f"WITH {_TAGS} SELECT doc, array_to_string(list_sort(list(DISTINCT tag_id)), ',') AS keep_tag_ids FROM tags WHERE kept GROUP BY doc")
def keep_union(s, d):
    return M.keep_union(_tags(s, d).filter("kept"), ["doc"]).select("doc", F.array_join(F.col("keep_tag_ids").cast("array<string>"), ",").alias("keep_tag_ids"))


@query(f"""
    WITH {_TAGS}, k AS (SELECT doc, tag_id, count(*) OVER (PARTITION BY doc) AS n, row_number() OVER (PARTITION BY doc ORDER BY sha256(doc || '|' || tag_id || '|42'), tag_id) AS r FROM tags)
    SELECT doc, tag_id FROM k WHERE r <= greatest(1, n // 3)
""")
def deterministic_mask_sample(s, d):
    return M.sample_tags(_tags(s, d), ["doc"]).select("doc", "tag_id")


@query(f"WITH {_PARAGRAPHS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM par) SELECT doc_id, CAST(ord AS INTEGER) AS ord FROM n WHERE ord + 1 <= greatest(1, floor(n * 0.7))")
def degraded_prefix(s, d):
    return G.prefix_segments(G.split_paragraphs(docs(s, d).filter("text is not null"))).select("doc_id", "ord")


_REWRITES = "once AS (SELECT rewrite_id, any_value(id) AS id, any_value(version_score) AS version_score, any_value(success_ratio) AS success_ratio FROM top_rewrites GROUP BY rewrite_id)"


def _rewrites(s, d) -> DataFrame:
    return table(s, d, "top_rewrites").select("rewrite_id", "id", "version_score", "success_ratio").dropDuplicates(["rewrite_id"])


@query(f"WITH {_REWRITES}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(version_score, 0) DESC, rewrite_id) AS rank FROM once) SELECT id, rewrite_id, version_score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def top3_rewrites(s, d):
    return R.top_versions(_rewrites(s, d), "id", "version_score", ["rewrite_id"]).select("id", "rewrite_id", "version_score", "rank")


@query(f"""
    WITH {_REWRITES} SELECT rewrite_id, success_ratio, CASE WHEN success_ratio = 1.0 THEN 'Fully Successful' WHEN success_ratio >= 0.7 THEN 'Highly Successful' WHEN success_ratio >= 0.3 THEN 'Partially Successful' ELSE 'Mainly Fallback' END AS quality_label FROM once
""")
def quality_labels(s, d):
    return _rewrites(s, d).select("rewrite_id", "success_ratio", S.quality_label(F.col("success_ratio")).alias("quality_label"))


@query(f"WITH {_REWRITES} SELECT id, count(*) AS total_versions, count(*) FILTER (success_ratio = 1.0) AS fully_successful_versions, round(avg(success_ratio), 9) AS average_success_ratio FROM once GROUP BY id")
def overall_stats(s, d):
    return R.overall_stats(_rewrites(s, d), ["id"]).withColumn("average_success_ratio", F.round("average_success_ratio", 9))


@query("""
    SELECT l_orderkey AS doc, count(*) AS total_segments, count(*) FILTER (l_returnflag = 'N') AS successful_segments, round(avg(CAST(l_returnflag = 'N' AS INTEGER)), 9) AS success_ratio,
      round(avg(CAST(l_returnflag = 'A' AS INTEGER)), 9) AS fallback_ratio, bool_and(l_linestatus = 'O') AS final_passed FROM lineitem GROUP BY l_orderkey
""")
def version_scores(s, d):
    seg = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_returnflag") == "N").alias("ok"), (F.col("l_returnflag") == "A").alias("used_fallback"), (F.col("l_linestatus") == "O").alias("final_passed"))
    return R.version_scores(seg, ["doc"]).drop("quality_label").withColumn("success_ratio", F.round("success_ratio", 9)).withColumn("fallback_ratio", F.round("fallback_ratio", 9))


_ALIGNED = "al AS (SELECT aligned_id, unnest(range(len(alignment))) AS k, unnest(alignment) AS e FROM aligned_news WHERE alignment IS NOT NULL), sen AS (SELECT aligned_id, k, e.text AS text, e.sources AS sources FROM al WHERE e IS NOT NULL)"


def _aligned(s, d) -> DataFrame:
    return table(s, d, "aligned_news").select("aligned_id", F.posexplode("alignment").alias("k", "e")).filter("e is not null").select("aligned_id", "k", "e.text", "e.sources")


@query(f"WITH {_ALIGNED}, x AS (SELECT aligned_id, unnest(sources) AS src FROM sen WHERE sources IS NOT NULL) SELECT aligned_id, CAST(src AS INTEGER) AS source_no, count(*) AS n_sentences FROM x GROUP BY ALL")
def provenance_counts(s, d):
    return _aligned(s, d).select("aligned_id", F.explode("sources").alias("source_no")).groupBy("aligned_id", "source_no").agg(F.count("*").alias("n_sentences"))


@query(f"""
    WITH p AS (SELECT aligned_id, string_split(fused_content, '====ALIGNMENT====') AS s FROM aligned_news WHERE fused_content IS NOT NULL)
    SELECT aligned_id, {_strip('s[1]')} AS fused_text, len(s) > 1 AS has_alignment FROM p
""")
def alignment_detach(s, d):
    body, rest = X.detach("fused_content")
    return table(s, d, "aligned_news").filter("fused_content is not null").select("aligned_id", body.alias("fused_text"), rest.isNotNull().alias("has_alignment"))


_PROBLEMS = "[" + ", ".join(f"'{p}'" for p in E.SENTENCE_PROBLEMS) + "]"


@query(f"""
    WITH {_ALIGNED}, t AS (SELECT aligned_id, k, text, unnest({_PROBLEMS}) AS problem FROM sen WHERE text IS NOT NULL), f AS (SELECT aligned_id, problem FROM t WHERE (length(text) + length(problem)) % 7 = 0)
    SELECT aligned_id, problem, count(*) AS n FROM f GROUP BY GROUPING SETS ((aligned_id, problem), (aligned_id))
""")
def problem_report(s, d):
    """The check stands in for a model's verdict, so both engines can compute it."""
    t = E.tasks(_aligned(s, d).filter("text is not null").select("aligned_id", "text"), E.SENTENCE_PROBLEMS)
    found = t.withColumn("problem_exists", (F.length("text") + F.length("problem")) % 7 == 0)
    return E.problem_counts(found, "aligned_id", "sentence").select("aligned_id", "problem", "n")


@query("""
    WITH e AS (SELECT source, coalesce(len(alignment), 0) AS g, coalesce(len(_alignment_processing_log), 0) AS n, CASE WHEN alignment IS NULL THEN NULL ELSE len(alignment) / 20.0 END AS sim, alignment_error IS NULL AS ok FROM aligned_news)
    SELECT source, count(*) AS total_news_evaluated, round(avg(g), 2) AS average_global_problems, round(avg(n), 2) AS average_sentence_problems, round(avg(coalesce(sim, 0)), 3) AS avg_semantic_similarity, max(coalesce(sim, 0)) AS max_semantic_similarity FROM e WHERE ok GROUP BY source
""")
def evaluation_report(s, d):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    e = table(s, d, "aligned_news").select(
        "source", size("alignment").alias("global_problem_count"), size("_alignment_processing_log").alias("sentence_problem_count"), F.when(F.col("alignment").isNotNull(), F.size("alignment") / 20.0).alias("semantic_similarity"), F.col("alignment_error").isNull().alias("evaluation_success")
    )
    return E.corpus_report(e, ["source"]).select("source", "total_news_evaluated", "average_global_problems", "average_sentence_problems", "avg_semantic_similarity", "max_semantic_similarity")


@query("SELECT fusion_method, count(*) AS total, count(*) FILTER (fused_content <> '') AS success FROM fused_news GROUP BY fusion_method")
def fusion_stats(s, d):
    return E.fusion_stats(table(s, d, "fused_news"), ["fusion_method"])


@query("SELECT event_id, props AS json, '' AS reason FROM events WHERE props IS NOT NULL")
def json_extract(s, d):
    noisy = table(s, d, "events").filter("props is not null").select("event_id", F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nThat is all }")).alias("t"))
    return noisy.select("event_id", jsonx.extract_object("t").alias("r")).select("event_id", "r.json", "r.reason")


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\n[ \t\n\f\r]*\n', chr(10) || chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL")
def strip_markup(s, d):
    return docs(s, d).filter("text is not null").select("doc_id", X.collapse_blank_lines(X.strip_markup("text")).alias("text"))


@query(rf"SELECT fused_id, {_strip('''regexp_replace('fused news: ' || fused_content, '^(Fused News:|Fusion Result:|Final Version:|Fusion Version:|Example Output:)', '', 'i')''')} AS text FROM fused_news WHERE fused_content IS NOT NULL")
def strip_prefix(s, d):
    f = table(s, d, "fused_news").filter("fused_content is not null")
    return f.select("fused_id", X.strip_prefix(F.concat(F.lit("fused news: "), F.col("fused_content")), X.PREFIXES).alias("text"))


@query("SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 10")
def head_sample(s, d):
    return docs(s, d).select("doc_id", "title").orderBy("doc_id").limit(10)
