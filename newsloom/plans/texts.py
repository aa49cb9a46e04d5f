"""Queries of single operators over whole tables: texts, tags, tasks, segments. Each has SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import jsonx, similarity
from newsloom.functions import score as S
from newsloom.functions import text as X
from newsloom.operators import evaluate as E
from newsloom.operators import masking as M
from newsloom.operators import segment as G
from newsloom.plans import reports as P
from newsloom.sources import io
from newsloom.sources.session import small_batches, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _docs(s, d) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "title", "lang").filter("text is not null"))


@query(f"SELECT DISTINCT id, {P._strip('content')} AS content FROM news_raw WHERE content IS NOT NULL AND {P._strip('content')} <> ''")
def articles(s, d):
    """Articles with content, stripped; repeated rows count once."""
    return io.articles(table(s, d, "news_raw")).select("id", "content").distinct()


@query(f"SELECT DISTINCT id, title, content, url, publish_date, seendate, source, pub_year AS year, is_disaster_related, main_topic, array_to_string(keywords_found, '|') AS keywords_found FROM news_raw")
def cleaned_fields(s, d):
    """The eleven fields of cleaned news."""
    news = table(s, d, "news_raw").withColumnRenamed("pub_year", "year").withColumn("cleaned_content", F.lit(None).cast("string"))
    return io.cleaned_news(news).withColumn("keywords_found", F.array_join("keywords_found", "|")).distinct()


@query("SELECT lang, count(*) AS n_docs, count(*) FILTER (regexp_matches(text, '[一-鿿]')) AS n_han FROM documents WHERE text IS NOT NULL GROUP BY lang")
def han_documents(s, d):
    return _docs(s, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(X.has_han("text")).alias("n_han"))


@query("SELECT doc_id, regexp_replace(title, '[^a-zA-Z0-9_]', '_', 'g') AS safe FROM documents WHERE title IS NOT NULL")
def safe_ids(s, d):
    return table(s, d, "documents").filter("title is not null").select("doc_id", X.safe_id("title").alias("safe"))


@query(rf"""
    WITH t AS (SELECT doc_id, text, regexp_replace(text, '([.?!])[ \t\n\f\r]+', '\1' || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, text, {P._clean("string_split_regex(t, '[。！？!?；;]|[' || chr(10) || chr(13) || ']+')")} AS p FROM t),
    b AS (SELECT doc_id, text, len(p) AS n, regexp_replace({P._strip("p[1]")}, '[ \t\n\f\r]+', ' ', 'g') AS best FROM p)
    SELECT doc_id, CASE WHEN n > 0 THEN CASE WHEN length(best) > 60 THEN best[1:57] || '...' ELSE best END WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS theme FROM b
""")
def themes(s, d):
    """A heading of each text from its first sentence."""
    return _docs(s, d).select("doc_id", X.theme(X.sentences("text"), "text").alias("theme"))


@query(rf"""
    WITH p AS (SELECT doc_id, string_split_regex(text, '\n[ \t\f\r]*\n') AS ps, regexp_extract_all(text, '\n[ \t\f\r]*\n') AS seps FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, ps, seps, unnest(range(1, len(ps) + 1)) AS i FROM p),
    o AS (SELECT doc_id, i, {P._strip("ps[i]")} AS t, length(ps[i]) AS n, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(seps[1:i - 1], lambda x: length(x))), 0) AS a FROM n)
    SELECT doc_id, 'seg_' || lpad(CAST(i AS VARCHAR), 3, '0') AS segment_id, t AS text, CAST(a AS INTEGER) AS start_char, CAST(a + n AS INTEGER) AS end_char FROM o WHERE t <> ''
""")
def blank_line_segments(s, d):
    """Segments between blank lines with their numbers in the stream of pieces and their offsets."""
    small_batches(s)
    return _docs(s, d).select("doc_id", F.explode(X.blank_line_segments("text")).alias("s")).select("doc_id", "s.*")


@query(f"""
    WITH RECURSIVE {P._PARAGRAPHS},
    kept AS (SELECT doc_id, ord, length(paragraph) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM par WHERE length(paragraph) >= 25),
    fold AS (
      SELECT doc_id, i, ord, n AS cur, 1 AS seg FROM kept WHERE i = 1
      UNION ALL
      SELECT k.doc_id, k.i, k.ord, CASE WHEN f.cur < 400 AND f.cur + k.n <= 800 THEN f.cur + k.n ELSE k.n END, CASE WHEN f.cur < 400 AND f.cur + k.n <= 800 THEN f.seg ELSE f.seg + 1 END
      FROM fold f JOIN kept k ON k.doc_id = f.doc_id AND k.i = f.i + 1
    )
    SELECT doc_id, seg AS segment_id, array_to_string(list(ord ORDER BY ord), ',') AS original_indices FROM fold GROUP BY ALL
""")
def segment_lineage(s, d):
    """The paragraphs that each merged segment comes from."""
    return G.length_segments(table(s, d, "documents")).select("doc_id", "segment_id", F.array_join(F.col("original_indices").cast("array<string>"), ",").alias("original_indices"))


@query(f"WITH {P._PARAGRAPHS} SELECT p.doc_id AS doc, CAST(p.ord AS INTEGER) AS ord, 'auto_' || p.ord AS tag_id FROM par p JOIN documents t ON t.doc_id = p.doc_id WHERE t.title IS NULL OR t.title = '' OR NOT contains(p.paragraph, t.title)")
def uncovered_paragraphs(s, d):
    """Paragraphs that don't hold their document's title, as ones without a tagged sentence."""
    docs = _docs(s, d)
    pars = G.split_paragraphs(docs).withColumnRenamed("doc_id", "doc")
    tags = docs.filter("title is not null").select(F.col("doc_id").alias("doc"), F.col("title").alias("sentence"))
    return M.uncovered(pars, tags).select("doc", "ord", "tag_id")


@query(f"""
    WITH d AS (SELECT doc_id, text, regexp_extract(text, '^[^\\n]*') AS line FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, CASE WHEN line <> '' THEN '<t' || doc_id || '>' || line || '</t' || doc_id || '>' || substr(text, length(line) + 1) ELSE text END AS wrapped, line, text FROM d)
    SELECT doc_id, wrapped FROM w
""")
def wrap_first_line(s, d):
    """The first line of each text between the marks of a tag."""
    line = F.regexp_extract("text", r"^[^\n]*", 0)
    return _docs(s, d).select("doc_id", X.wrap_first(F.col("text"), line, F.concat(F.lit("t"), F.col("doc_id"))).alias("wrapped"))


_FENCE = P._strip("regexp_replace(regexp_replace({0}, '^```[a-zA-Z]*[ \\t]*\\n?', ''), '\\n?```$', '')".format(P._strip("raw_alignment")))


@query(f"SELECT aligned_id, {_FENCE} AS text FROM aligned_news WHERE raw_alignment IS NOT NULL")
def fence_strip(s, d):
    return table(s, d, "aligned_news").filter("raw_alignment is not null").select("aligned_id", X.strip_fence("raw_alignment").alias("text"))


@query("SELECT event_id, value > 50 AS problem_exists, event_type AS evidence FROM events")
def flat_verdicts(s, d):
    """Verdicts out of answers with words around them."""
    answer = F.concat(F.lit('I think {"problem_exists": '), (F.col("value") > 50).cast("string"), F.lit(', "evidence": "'), F.col("event_type"), F.lit('"} is right'))
    return table(s, d, "events").select("event_id", jsonx.flat_verdict(answer).alias("v")).select("event_id", "v.*")


@query("SELECT event_id, props AS json FROM events WHERE props IS NOT NULL")
def greedy_objects(s, d):
    """Objects in single quotes among words, from the first to the last brace."""
    answer = F.concat(F.lit("so: "), F.translate("props", '"', "'"), F.lit(" end"))
    return table(s, d, "events").filter("props is not null").select("event_id", jsonx.greedy_object(answer).alias("json"))


_GLOBAL = "[" + ", ".join(f"'{p}'" for p in E.GLOBAL_PROBLEMS) + "]"


@query(f"SELECT fused_id, unnest({_GLOBAL}) AS problem FROM fused_news WHERE fused_content IS NOT NULL")
def global_tasks(s, d):
    """Each fused text once for each kind of problem of a whole text."""
    return E.tasks(table(s, d, "fused_news").filter("fused_content is not null").select("fused_id"), E.GLOBAL_PROBLEMS)


@query(f"""
    WITH {P._NEWS_PAR}, w AS (SELECT *, {P._WORDS.format('p')} AS ws, {P._WORDS.format('title')} AS wt, {P._WORDS.format('main_topic')} AS wm, {P._KEYS.format('p')} AS own, len(list_filter(string_split_regex(p, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS n FROM par)
    SELECT id, ord, round({P._ALIKE.format('wt')} * 0.4 + {P._ALIKE.format('wm')} * 0.3 + least(1.0, length(p) / 200.0) * 0.2 + least(least(len(own), 5) / greatest(1, n) * 2.0, 0.1), 3) AS importance FROM w
""")
def paragraph_importance(s, d):
    """The weight of each paragraph; shared words stand in for the embedder."""
    sets = lambda c: similarity.word_set(F.coalesce(c, F.lit("")))
    rows = P._news(s, d).select("id", "ord", "p", sets("p").alias("ws"), sets("title").alias("wt"), sets("main_topic").alias("wm"), F.least(F.size(P._keys("p")), F.lit(5)).alias("k"), F.size(F.filter(F.split("p", r"[ \t\n\f\r]+"), lambda x: x != "")).alias("n"))
    weight = S.importance(similarity.jaccard_sets("ws", "wt"), similarity.jaccard_sets("ws", "wm"), F.length("p").cast("double"), F.col("k") / F.greatest(F.lit(1), F.col("n")))
    return rows.select("id", "ord", weight.alias("importance"))
