"""Queries over runs, conflicts and alignments: what the rewriting graph and the evaluation leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import jsonx
from newsloom.functions import text as X
from newsloom.models.providers import HashEmbedder
from newsloom.operators import evaluate as E
from newsloom.operators import graph as G
from newsloom.operators import masking as M
from newsloom.operators import nested as N
from newsloom.operators import rewrite as R
from newsloom.operators import stages as S
from newsloom.operators import versions as V
from newsloom.sources.session import small_batches, table

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


def _nodes(s, d, *types: str) -> DataFrame:
    """Nodes of the runs' states."""
    return N.label_nodes(N.nested_records(s, d).filter("rec_table = 'rewrite_runs'")).filter(F.col("node_type").isin(*types))


_RUNS = f"{N._NODES}, runs AS (SELECT * FROM linked WHERE rec_table = 'rewrite_runs')"
_SEGMENTS = f"""
    {_RUNS}, seg AS (
      SELECT s.rec_id, s.parent_path AS version_path, CAST(coalesce(s.v ->> '$.final_passed', 'false') AS BOOLEAN) AS passed, CAST(coalesce(s.v ->> '$.used_fallback', 'false') AS BOOLEAN) AS back
      FROM runs s JOIN runs p ON p.rec_id = s.rec_id AND p.path = s.parent_path AND p.node_type = 'rewritten_versions' WHERE s.node_type = 'segments'
    )
"""


@query(f"""
    WITH {_SEGMENTS}, a AS (
      SELECT rec_id, version_path, count(*) AS total_segments, count(*) FILTER (passed AND NOT back) AS successful_segments, avg(CAST(passed AND NOT back AS INTEGER)) AS ratio, avg(CAST(back AS INTEGER)) AS back, bool_and(passed) AS final_passed FROM seg GROUP BY ALL
    )
    SELECT rec_id AS run_id, version_path, total_segments, successful_segments, round(ratio, 9) AS success_ratio, round(back, 9) AS fallback_ratio, final_passed,
      CASE WHEN ratio = 1.0 THEN 'Fully Successful' WHEN ratio >= 0.7 THEN 'Highly Successful' WHEN ratio >= 0.3 THEN 'Partially Successful' ELSE 'Mainly Fallback' END AS quality_label FROM a
""")
def rewrite_scores(s, d):
    """Scores of each rewritten version of a run from its segments, whatever the run itself says of them."""
    n = _nodes(s, d, "segments", "rewritten_versions")
    versions = n.filter("node_type = 'rewritten_versions'").select("rec_id", F.col("path").alias("version_path"))
    flag = lambda c: F.coalesce(F.expr(f"try_cast(attrs['{c}'] as boolean)"), F.lit(False))
    seg = n.filter("node_type = 'segments'").select("rec_id", F.col("parent_path").alias("version_path"), flag("final_passed").alias("final_passed"), flag("used_fallback").alias("used_fallback")).join(versions, ["rec_id", "version_path"], "left_semi")
    out = R.version_scores(seg.withColumn("ok", F.col("final_passed") & ~F.col("used_fallback")), ["rec_id", "version_path"]).withColumnRenamed("rec_id", "run_id")
    return out.withColumn("success_ratio", F.round("success_ratio", 9)).withColumn("fallback_ratio", F.round("fallback_ratio", 9))


def _versions(s, d) -> DataFrame:
    v = N.node_table(_nodes(s, d, "rewritten_versions"), "rewritten_versions", {"version_id": "string", "version_score": "double", "final_passed": "boolean"})
    return v.withColumnRenamed("rec_id", "run_id")


_VERSIONS = f"{_RUNS}, ver AS (SELECT rec_id AS run_id, pre, v ->> '$.version_id' AS version_id, TRY_CAST(v ->> '$.version_score' AS DOUBLE) AS version_score, TRY_CAST(v ->> '$.final_passed' AS BOOLEAN) AS final_passed FROM runs WHERE node_type = 'rewritten_versions')"


@query(f"WITH {_VERSIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY version_score DESC, pre) AS r FROM ver WHERE version_score > 0) SELECT run_id, version_id, version_score FROM k WHERE r = 1")
def best_version(s, d):
    return G.best_versions(_versions(s, d), "run_id", "version_score", "pre").select("run_id", "version_id", "version_score")


@query(f"""
    WITH {_VERSIONS}, h AS (SELECT rec_id AS run_id, max(TRY_CAST(v ->> '$.attempt' AS INTEGER)) AS attempt FROM runs WHERE node_type = 'history' GROUP BY rec_id),
    e AS (SELECT run_id, count(*) AS n, bool_and(coalesce(final_passed, false)) AS ok FROM ver GROUP BY run_id),
    r AS (SELECT run_id, coalesce(TRY_CAST(any_value(state_json) ->> '$.max_attempts' AS INTEGER), 3) AS max_attempts FROM rewrite_runs WHERE state_json IS NOT NULL AND json_valid(state_json) GROUP BY run_id)
    SELECT r.run_id, coalesce(attempt, 0) AS attempt, max_attempts, coalesce(n, 0) AS n_versions, coalesce(ok, false) AS all_passed,
      CASE WHEN coalesce(ok, false) THEN 'success' WHEN coalesce(attempt, 0) < max_attempts THEN 'retry' ELSE 'fallback' END AS final_status FROM r LEFT JOIN e USING (run_id) LEFT JOIN h USING (run_id)
""")
def run_status(s, d):
    """Whether each run passed, may try again, or ended in the fallback."""
    h = N.node_table(_nodes(s, d, "history"), "history", {"attempt": "int"}).groupBy(F.col("rec_id").alias("run_id")).agg(F.max("attempt").alias("attempt"))
    runs = table(s, d, "rewrite_runs").filter("state_json is not null").select("run_id", "state_json").dropDuplicates(["run_id"]).filter(F.try_parse_json("state_json").isNotNull())
    runs = runs.select("run_id", F.coalesce(F.expr("try_cast(get_json_object(state_json, '$.max_attempts') as int)"), F.lit(3)).alias("max_attempts"))
    runs = runs.join(h, "run_id", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return G.evaluate_runs(_versions(s, d), runs, "run_id").select("run_id", "attempt", "max_attempts", "n_versions", "all_passed", "final_status")


_CALLS = f"""
    {_RUNS}, call AS (SELECT rec_id, path, v ->> '$.output.segment_id' AS segment_id FROM runs WHERE node_type = 'tool_calls'),
    tag AS (SELECT DISTINCT t.rec_id, c.segment_id || '_' || (t.v ->> '$.tag_id') AS full_tag_id FROM runs t JOIN call c ON c.rec_id = t.rec_id AND c.path = t.parent_path WHERE t.node_type = 'tags' AND c.segment_id IS NOT NULL),
    rv AS (SELECT t.rec_id, c.segment_id, t.v ->> '$.version_id' AS version_id, json_extract(t.v, '$.keep_tag_ids') AS ids FROM runs t JOIN call c ON c.rec_id = t.rec_id AND c.path = t.parent_path WHERE t.node_type = 'reduced_versions' AND c.segment_id IS NOT NULL),
    one AS (SELECT rec_id, segment_id, version_id, unnest(from_json(ids, '["VARCHAR"]')) AS k FROM rv WHERE json_type(ids) = 'ARRAY'),
    keep AS (SELECT DISTINCT rec_id, version_id, CASE WHEN starts_with(k, segment_id || '_') THEN k ELSE segment_id || '_' || k END AS full_tag_id FROM one WHERE k IS NOT NULL)
"""


def _tags_and_keeps(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, versions, keeps) of the runs' segment analyses with full tag ids."""
    n = _nodes(s, d, "tool_calls", "tags", "reduced_versions")
    call = n.filter("node_type = 'tool_calls'").select("rec_id", F.col("path").alias("parent_path"), F.col("attrs")["output.segment_id"].alias("segment_id")).filter("segment_id is not null")
    of = lambda kind: n.filter(F.col("node_type") == kind).select("rec_id", "parent_path", "attrs").join(call, ["rec_id", "parent_path"])
    tags = of("tags").select("rec_id", F.concat_ws("_", "segment_id", F.col("attrs")["tag_id"]).alias("full_tag_id")).distinct()
    versions = of("reduced_versions").select("rec_id", "segment_id", F.col("attrs")["version_id"].alias("version_id"), F.explode_outer(F.from_json(F.col("attrs")["keep_tag_ids"], "array<string>")).alias("k"))
    full = F.when(F.startswith("k", F.concat("segment_id", F.lit("_"))), F.col("k")).otherwise(F.concat_ws("_", "segment_id", "k"))
    keeps = versions.filter("k is not null").select("rec_id", "version_id", full.alias("full_tag_id")).distinct()
    return tags, versions.select("rec_id", "version_id").distinct(), keeps


@query(f"WITH {_CALLS} SELECT rec_id AS run_id, version_id, array_to_string(list_sort(list(full_tag_id)), ',') AS keep_tag_ids FROM keep GROUP BY ALL")
def keep_union_runs(s, d):
    """The tags that each version of a run keeps in any of its segments."""
    keeps = _tags_and_keeps(s, d)[2]
    return M.keep_union(keeps, ["rec_id", "version_id"], "full_tag_id").select(F.col("rec_id").alias("run_id"), "version_id", F.array_join("keep_tag_ids", ",").alias("keep_tag_ids"))


@query(f"WITH {_CALLS} SELECT DISTINCT r.rec_id AS run_id, r.version_id, t.full_tag_id FROM rv r JOIN tag t USING (rec_id) WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE k.rec_id = r.rec_id AND k.version_id = r.version_id AND k.full_tag_id = t.full_tag_id)")
def mask_ids_runs(s, d):
    """The tags that each version of a run removes: those that none of its segments keeps."""
    tags, versions, keeps = _tags_and_keeps(s, d)
    return M.mask(versions.join(tags, "rec_id"), keeps, ["rec_id", "version_id", "full_tag_id"]).select(F.col("rec_id").alias("run_id"), "version_id", "full_tag_id")


_CONF = """
    once AS (SELECT injection_id, any_value(id) AS id, any_value(conflicts) AS conflicts FROM injected_versions GROUP BY injection_id),
    conf AS (SELECT id, unnest(conflicts) AS c FROM once WHERE conflicts IS NOT NULL)
"""


@query(f"WITH {_CONF} SELECT id, count(*) AS total_conflicts, count(DISTINCT nullif(c.entity_text, '')) AS entities_with_conflicts FROM conf WHERE c IS NOT NULL GROUP BY id")
def conflict_totals(s, d):
    rows = table(s, d, "injected_versions").select("injection_id", "id", "conflicts").dropDuplicates(["injection_id"]).select("id", F.explode("conflicts").alias("c")).filter("c is not null")
    return V.conflict_totals(rows.select("id", "c.entity_text"), ["id"])


@query("""
    WITH e AS (SELECT result_id, unnest(from_json(json_extract(injection_results, '$.shared_entities'), '[{"text":"VARCHAR","label":"VARCHAR","start_char":"INTEGER","end_char":"INTEGER"}]')) AS e FROM injection_results WHERE json_valid(injection_results))
    SELECT result_id, e.text AS text, e.label AS label, min(e.start_char) AS start_char FROM e WHERE e.label IN ('PERSON', 'ORG', 'GPE', 'DATE', 'CARDINAL', 'MONEY', 'PERCENT') AND e.text <> '' GROUP BY ALL
""")
def usable_entities(s, d):
    kind = "array<struct<text: string, label: string, start_char: int, end_char: int>>"
    rows = table(s, d, "injection_results").select("result_id", F.explode(F.from_json(F.get_json_object("injection_results", "$.shared_entities"), kind)).alias("e")).select("result_id", "e.*")
    return V.usable_entities(rows, ["result_id"], "start_char").select("result_id", "text", "label", "start_char")


_ENTRY = ", ".join(f"nullif(CASE WHEN json_type(e, '$.{f}') = 'VARCHAR' THEN e ->> '$.{f}' END, '')" for f in ("final_rewritten_text", "final_text", "text", "content", "summary"))
_LISTED = f"CASE WHEN json_type({{0}}) = 'ARRAY' THEN list_transform(from_json({{0}}, '[\"JSON\"]')[1:3], lambda e: CASE json_type(e) WHEN 'OBJECT' THEN coalesce({_ENTRY}, '') WHEN 'VARCHAR' THEN e ->> '$' ELSE '' END) END"
_FIELD = "CASE WHEN json_type(j, '$.{0}') = 'VARCHAR' THEN j ->> '$.{0}' END"


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({_FIELD.format(n)}, '')" for n in names) + ", '')"


def _version_sql(i: int) -> str:
    legacy = [_first("final_rewritten_text", "final_text"), _first("alt_rewrite_1"), _first("alt_rewrite_2")][i - 1]
    return f"CASE WHEN direct THEN {_first(f'rewritten_v{i}')} WHEN len(list_filter(first, lambda t: t <> '')) > 0 THEN coalesce(first[{i}], '') WHEN len(list_filter(top, lambda t: t <> '')) > 0 THEN coalesce(top[{i}], '') ELSE {legacy} END AS rewritten_v{i}"


@query(f"""
    WITH once AS (SELECT line_id, CAST(any_value(payload) AS JSON) AS j FROM rewrite_records WHERE json_valid(payload) GROUP BY line_id),
    l AS (SELECT *, {_LISTED.format("json_extract(j, '$.rewrite_versions')")} AS a, {_LISTED.format("json_extract(j, '$.top_rewrites')")} AS top, {_LISTED.format("json_extract(j, '$.rewrites')")} AS c FROM once WHERE json_type(j) = 'OBJECT'),
    f AS (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN len(top) > 0 THEN top WHEN len(c) > 0 THEN c ELSE [] END AS first, {' OR '.join(f"{_FIELD.format(f'rewritten_v{i}')} IS NOT NULL" for i in (1, 2, 3))} AS direct FROM l)
    SELECT line_id, {_first('id', 'news_id', 'item_id')} AS id, {_first('input_text', 'text', 'original_text', 'input')} AS input_text, {', '.join(map(_version_sql, (1, 2, 3)))} FROM f
""")
def normalise_versions(s, d):
    """Items with versions out of the records of all feeds, whatever fields they carry; only texts count."""
    lines = table(s, d, "rewrite_records").select("line_id", "payload").dropDuplicates(["line_id"]).select("line_id", F.try_parse_json("payload").alias("j")).filter(F.schema_of_variant("j").startswith("OBJECT"))
    plain = ["id", "news_id", "item_id", "input_text", "text", "original_text", "input", *V.VERSIONS, "final_rewritten_text", "final_text", "alt_rewrite_1", "alt_rewrite_2"]

    def text(v, path: str):
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def entry(e):
        fields = F.coalesce(*[F.nullif(text(e, f"$.{f}"), F.lit("")) for f in ("final_rewritten_text", "final_text", "text", "content", "summary")], F.lit(""))
        kind = F.schema_of_variant(e)
        return F.when(kind.startswith("OBJECT"), fields).when(kind == "STRING", F.try_variant_get(e, "$", "string")).otherwise("")

    lists = [F.transform(F.try_variant_get("j", f"$.{n}", "array<variant>"), entry).alias(n) for n in ("rewrite_versions", "top_rewrites", "rewrites")]
    items = lines.select("line_id", *[text("j", f"$.{c}").alias(c) for c in plain], *lists)
    return V.normalise_versions(items, keep=("line_id",)).select("line_id", "id", "input_text", *V.VERSIONS)


@query("""SELECT event_id, regexp_replace(props, '}$', '') || ', "note": "it is true and null, ]"}' AS json, 'repaired' AS reason FROM events WHERE props IS NOT NULL AND props LIKE '{_%}'""")
def json_repair(s, d):
    """Objects with a trailing comma, repaired; what stands in quotation marks stays, though it looks like a fault."""
    t = table(s, d, "events").filter("props is not null and props like '{_%}'")
    noisy = t.select("event_id", F.concat(F.lit("So: "), F.regexp_replace("props", r"\}$", ""), F.lit(', "note": "it is true and null, ]",} end')).alias("t"))
    return noisy.select("event_id", jsonx.extract_object("t").alias("r")).select("event_id", "r.json", "r.reason")


@query("""
    WITH p AS (SELECT aligned_id, string_split(fused_content, '====ALIGNMENT====')[2] AS t FROM aligned_news WHERE fused_content IS NOT NULL),
    j AS (SELECT aligned_id, CASE WHEN t IS NOT NULL AND json_valid(t) AND json_type(t) = 'ARRAY' THEN CAST(t AS JSON) END AS j FROM p)
    SELECT aligned_id, CAST(coalesce(json_array_length(j), 0) AS INTEGER) AS n_sentences, json_extract_string(j, '$[0].text') AS first_text FROM j
""")
def alignment_parsed(s, d):
    """The alignment that stands after the separator of a fused text, parsed."""
    rows = table(s, d, "aligned_news").filter("fused_content is not null").select("aligned_id", S.parsed_alignment("fused_content").alias("a"))
    return rows.select("aligned_id", F.size("a").alias("n_sentences"), F.get("a", F.lit(0))["text"].alias("first_text"))


@query("""
    SELECT source, count(*) AS n_items, count(*) FILTER (alignment_error IS NULL) AS n_success, CAST(coalesce(sum(len(_alignment_processing_log)) FILTER (alignment_error IS NULL), 0) AS BIGINT) AS total_global_problems,
      CAST(coalesce(sum(len(alignment)) FILTER (alignment_error IS NULL), 0) AS BIGINT) AS total_sentence_problems, round(coalesce(avg(1.0 / (1 + coalesce(len(alignment), 0))) FILTER (alignment_error IS NULL), 0), 9) AS average_semantic_similarity FROM aligned_news GROUP BY source
""")
def batch_tally(s, d):
    """The tally of a batch, on the lengths of logs and alignments instead of a model's findings, so that both engines can compute it."""
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    e = table(s, d, "aligned_news").select("source", F.col("alignment_error").isNull().alias("evaluation_success"), n("_alignment_processing_log").alias("global_problem_count"), n("alignment").alias("sentence_problem_count"), (1.0 / (1 + F.coalesce(n("alignment"), F.lit(0)))).alias("semantic_similarity"))
    return E.batch_tally(e, "source").withColumn("average_semantic_similarity", F.round("average_semantic_similarity", 9))


@query()
def segment_news(s, d):
    """The whole segmentation stage with the offline embedder, so there is no SQL."""
    small_batches(s)
    news = table(s, d, "news_raw").select("id", "title", "content", "main_topic")
    return S.segment_news(news, HashEmbedder()).select("id", "segment_count", "cleaned_content", "segmentation_stats", "processing_success")


class _FirstSentence:
    """Stands in for an analyst: tags the first sentence of a paragraph and keeps it in every second version."""

    def complete(self, system: str, user: str) -> str:
        import json

        first = user.strip().split(". ")[0][:200]
        return json.dumps({"tags": [{"tag_id": "t1", "tag_type": "core", "sentence": first}], "reduced_versions": [{"version_id": "reduced_v1", "keep_tag_ids": ["t1"]}, {"version_id": "reduced_v2", "keep_tag_ids": []}]})


@query()
def mask_apply(s, d):
    """Reduced versions of the articles' segments by the tags that each version keeps; the analyst is a stand-in, so there is no SQL."""
    news = table(s, d, "news_raw").select("id", "content").filter("content is not null").dropDuplicates(["id"])
    rows = news.select(F.col("id").alias("doc"), F.explode(X.blank_line_segments("content")).alias("s")).select("doc", "s.segment_id", "s.text")
    return G.apply_masks(G.masks(G.analyze_segments(rows, _FirstSentence()))).select("doc", "version_id", "text", F.size("mask").alias("n_removed"))
