"""Flat node tables from deeply nested records, linked by interval containment.

Every value of a record gets a pre-order and a post-order number in one depth-first walk. A node A
encloses B exactly if ``A.pre < B.pre`` and ``A.post > B.post``, so the parent of B is the innermost
emitted node whose interval contains B's. Nodes of one type (the name of the list they stand in) form
one flat table; ``(rec_table, rec_id, parent_pre)`` points at ``(rec_table, rec_id, pre)`` of the parent.

The work is per record: nothing is shuffled except where a caller removes repeated records first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.session import small_batches, table

#: Fields whose content counts when it stands in a list at any depth below them.
SCOPES = ("alignment", "tool_calls", "rewritten_versions", "conflicts")
#: Fields that are lists by meaning: a bare object in one counts as a list of one, a string of JSON as what it holds.
LIST_FIELDS = (
    "tool_calls", "rewritten_versions", "segments", "history", "tags", "reduced_versions",
    "missing", "extra", "suggested_edits", "conflicts",
)
ROOT = "$"

NODE_SCHEMA = T.StructType([
    T.StructField("rec_table", T.StringType()),
    T.StructField("rec_id", T.LongType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("post", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("parent_pre", T.IntegerType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])


def parse(text: str | None):
    """The value of a JSON text; None if it is null, not JSON or nested beyond what the parser takes."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def as_list(name: str, value, list_fields=frozenset(LIST_FIELDS)):
    """``value`` of field ``name`` with the uneven forms of list fields made even."""
    if name in list_fields:
        while isinstance(value, str):
            inner = parse(value)
            if not isinstance(inner, (dict, list, str)):
                return value
            value = inner
        if isinstance(value, dict):
            return [value]
    return value


def label(value, scopes=frozenset(SCOPES), list_fields=frozenset(LIST_FIELDS), within: str | None = None) -> list[list]:
    """Walk one record depth first and number every value.

    Returns ``[pre, post, depth, name, position, path, object]`` of each object that is an element of a
    list below one of ``scopes``, in pre-order. ``within`` restricts emission to that top-level field.
    The walk keeps its own stack, so depth is limited by the JSON parser only.
    """
    out: list[list] = []
    pre = post = 0
    # a frame: value, path, name of the field it came from, position in its list or None, in scope, allowed, depth
    stack: list = [(value, "", "", None, False, within is None, 0)]
    while stack:
        frame = stack.pop()
        if isinstance(frame, list):  # leaving a node
            frame[1] = post
            post += 1
            continue
        v, path, name, position, scoped, allowed, depth = frame
        mine = [pre, -1, depth, name, position, path, v]
        pre += 1
        if position is not None and scoped and allowed and isinstance(v, dict):
            out.append(mine)
        stack.append(mine)
        if isinstance(v, dict):
            for k, x in reversed(v.items()):
                ok = allowed or (depth == 0 and k == within)
                stack.append((as_list(k, x, list_fields), f"{path}.{k}" if path else k, k, None, scoped or k in scopes, ok, depth + 1))
        elif isinstance(v, list):
            for i in range(len(v) - 1, -1, -1):
                stack.append((v[i], f"{path}[{i}]", name, i, scoped, allowed, depth + 1))
    return out


def link_by_containment(nodes: list[list]) -> list[int]:
    """Index of the innermost node whose interval contains each node's, -1 if none; nodes in pre-order."""
    parents, open_ = [], []
    for i, n in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < n[1]:
            open_.pop()
        parents.append(open_[-1] if open_ else -1)
        open_.append(i)
    return parents


def _scalars(obj: dict, prefix: str = "") -> dict[str, str]:
    """The fields of an object as text: scalars, those of plain objects inside it by dotted path, arrays with scalars as JSON.

    What becomes nodes of its own (arrays of objects, list fields) and nulls are left out.
    """
    out = {}
    for k, v in obj.items():
        v = as_list(k, v)
        if isinstance(v, str):
            out[prefix + k] = v
        elif isinstance(v, dict):
            out.update(_scalars(v, f"{prefix}{k}."))
        elif isinstance(v, list):
            if not v or any(x is not None and not isinstance(x, dict) for x in v):
                out[prefix + k] = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        elif v is not None:
            out[prefix + k] = json.dumps(v)
    return out


def label_nodes(records: DataFrame, attrs: bool = True) -> DataFrame:
    """Node rows (``NODE_SCHEMA``) of ``records(rec_table, rec_id, root, within, doc)``.

    ``doc`` is JSON text, ``root`` the field name the document stands for (null: the document is the
    record), ``within`` a top-level field that emission is restricted to (null: none). Null, empty and
    unreadable documents give no rows (``unreadable`` reports them), null elements keep their position without a
    row. A null ``rec_id`` stays null. ``attrs`` holds the fields of each object as text (``_scalars``).
    """
    small_batches(records.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in NODE_SCHEMA]
        for pdf in batches:
            rows: list[tuple] = []
            for rec_table, rec_id, root, within, doc in zip(pdf.rec_table, pdf.rec_id, pdf.root, pdf.within, pdf.doc):
                value = parse(doc)
                if value is None:
                    continue
                root = None if pd.isna(root) else root
                nodes = label({root: value} if root else value, within=None if pd.isna(within) else within)
                rec_id = None if pd.isna(rec_id) else int(rec_id)
                for n, p in zip(nodes, link_by_containment(nodes)):
                    up = nodes[p] if p >= 0 else None
                    rows.append((
                        rec_table, rec_id, n[3], n[5], n[4], n[0], n[1], n[2],
                        up[0] if up else None, up[5] if up else ROOT, _scalars(n[6]) if attrs else None,
                    ))
                if len(rows) >= 20_000:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)

    return records.select("rec_table", "rec_id", "root", "within", "doc").mapInPandas(walk, NODE_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("rec_id",):
        out[c] = out[c].astype("Int64")
    for c in ("position", "pre", "post", "depth", "parent_pre"):
        out[c] = out[c].astype("Int32")
    return out


def node_table(nodes: DataFrame, node_type: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one node type: keys, parent link and ``columns`` (attribute path to SQL type).

    A dot in a path becomes ``_`` in the column's name. A value that can't be cast is null.
    """
    own = [F.expr(f"try_cast(attrs['{c}'] as {t})").alias(c.replace(".", "_")) for c, t in columns.items()]
    return nodes.filter(F.col("node_type") == node_type).select("rec_table", "rec_id", "pre", "parent_pre", "path", "parent_path", "position", *own)


def unreadable(records: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, reason, n_chars)`` of the documents that give no nodes because they can't be read.

    ``reason`` is ``not_json`` or ``too_deep`` (for the parser). A null document isn't unreadable, nor is the text ``null``.
    """
    small_batches(records.sparkSession)

    @F.pandas_udf("string")
    def why(docs: pd.Series) -> pd.Series:
        out = []
        for text in docs:
            try:
                json.loads(text)
                out.append(None)
            except RecursionError:
                out.append("too_deep")
            except ValueError:
                out.append("not_json")
        return pd.Series(out, dtype=object)

    found = records.filter("doc is not null").select("rec_table", "rec_id", why("doc").alias("reason"), F.length("doc").alias("n_chars"))
    return found.filter("reason is not null")


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nested sources as ``(rec_table, rec_id, root, within, doc)``; a run's repeated rows count once."""
    null = F.lit(None).cast("string")
    aligned = table(spark, sf_dir, "aligned_news").filter("alignment is not null").select(
        F.lit("aligned_news").alias("rec_table"), F.col("aligned_id").alias("rec_id"), F.lit("alignment").alias("root"), null.alias("within"), F.to_json("alignment").alias("doc")
    )
    runs = table(spark, sf_dir, "rewrite_runs").filter("state_json is not null").select("run_id", "state_json").dropDuplicates(["run_id"]).select(
        F.lit("rewrite_runs").alias("rec_table"), F.col("run_id").alias("rec_id"), null.alias("root"), null.alias("within"), F.col("state_json").alias("doc")
    )
    results = table(spark, sf_dir, "injection_results").filter("injection_results is not null").select(
        F.lit("injection_results").alias("rec_table"), F.col("result_id").alias("rec_id"), null.alias("root"), F.lit("injected_versions").alias("within"), F.col("injection_results").alias("doc")
    )
    return aligned.unionByName(runs).unionByName(results)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = label_nodes(nested_records(spark, sf_dir), attrs=False)
    return nodes.select("rec_table", "rec_id", "parent_path", F.col("path").alias("child_path"))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All node rows with their interval labels and scalar attributes."""
    return label_nodes(nested_records(spark, sf_dir))


def p1_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = label_nodes(nested_records(spark, sf_dir), attrs=False)
    return nodes.groupBy("rec_table", "node_type").agg(
        F.count("*").alias("n_nodes"), F.sum(F.col("parent_pre").isNull().cast("bigint")).alias("n_roots"), F.max("depth").cast("bigint").alias("max_depth")
    )


def p1_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unreadable(nested_records(spark, sf_dir))


#: The flat table of every node type: attribute path to SQL type.
TABLES: dict[str, dict[str, str]] = {
    "alignment": {"sent_idx": "int", "text": "string", "sources": "string", "evidence": "string", "conflict_resolved": "string"},
    "tool_calls": {"node": "string", "tool": "string", "ts": "double", "duration": "double", "input.segment_id": "string", "input.version_id": "string", "output.segment_id": "string"},
    "rewritten_versions": {
        "version_id": "string", "reduced_version_id": "string", "version_score": "double", "final_passed": "boolean", "success_ratio": "double", "successful_segments_count": "int",
        "total_segments_count": "int", "quality_label": "string",
    },
    "segments": {"segment_id": "string", "text": "string", "reduced_text": "string", "final_rewritten_text": "string", "final_passed": "boolean", "used_fallback": "boolean"},
    "history": {
        "attempt": "int", "rewritten_text": "string", "is_iterative": "boolean", "feedback_used": "string", "faithfulness.passed": "boolean", "faithfulness.score": "double",
        "faithfulness.explanation": "string", "diversity.passed": "boolean", "diversity.score": "double", "segment_id": "string", "final_passed": "boolean", "used_fallback": "boolean",
    },
    "tags": {"tag_id": "string", "tag_type": "string", "text": "string", "sentence": "string", "reason": "string"},
    "reduced_versions": {"version_id": "string", "keep_tag_ids": "string", "reason": "string"},
    "missing": {"text": "string", "where_hint": "string"},
    "extra": {"text": "string", "where_hint": "string"},
    "suggested_edits": {"action": "string", "text": "string", "position_hint": "string"},
    "conflicts": {
        "entity_text": "string", "original_span": "string", "injected_span": "string", "type": "string", "note": "string", "target_entity": "string", "span_start": "int", "span_end": "int", "version_id": "string",
    },
    "candidates": {"value": "string", "score": "double"},
}


def _table_query(node_type: str, columns: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return node_table(label_nodes(nested_records(spark, sf_dir)), node_type, columns)

    run.__doc__ = f"Flat table of the ``{node_type}`` nodes of all nested sources."
    return run


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p1_node_counts": p1_node_counts, "p1_unreadable": p1_unreadable}
QUERIES |= {f"p1_{'alignment_rows' if t == 'alignment' else t}": _table_query(t, c) for t, c in TABLES.items()}

#: The same walk in SQL: every value is a row, in pre-order by the list of its ordinals. Null fields of the typed column count as absent.
_NODES = f"""
    RECURSIVE docs AS (
      SELECT 'aligned_news' AS t, aligned_id AS id, json_object('alignment', alignment) AS v, CAST(NULL AS VARCHAR) AS within FROM aligned_news WHERE alignment IS NOT NULL
      UNION ALL SELECT 'rewrite_runs', run_id, CAST(any_value(state_json) AS JSON), NULL FROM rewrite_runs WHERE state_json IS NOT NULL AND json_valid(state_json) GROUP BY run_id
      UNION ALL SELECT 'injection_results', result_id, CAST(injection_results AS JSON), 'injected_versions' FROM injection_results WHERE json_valid(injection_results)
    ), node AS (
      SELECT t, id, v, '' AS path, '' AS name, CAST(NULL AS INTEGER) AS position, false AS scoped, within IS NULL AS allowed, 0 AS depth, '$' AS parent, CAST([] AS BIGINT[]) AS ord, within FROM docs
      UNION ALL
      SELECT t, id, CASE WHEN json_type(raw) = 'OBJECT' AND listed THEN json_array(raw) ELSE raw END, cpath, cname, cpos, scoped OR cname IN {SCOPES}, allowed OR (depth = 0 AND cname = within), depth + 1,
        CASE WHEN counted THEN path ELSE parent END, list_append(ord, i), within
      FROM (
        SELECT *, CASE WHEN listed AND json_type(child) = 'VARCHAR' AND json_valid(child ->> '$') THEN CAST(child ->> '$' AS JSON) ELSE child END AS raw
        FROM (
          SELECT *, (position IS NOT NULL AND scoped AND allowed) AS counted, json_extract(v, '$."' || k || '"') AS child, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS cpath, k AS cname, CAST(NULL AS INTEGER) AS cpos,
            k IN {LIST_FIELDS} AS listed
          FROM (SELECT *, unnest(json_keys(v)) AS k, unnest(range(len(json_keys(v)))) AS i FROM node WHERE json_type(v) = 'OBJECT')
          UNION ALL
          SELECT * EXCLUDE (k, i), k, i, false, json_extract(v, '$[' || k || ']'), path || '[' || k || ']', name, CAST(k AS INTEGER), false
          FROM (SELECT *, CAST(unnest(range(CAST(json_array_length(v) AS BIGINT))) AS VARCHAR) AS k, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM node WHERE json_type(v) = 'ARRAY')
        ) WHERE NOT (t = 'aligned_news' AND json_type(child) = 'NULL' AND cpos IS NULL)
      )
    ), numbered AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY t, id ORDER BY ord) - 1 AS INTEGER) AS pre FROM node
    ), found AS (
      SELECT t AS rec_table, id AS rec_id, pre, path, parent AS parent_path, name AS node_type, position, depth, v FROM numbered WHERE position IS NOT NULL AND scoped AND allowed AND json_type(v) = 'OBJECT'
    ), linked AS (
      SELECT f.*, p.pre AS parent_pre FROM found f LEFT JOIN found p ON p.rec_table = f.rec_table AND p.rec_id = f.rec_id AND p.path = f.parent_path
    )
"""


def _table_sql(node_type: str, columns: dict[str, str]) -> str:
    kinds = {"int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    own = ", ".join(f"TRY_CAST(v ->> '$.{c}' AS {kinds[t]}) AS {c.replace('.', '_')}" for c, t in columns.items())
    return f"WITH {_NODES} SELECT rec_table, rec_id, pre, parent_pre, path, parent_path, position, {own} FROM linked WHERE node_type = '{node_type}'"


SQL = {
    "p1_found": f"WITH {_NODES} SELECT rec_table, rec_id, parent_path, path AS child_path FROM found",
    "p1_node_counts": f"WITH {_NODES} SELECT rec_table, node_type, count(*) AS n_nodes, count(*) FILTER (parent_pre IS NULL) AS n_roots, CAST(max(depth) AS BIGINT) AS max_depth FROM linked GROUP BY ALL",
    "p1_unreadable": """
        SELECT 'rewrite_runs' AS rec_table, run_id AS rec_id, 'not_json' AS reason, CAST(length(any_value(state_json)) AS INTEGER) AS n_chars FROM rewrite_runs WHERE NOT json_valid(state_json) GROUP BY run_id
        UNION ALL SELECT 'injection_results', result_id, 'not_json', CAST(length(injection_results) AS INTEGER) FROM injection_results WHERE NOT json_valid(injection_results)
    """,
}
SQL |= {f"p1_{'alignment_rows' if t == 'alignment' else t}": _table_sql(t, c) for t, c in TABLES.items()}
