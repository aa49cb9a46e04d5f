"""Schemas that drift between files: path-value maps, per-file type statistics, change reports, typed tables.

Every row is loaded as a path-value map with raw types (``path_value_map``; ``path_values`` is its table). All else
reads these maps: ``path_stats`` aggregates them by file, ``drift`` compares each file of a feed with the one before, and
``typed_items`` / ``typed_versions`` project typed columns, with ``cast_failures`` naming every value that did not fit.

Scale: the statistics are aggregated inside each Arrow batch before the shuffle, so the shuffle carries
(files x paths), not rows, and a feed that holds a third of all rows costs no more than the others. Files
are put in order by their keys alone; a file's schema is bounded by its distinct paths.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.nested import parse
from newsloom.sources.session import cut, small_batches, table

#: Joins the names of a path inside this module; unlike a dot it does not occur in field names.
SEP = "\x1f"
ELEMENT = "[]"
#: Largest alias table that is taken to the driver; it describes a feed format, not the data.
MAX_ALIASES = 10_000

STATS_SCHEMA = "feed_id bigint, batch_no int, path string, kind string, n bigint"


def kind_of(v) -> str | None:
    """string, number, boolean, object or array; None for a null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


def path_value_map(record) -> dict[str, tuple[str, object]]:
    """Path to (kind, value) of every non-null value below a record, in the order of a pre-order walk.

    Names are joined by ``SEP``; an element of an array is named by its position in brackets. Objects and arrays have
    the value None, as their content has paths of its own.
    """
    out: dict[str, tuple[str, object]] = {}
    stack: list = [("", record)]
    while stack:
        path, v = stack.pop()
        if path:
            out[path] = (kind_of(v), None if isinstance(v, (dict, list)) else v)
        items = list(v.items()) if isinstance(v, dict) else [(f"[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else []
        stack.extend((f"{path}{SEP}{k}" if path else k, x) for k, x in reversed(items) if x is not None)
    return out


def general(path: str) -> str:
    """A path with ``ELEMENT`` for the positions in arrays."""
    return SEP.join(ELEMENT if n[:1] == "[" and n[-1:] == "]" and n[1:-1].isdigit() else n for n in path.split(SEP)) if "[" in path else path


def rebuilt(values: dict[str, tuple[str, object]]) -> dict:
    """The object that a path-value map tells of, without nulls; elements of arrays keep their positions."""
    root: dict = {}
    at: dict[str, object] = {"": root}
    for path, (kind, v) in values.items():
        up, _, name = path.rpartition(SEP)
        v = {} if kind == "object" else [] if kind == "array" else v
        holder = at[up]
        if isinstance(holder, list):
            holder.extend([None] * (int(name[1:-1]) - len(holder)))
            holder.append(v)
        else:
            holder[name] = v
        if isinstance(v, (dict, list)):
            at[path] = v
    return root


def path_values(records: DataFrame) -> DataFrame:
    """``records(line_id, feed_id, batch_no, payload)`` with ``values``: path to the struct of its kind and value as text.

    Paths are joined with dots for reading. Text of a value is its JSON, but for strings. A null or unreadable payload
    and one that is no object give an empty map.
    """
    small_batches(records.sparkSession)
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))

    @F.pandas_udf(schema)
    def load(payload: pd.Series) -> pd.Series:
        out = []
        for text in payload:
            rec = parse(text)
            found = path_value_map(rec) if isinstance(rec, dict) else {}
            out.append({p.replace(f"{SEP}[", "[").replace(SEP, "."): {"kind": k, "value": v if v is None or isinstance(v, str) else json.dumps(v)} for p, (k, v) in found.items()})
        return pd.Series(out)

    return records.select("line_id", "feed_id", "batch_no", load("payload").alias("values"))


def path_stats(records: DataFrame) -> DataFrame:
    """Number of values of each (feed_id, batch_no, path, kind); nulls and unreadable payloads add nothing.

    ``path`` joins names by ``SEP``. Rows with a null feed or file number form files of their own.
    """
    small_batches(records.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple, int] = defaultdict(int)
            for feed, batch, payload in zip(pdf.feed_id, pdf.batch_no, pdf.payload):
                key = (None if pd.isna(feed) else int(feed), None if pd.isna(batch) else int(batch))
                seen[(*key, "", "object")] += 1  # the file is there even if its records are empty
                for p, (kind, _) in path_value_map(parse(payload)).items():
                    seen[(*key, general(p), kind)] += 1
            out = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feed_id", "batch_no", "path", "kind", "n"])
            yield out.astype({"feed_id": "Int64", "batch_no": "Int32", "n": "int64"})

    rows = records.select("feed_id", "batch_no", "payload").mapInPandas(count, STATS_SCHEMA)
    return rows.groupBy("feed_id", "batch_no", "path", "kind").agg(F.sum("n").alias("n"))


class Node:
    """Schema of one place: the kinds of its values, its fields and its array elements."""

    __slots__ = ("kinds", "fields", "element")

    def __init__(self) -> None:
        self.kinds: set[str] = set()
        self.fields: dict[str, Node] = {}
        self.element: Node | None = None


def tree(paths: list[tuple[str, str]]) -> Node:
    root = Node()
    for path, kind in paths:
        at = root
        for name in path.split(SEP) if path else ():
            if name == ELEMENT:
                at.element = at.element or Node()
                at = at.element
            else:
                at = at.fields.setdefault(name, Node())
        at.kinds.add(kind)
    return root


class Aliases:
    """Names of one canonical field by place: ``item`` (top level) and ``entry`` (object in a list of rewrites)."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.canonical: dict[tuple[str, str], set[str]] = defaultdict(set)
        for place, canonical, alias in rows:
            if place and canonical and alias:
                self.canonical[(place, alias)].add(canonical)
                self.canonical[(place, canonical)].add(canonical)

    def same(self, place: str | None, a: str, b: str) -> bool:
        return bool(place and self.canonical.get((place, a), set()) & self.canonical.get((place, b), set()))

    def is_rewrites(self, name: str) -> bool:
        return "rewrite_versions" in self.canonical.get(("item", name), ())


def folded(name: str) -> str:
    return name.replace("_", "").replace("-", "").lower()


def compare(old: Node, new: Node, aliases: Aliases) -> list[tuple[str, str]]:
    """(drift, path) of every change from one file's schema to the next one's."""
    out: list[tuple[str, str]] = []

    def node(a: Node, b: Node, path: str, place: str | None) -> None:
        if a.kinds != b.kinds:
            out.append(("retyped", path))
        else:
            inside(a, b, path, place)

    def inside(a: Node, b: Node, path: str, place: str | None) -> None:
        gone, come = sorted(a.fields.keys() - b.fields.keys()), sorted(b.fields.keys() - a.fields.keys())
        pairs = [(g, c) for g in gone for c in come if folded(g) == folded(c)] + [(g, c) for g in gone for c in come if aliases.same(place, g, c)]
        renamed: dict[str, str] = {}
        for g, c in pairs:
            if c not in renamed and g not in renamed.values():
                renamed[c] = g
                out.append(("renamed", join(path, c)))
        out.extend(("removed", join(path, g)) for g in gone if g not in renamed.values())
        out.extend(("added", join(path, c)) for c in come if c not in renamed)
        for name, x in b.fields.items():
            before = a.fields.get(renamed.get(name, name))
            if before is not None:
                # at the top level, a list of rewrites leads to entries
                node(before, x, join(path, name), "rewrites" if place == "item" and aliases.is_rewrites(name) else None)
        if a.element and b.element:
            node(a.element, b.element, path + ELEMENT, "entry" if place == "rewrites" else None)

    inside(old, new, "", "item")
    return out


def join(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def load_aliases(field_aliases: DataFrame) -> Aliases:
    """The alias table on the driver; refuses one larger than ``MAX_ALIASES`` rows."""
    rows = field_aliases.select("place", "canonical", "alias").distinct().limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} field aliases")
    return Aliases([tuple(r) for r in rows])


def drift(records: DataFrame, field_aliases: DataFrame) -> DataFrame:
    """One row ``(feed_id, batch_no, drift, field_path)`` of each change between a file and the one before it in its feed.

    A feed's first file, files without a number and feeds without a number give no rows. Rows repeated
    within a file change nothing, as a file's schema is the union over its records.
    """
    aliases = load_aliases(field_aliases)
    stats = path_stats(records).filter("feed_id is not null and batch_no is not null")
    files = cut(stats.groupBy("feed_id", "batch_no").agg(F.collect_list(F.struct("path", "kind")).alias("paths")), "files")
    order = Window.partitionBy("feed_id").orderBy("batch_no")
    keys = files.select("feed_id", "batch_no").withColumn("earlier", F.lag("batch_no").over(order)).filter("earlier is not null")
    before = files.select("feed_id", F.col("batch_no").alias("earlier"), F.col("paths").alias("before"))
    pairs = keys.join(files, ["feed_id", "batch_no"]).join(before, ["feed_id", "earlier"]).select("feed_id", "batch_no", "paths", "before")

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (feed, batch, kind, path)
                for feed, batch, now, before in zip(pdf.feed_id, pdf.batch_no, pdf.paths, pdf.before)
                for kind, path in compare(*(tree([(x["path"], x["kind"]) for x in side]) for side in (before, now)), aliases)
            ]
            yield pd.DataFrame(rows, columns=["feed_id", "batch_no", "drift", "field_path"])

    return pairs.mapInPandas(changes, "feed_id bigint, batch_no int, drift string, field_path string")


#: The consistent tables: canonical column to SQL type. A field belongs to a column if it is one of its aliases or folds to its name.
ITEM_COLUMNS = {
    "id": "string", "input_text": "string", "rewritten_v1": "string", "rewritten_v2": "string", "rewritten_v3": "string",
    "lang": "string", "model_name": "string", "editor_note": "string", "attempt_count": "bigint", "run_seconds": "double", "is_checked": "boolean",
}
ENTRY_COLUMNS = {
    "version_id": "string", "reduced_version_id": "string", "final_rewritten_text": "string", "version_score": "double", "success_ratio": "double",
    "fallback_ratio": "double", "quality_label": "string", "final_passed": "boolean", "segment_count": "bigint",
}
#: Holds what belongs to no column, in both tables.
OTHER = "other_fields"


def _leaves(path: str, v) -> Iterator[tuple[str, object]]:
    """(path, value) below a value, nested objects by path; lists and empty objects stay whole, nulls are left out."""
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from _leaves(f"{path}.{folded(k)}", x)
    elif v is not None:
        yield path, v


def _cast(v, sql_type: str) -> tuple[object, str | None]:
    """The value in a column's type, and why it is null if it didn't fit.

    An object that carries its content under ``value`` counts as that content, a list of texts as the texts
    joined by line breaks, a number as its digits where text is wanted.
    """
    if isinstance(v, dict) and "value" in v:
        v = v["value"]
    if v is None:
        return None, None
    if isinstance(v, list):
        if sql_type == "string" and all(x is None or isinstance(x, str) for x in v):
            return "\n".join(x for x in v if x is not None), None
        return None, f"array is not {sql_type}"
    if isinstance(v, dict):
        return None, f"object is not {sql_type}"
    if sql_type == "string":
        return (v, None) if isinstance(v, str) else (json.dumps(v), None)
    if sql_type == "boolean":
        if isinstance(v, bool):
            return v, None
        text = str(v).strip().lower()
        return (True, None) if text in ("true", "yes", "1") else (False, None) if text in ("false", "no", "0") else (None, f"{kind_of(v)} is not boolean")
    if isinstance(v, bool):
        return int(v) if sql_type == "bigint" else float(v), None
    try:
        x = float(v)
        if sql_type == "double":
            return x, None
        if x == int(x) and abs(x) < 2**63:
            return int(x), None
    except (ValueError, OverflowError):
        pass
    return None, f"{kind_of(v)} is not {sql_type}"


def entries(name: str, v, aliases: Aliases) -> list | None:
    """The entries of a field that holds rewrites: a list, an object as a list of one, a text of JSON as what it holds; None for other fields."""
    if not aliases.is_rewrites(name):
        return None
    if isinstance(v, str):
        v = parse(v)
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else None


def _columns(obj: dict, columns: dict[str, str], place: str, aliases: Aliases) -> tuple[list, list[tuple[str, str, str, str]]]:
    """The values of the columns and of ``OTHER``; the failures, a row of each value without a column among them.

    ``OTHER`` maps the folded path of every value that no column took to its JSON, so that spellings of one field
    meet; where two of them stand in one object, the later one keeps its number.
    """
    by_fold = {folded(c): c for c in columns}
    got: dict[str, tuple[str, object]] = {}
    rest: list[tuple[str, object]] = []
    for name, v in obj.items():
        if v is None or place == "item" and entries(name, v, aliases) is not None:
            continue
        target = next((c for c in sorted(aliases.canonical.get((place, name), ())) if c in columns), by_fold.get(folded(name)))
        if target and (target not in got or name == target):
            if target in got:
                rest.append(got[target])
            got[target] = (name, v)
        else:
            rest.append((name, v))
    values, failures = [], []
    for c, t in columns.items():
        name, v = got.get(c, (None, None))
        x, why = _cast(v, t)
        values.append(x)
        if why:
            failures.append((c, name, json.dumps(v, ensure_ascii=False), why))
        elif isinstance(v, dict) and "value" in v:  # what stands beside the content
            rest.extend((f"{name}.{k}", y) for k, y in v.items() if k != "value")
    other: dict[str, str] = {}
    for name, v in rest:
        for path, x in _leaves(folded(name), v):
            key, n = path, 1
            while key in other:
                key, n = f"{path}#{n + 1}", n + 1
            other[key] = json.dumps(x, ensure_ascii=False)
            failures.append((OTHER, key, other[key], "no column"))
    return [*values, other], failures


def _typed(records: DataFrame, field_aliases: DataFrame, what: str) -> DataFrame:
    aliases = load_aliases(field_aliases)
    small_batches(records.sparkSession)
    keys = ["line_id", "feed_id", "batch_no"]
    key_ddl = "line_id bigint, feed_id bigint, batch_no int"
    names, ddl = {
        "items": ([*keys, *ITEM_COLUMNS, OTHER], key_ddl + "".join(f", {c} {t}" for c, t in ITEM_COLUMNS.items())),
        "versions": ([*keys, "version_no", *ENTRY_COLUMNS, OTHER], key_ddl + ", version_no int" + "".join(f", {c} {t}" for c, t in ENTRY_COLUMNS.items())),
        "failures": ([*keys, "version_no", "column_name", "field_name", "value", "reason"], key_ddl + ", version_no int, column_name string, field_name string, value string, reason string"),
    }[what]
    kinds = dict(x.strip().rsplit(" ", 1) for x in ddl.split(","))
    if what != "failures":
        ddl += f", {OTHER} map<string, string>"

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for line, feed, batch, payload in zip(pdf.line_id, pdf.feed_id, pdf.batch_no, pdf.payload):
                key = tuple(None if pd.isna(x) else int(x) for x in (line, feed, batch))
                rec = parse(payload)
                rec = rebuilt(path_value_map(rec)) if isinstance(rec, dict) else None
                if rec is None:
                    if what == "items":
                        rows.append((*key, *[None] * len(ITEM_COLUMNS), None))
                    elif what == "failures" and payload is not None:
                        rows.append((*key, None, "payload", None, payload, "no JSON object"))
                    continue
                values, failures = _columns(rec, ITEM_COLUMNS, "item", aliases)
                if what == "items":
                    rows.append((*key, *values))
                    continue
                if what == "failures":
                    rows.extend((*key, None, *f) for f in failures)
                no = 0
                for name, v in rec.items():
                    for entry in entries(name, v, aliases) or ():
                        no += 1
                        if entry is None:
                            continue
                        entry = {"final_rewritten_text": entry} if isinstance(entry, str) else entry if isinstance(entry, dict) else {"entry": entry}
                        values, failures = _columns(entry, ENTRY_COLUMNS, "entry", aliases)
                        if what == "versions":
                            rows.append((*key, no, *values))
                        else:
                            rows.extend((*key, no, *f) for f in failures)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: {"bigint": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean"}[t] for c, t in kinds.items() if t != "string"})

    return once(records).mapInPandas(project, ddl)


def once(records: DataFrame) -> DataFrame:
    """Each line once: repeated lines carry the same content, only their arrival differs."""
    return records.select("line_id", "feed_id", "batch_no", "payload").dropDuplicates(["line_id"])


def typed_items(records: DataFrame, field_aliases: DataFrame) -> DataFrame:
    """One consistent row of each line, values without a column in ``OTHER``; an unreadable payload gives a row of nulls."""
    return _typed(records, field_aliases, "items")


def typed_versions(records: DataFrame, field_aliases: DataFrame) -> DataFrame:
    """One consistent row of each entry of a line's list of rewrites; a bare text is its final text.

    A null entry has no row, the others keep their number.
    """
    return _typed(records, field_aliases, "versions")


def cast_failures(records: DataFrame, field_aliases: DataFrame) -> DataFrame:
    """One row of each value that did not fit its column or has none, with the value and the reason."""
    return _typed(records, field_aliases, "failures")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "rewrite_records"), table(spark, d, "field_aliases")


def p2_path_stats(spark: SparkSession, d: str) -> DataFrame:
    return path_stats(once(_tables(spark, d)[0])).filter("path <> ''").withColumn("path", F.expr(f"replace(replace(path, '{SEP}[]', '[]'), '{SEP}', '.')"))


def p2_path_values(spark: SparkSession, d: str) -> DataFrame:
    """One row of each value of each line, with its path, kind and text."""
    rows = path_values(once(_tables(spark, d)[0]))
    return rows.select("line_id", "feed_id", "batch_no", F.explode("values").alias("path", "v")).select("line_id", "feed_id", "batch_no", "path", "v.kind", "v.value")


QUERIES = {
    "p2_found": lambda s, d: drift(*_tables(s, d)),
    "p2_path_values": p2_path_values,
    "p2_path_stats": p2_path_stats,
    "p2_items": lambda s, d: typed_items(*_tables(s, d)),
    "p2_versions": lambda s, d: typed_versions(*_tables(s, d)),
    "p2_cast_failures": lambda s, d: cast_failures(*_tables(s, d)),
}

_KIND = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END"
#: The path-value maps by DuckDB's own parser. 
_VALUES = f"""
    RECURSIVE line AS (
      SELECT line_id, any_value(feed_id) AS feed_id, any_value(batch_no) AS batch_no, any_value(payload) AS payload FROM rewrite_records GROUP BY line_id
    ), node AS (
      SELECT line_id, feed_id, batch_no, CAST(payload AS JSON) AS v, '' AS path, '' AS place FROM line WHERE json_valid(payload)
      UNION ALL
      SELECT line_id, feed_id, batch_no, child, name, shape FROM (
        SELECT line_id, feed_id, batch_no, json_extract(v, '$."' || k || '"') AS child, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS name, CASE WHEN place = '' THEN k ELSE place || '.' || k END AS shape
        FROM (SELECT *, unnest(json_keys(v)) AS k FROM node WHERE json_type(v) = 'OBJECT')
        UNION ALL
        SELECT line_id, feed_id, batch_no, json_extract(v, '$[' || i || ']'), path || '[' || i || ']', place || '[]'
        FROM (SELECT *, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM node WHERE json_type(v) = 'ARRAY')
      ) WHERE json_type(child) <> 'NULL'
    ), val AS (SELECT line_id, feed_id, batch_no, path, place, {_KIND} AS kind, v FROM node WHERE path <> '')
"""
SQL: dict[str, str] = {
    "p2_path_values": f"WITH {_VALUES} SELECT line_id, feed_id, batch_no, path, kind, CASE WHEN kind = 'string' THEN v ->> '$' WHEN kind IN ('number', 'boolean') THEN CAST(v AS VARCHAR) END AS value FROM val",
    "p2_path_stats": f"WITH {_VALUES} SELECT feed_id, batch_no, place AS path, kind, count(*) AS n FROM val GROUP BY ALL",
}
