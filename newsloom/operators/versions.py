"""Version sets and conflicts: usable versions, shared entities, conflicts by entity and by pair of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import locate_span, strip

VERSIONS = ("rewritten_v1", "rewritten_v2", "rewritten_v3")


def first_filled(*cols: str) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def normalise_versions(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, input_text, rewritten_v1..3)`` from items that carry any of the alternative fields.

    Precedence: direct versions (one that isn't null is enough), else the first three entries of the first list of
    rewrites that isn't empty, else those of ``top_rewrites``, else legacy fields. A list is taken whole: an empty
    entry stays empty, whatever the other lists hold. Missing columns count as null. ``keep`` names columns to carry along.
    """
    have = set(items.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(""))
    lists = [n for n in ("rewrite_versions", "top_rewrites", "rewrites") if n in have]
    none = F.array().cast("array<string>")
    first = F.coalesce(*[F.when(F.size(n) > 0, _entry_texts(items, n)) for n in lists], none)
    top = _entry_texts(items, "top_rewrites") if "top_rewrites" in lists else none
    filled = lambda texts: F.coalesce(F.exists(texts, lambda t: t != ""), F.lit(False))
    is_direct = F.lit(False)
    for n in VERSIONS:
        if n in have:
            is_direct = is_direct | F.col(n).isNotNull()
    legacy = [pick("final_rewritten_text", "final_text"), pick("alt_rewrite_1"), pick("alt_rewrite_2")]
    rows = items.select(*keep, pick("id", "news_id", "item_id").alias("id"), pick("input_text", "text", "original_text", "input").alias("input_text"), is_direct.alias("_direct"), first.alias("_first"), F.coalesce(top, none).alias("_top"), *[pick(v).alias(f"_d{i}") for i, v in enumerate(VERSIONS)], *[c.alias(f"_l{i}") for i, c in enumerate(legacy)])
    at = lambda texts, i: F.coalesce(F.get(texts, F.lit(i)), F.lit(""))
    out = [F.when(F.col("_direct"), F.col(f"_d{i}")).when(filled(F.col("_first")), at("_first", i)).when(filled(F.col("_top")), at("_top", i)).otherwise(F.col(f"_l{i}")).alias(v) for i, v in enumerate(VERSIONS)]
    return rows.select(*keep, "id", "input_text", *out)


def _entry_texts(items: DataFrame, name: str) -> Column:
    """The texts of a list's first three entries, '' where an entry has none."""
    element = items.schema[name].dataType.elementType

    def text(e: Column) -> Column:
        if not hasattr(element, "names"):
            return F.coalesce(e.cast("string"), F.lit(""))
        fields = [f for f in ("final_rewritten_text", "final_text", "text", "content", "summary") if f in element.names]
        return F.coalesce(*[F.nullif(e[f].cast("string"), F.lit("")) for f in fields], F.lit(""))

    return F.transform(F.slice(F.col(name), 1, 3), text)


def usable_versions(items: DataFrame, columns: tuple[str, ...] = VERSIONS) -> DataFrame:
    """``n_usable`` (versions that aren't blank), ``needs_fusion`` (two or more) and ``fallback_text`` (the first usable one)."""
    texts = F.filter(F.array(*columns), lambda x: x.isNotNull() & (strip(x) != ""))
    return items.select("*", F.size(texts).alias("n_usable"), (F.size(texts) >= 2).alias("needs_fusion"), F.coalesce(F.get(texts, F.lit(0)), F.lit("")).alias("fallback_text"))


def long_versions(items: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """``(id, version_id, text)``, one row for each version that isn't blank; any number of sources works."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("version_id"), F.col(c).alias("text")) for c in columns])).alias("v")
    return items.select(id_col, pairs).select(id_col, "v.version_id", "v.text").filter(F.col("text").isNotNull() & (strip("text") != ""))


#: Kinds of entities that conflicts are made of. Fixed values.
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "DATE", "CARDINAL", "MONEY", "PERCENT")


def usable_entities(entities: DataFrame, by: list[str], order: str, text: str = "text", label: str = "label") -> DataFrame:
    """Entities of the seven kinds, each text and label once for ``by``: the first in ``order``. Others and empty ones are left out."""
    known = entities.filter(F.col(label).isin(*ENTITY_TYPES) & (F.coalesce(F.col(text), F.lit("")) != ""))
    rest = [c for c in entities.columns if c not in (*by, text, label)]
    rows = known.groupBy(*by, text, label).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return rows.select(*by, text, label, "_r.*")


def conflict_totals(conflicts: DataFrame, by: list[str]) -> DataFrame:
    """Conflicts and entities with conflicts of each group; an entity counts even if only one version has it, an empty one doesn't."""
    return conflicts.groupBy(*by).agg(F.count("*").alias("total_conflicts"), F.countDistinct(F.nullif("entity_text", F.lit(""))).alias("entities_with_conflicts"))


def shared_entities(entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Entities of ``(id, version_id, text, label)`` that occur in all versions of their item: relational division by counts."""
    distinct = entities.select(id_col, "version_id", "text", "label").distinct()
    per_item = distinct.groupBy(id_col).agg(F.countDistinct("version_id").alias("n_versions"))
    per_entity = distinct.groupBy(id_col, "text", "label").agg(F.countDistinct("version_id").alias("in_versions"))
    return per_entity.join(per_item, id_col).filter(F.col("in_versions") == F.col("n_versions")).select(id_col, "text", "label", F.col("n_versions").cast("bigint").alias("n_versions"))


def conflict_counts(conflicts: DataFrame) -> DataFrame:
    """Conflicts by type and version in one pass, with totals; a missing type or version is ``unknown``."""
    rows = conflicts.select(F.coalesce("conflict_type", F.lit("unknown")).alias("conflict_type"), F.coalesce("version_id", F.lit("unknown")).alias("version_id"))
    return rows.cube("conflict_type", "version_id").agg(F.count("*").alias("n_conflicts"))


def entity_conflicts(conflicts: DataFrame, id_col: str = "id") -> DataFrame:
    """Entities in conflict in more than one version, with sorted versions, values and types. An empty entity is none."""
    named = conflicts.filter(F.col("entity_text") != "")
    out = named.groupBy(id_col, "entity_text").agg(
        F.sort_array(F.collect_set("version_id")).alias("conflict_versions"), F.sort_array(F.collect_set("injected_span")).alias("different_values"), F.sort_array(F.collect_set("conflict_type")).alias("conflict_types")
    )
    return out.filter(F.size("conflict_versions") > 1)


def version_pair_conflicts(conflicts: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """Pairs of versions that give an entity different values; the last value by ``order`` counts, empty ones don't.

    An equi-join on item and entity: pairs form among an entity's few versions only.
    """
    named = conflicts.filter((F.col("entity_text") != "") & F.col("version_id").isNotNull())
    last = named.groupBy(id_col, "entity_text", "version_id").agg(F.max_by("injected_span", order).alias("value"), F.min("conflict_type").alias("conflict_type")).filter("value <> ''")
    a = last.select(id_col, "entity_text", F.col("version_id").alias("v1"), F.col("value").alias("v1_value"), "conflict_type")
    b = last.select(id_col, "entity_text", F.col("version_id").alias("v2"), F.col("value").alias("v2_value"))
    return a.join(b, [id_col, "entity_text"]).filter((F.col("v1") < F.col("v2")) & (F.col("v1_value") != F.col("v2_value")))


def locate_conflicts(conflicts: DataFrame, text_col: str = "injected_text") -> DataFrame:
    """``span_start`` and ``span_end`` of each conflict's injected span in its text."""
    start, end = locate_span("injected_span", text_col)
    return conflicts.withColumn("span_start", start).withColumn("span_end", end)
