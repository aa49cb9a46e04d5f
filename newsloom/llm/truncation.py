"""Values cut off by field limits or mid-transfer.

1. ``spikes``: per source and column, the histograms of lengths in characters and in bytes are tested for spikes at the
   maximum: a length that next to nothing exceeds and that more values share than chance allows (a Poisson tail below
   ``CHANCE``, given how dense the lengths around it and in the whole group are). The test is the same for three values
   as for three million.
2. Values at a spike without terminal punctuation are cut by the field's limit: reason ``limit``.
3. Values lost in transfer have no common length, so no histogram shows them; they have an open end: a last line of
   running text without a closing mark, an unpaired quotation, a broken character, a mark of omission, or a structure
   that is not closed: reason ``open_end``. A last line that is a credit, a label, a data row or a heading of its own
   form is no open end, nor is structured text that is complete but malformed. Thai has no closing marks: an end is
   natural if, wherever its last characters occur in Thai texts, a space follows often enough (``THAI_RATE``).

Scale: one scan of the whole texts, which writes a few numbers for each value; Thai contexts are counted inside the
Arrow batches of the same scan. Histograms are partial aggregations with at most one row for each length that occurs, so
no source is a task of its own, and spikes are a few rows for each source.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.sources.session import cut, small_batches, spread, table

#: A spike is as tall as chance makes it with less than this probability, with at most BEYOND of the values above it.
CHANCE = 1e-6
BEYOND = 0.03
NEIGHBOURS = 40
#: A cut at a limit may lose white space, or end in a replacement character of three bytes.
SLACK = 2
#: Characters of an end that are looked up, and the share of their occurrences that a space follows, of a natural one.
THAI_END = 3
THAI_RATE = 0.1

TERMINAL = set(".。!?！？।॥؟۔｡")
CLOSING = "”\"»“’'」』)）]】》"
#: Marks that stand for what is missing. Fixed values.
OMISSION = regex.compile(r"(?i)(?:\[\s*(?:truncated|cut|\.{3}|…|more|\+\d+ (?:chars|characters|more))\s*\]|\((?:more|truncated|continued|cont\.|\.{3}|…)\)|<(?:truncated|snip|more)>|read more|\[\+\d+ chars\])\s*$")
ELLIPSIS = regex.compile(r"(?:…|\.\.\.)\s*$")
#: Abbreviations that don't end a text, and marks after which something must follow.
ABBREVIATED = regex.compile(
    r"(?:^|[\s (“\"«'’])(?:Mr|Mrs|Ms|Dr|Gen|St|Nos?|no|figs?|pp?|approx|Jan|Feb|Sept?|Oct|Nov|Dec|vs|i|i\.e|e\.g|U|U\.[SN]|[A-Z]|Nr|ca|z|d|h|z\. B|d\. h|jun|Sr|Sra|Dra|Ing|pág|art|aprox|a|p|M|MM|env|cf|ул|д|ок|т|т\. е|डॉ|मी|د|م)\.$"
    # a day of the month after a German preposition or article
    r"|\b(?:am|vom|seit|bis|dem|den|zum|ab|Seit|Am|Bis|Vom|Ab) \d{1,2}\.$"
)
_LABEL = r"[\p{L}][\p{L}\p{M}' ]{0,28}\s?[:：]\s?\S.{0,90}"
#: Last lines that are complete without a closing mark.
TAIL_LINE = regex.compile(
    rf"\s*(?:[-–—•*]\s+[\p{{L}}\p{{M}} ]{{2,40}}[:：]\s?[\d.,]+|[–—]\s+\S.{{3,90}}|{_LABEL}|[(（][^()（）]{{3,80}}[)）]|(?:https?://|www\.)\S+|\S+@\S+\.\w+)\s*$"
)
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》"}
THAI = regex.compile(r"[\p{Thai}\d]$")


def unpaired(line: str) -> bool:
    """Whether a quotation or bracket of a line is open at its end."""
    stack: list[str] = []
    for ch in line:
        if stack and ch in PAIRS[stack[-1]]:
            stack.pop()
        elif ch in PAIRS:
            stack.append(ch)
    return bool(stack) or line.count('"') % 2 == 1


def ending(text: str) -> tuple[str, bool]:
    """How a text ends: (``cut``, ``ellipsis``, ``open``, ``closed``, ``tail`` or ``thai``, whether terminal punctuation closes it)."""
    text = text.rstrip()
    if not text:
        return "closed", True
    if OMISSION.search(text) or text.endswith("�"):
        return "cut", False
    line = text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]
    first = len(line) == len(text)
    if ELLIPSIS.search(text):
        return "ellipsis", False
    bare = text.rstrip(CLOSING + " ")
    closed = bool(bare) and bare[-1] in TERMINAL
    if closed:
        if text[-1] == "." and ABBREVIATED.search(line) and not re.search(r"\d\s?[ap]\.\s?m\.$", line):
            return "open", False
        if unpaired(line):
            return "open", False
        return "closed", True
    if not first and TAIL_LINE.fullmatch(line):
        return "tail", False
    if THAI.search(text) and regex.search(r"\p{Thai}", line):
        return "thai", False
    return "open", False


FENCE = regex.compile(r"(?:\s*(?:```|={3,}\s*[A-Z]+\s*={3,}|//\s*end|#\s*end|<!--\s*end\s*-->|</[a-z]+>))+\s*$")
PART_OF_FENCE = regex.compile(r"(?:(?:^|[\]}\s])`{1,2}|\n=+[A-Z]*=*|[\]}]\s*=+[A-Z]*=*|[\]}]\s*/{1,2}\s*e?n?)$")
CLOSED_LIST = regex.compile(r"[}\])]\s*,?\s*[\]}]\s*[,;.]?\s*$|\[\s*\]\s*$")


def structure_end(text: str) -> tuple[str, bool]:
    """The same for structured text: complete if its outer list is closed, whatever follows as a mark of its end."""
    text = text.rstrip()
    if not text:
        return "closed", True
    if OMISSION.search(text) or text.endswith("�"):
        return "cut", False
    if not regex.search(r"[\[{]\s*[\[{\"'\n]|\"\s*[:=]", text):
        return ending(text)
    inner = FENCE.sub("", text)
    if inner == text and PART_OF_FENCE.search(text):
        return "open", False
    if CLOSED_LIST.search(inner):
        return "closed", True
    if ELLIPSIS.search(text):
        return "cut", False
    # structured text with words after it is complete if those are
    at = max(inner.rfind("]\n"), inner.rfind("}\n"), inner.rfind("```\n"))
    if at >= 0 and CLOSED_LIST.search(FENCE.sub("", inner[: at + 1])) and inner[at + 1 :].strip() and not regex.search(r"[\[{\"]", inner[at + 1 :]):
        return ending(inner[at + 1 :])
    return "open", False


#: A row is a value's ending, or (with a null field name) how often a Thai context occurs and a space follows.
END_SCHEMA = "field_name string, row_id bigint, source string, n_chars int, n_bytes int, ending string, closed boolean, thai_end string, n_all bigint, n_space bigint"
_THAI_RUN = regex.compile(r"[\p{Thai}\d.:]+")


def thai_contexts(text: str) -> Iterator[tuple[str, bool]]:
    """The ``THAI_END`` characters before each position inside or at the end of a Thai run, and whether a space stands there.

    The end of the text itself doesn't count, as it may be a cut.
    """
    for m in _THAI_RUN.finditer(text):
        run, end = m.group(), m.end()
        for i in range(THAI_END, len(run) + 1):
            at = m.start() + i
            if at < len(text) and (at < end or text[at].isspace()):
                yield run[i - THAI_END : i], at == end


def endings(values: DataFrame) -> DataFrame:
    """``END_SCHEMA`` of ``values(field_name, row_id, source, text, structured)`` in one scan; null and blank values give no row.

    Rows with a field name are values, each key once; the others count Thai contexts.
    """
    small_batches(values.sparkSession)
    rows = values.filter("text is not null and text rlike '(?U)\\\\S'").select("field_name", "row_id", F.lower("source").alias("source"), F.octet_length("text").alias("n_bytes"), "text", "structured")
    names = [c.split()[0] for c in END_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contexts: dict[str, Counter] = {"all": Counter(), "space": Counter()}
            out = []
            for field, row_id, source, n_bytes, text, structured in pdf.itertuples(index=False):
                end, closed = structure_end(text) if structured else ending(text)
                stripped = text.rstrip()
                out.append((field, row_id, source, len(text), n_bytes, end, closed, stripped[-THAI_END:] if end == "thai" else None, None, None))
                if not text.isascii() and regex.search(r"\p{Thai}", text):
                    for context, space in thai_contexts(stripped):
                        contexts["all"][context] += 1
                        contexts["space"][context] += space
            out += [(None, None, None, None, None, None, None, c, n, contexts["space"][c]) for c, n in contexts["all"].items()]
            yield pd.DataFrame(out, columns=names).astype({"row_id": "Int64", "n_chars": "Int32", "n_bytes": "Int32", "n_all": "Int64", "n_space": "Int64", "closed": "boolean"})

    return spread(rows).mapInPandas(run, END_SCHEMA)


def of_values(ends: DataFrame) -> DataFrame:
    """The values among ``endings``, each key once."""
    return ends.filter("field_name is not null").drop("n_all", "n_space").dropDuplicates(["field_name", "row_id"])


def spikes(ends: DataFrame) -> DataFrame:
    """``(field_name, source, unit, size, n, n_total)``: lengths in characters or bytes at which a source's values were cut."""
    sizes = ends.select("field_name", "source", F.expr("stack(2, 'chars', n_chars, 'bytes', n_bytes) as (unit, size)"))
    group = ["field_name", "source", "unit"]
    histogram = sizes.groupBy(*group, "size").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    near = whole.orderBy("size").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    # values of the next lengths below may be cut ones that lost white space, those above end in a replacement character
    edge = whole.orderBy("size").rangeBetween(-SLACK, SLACK)
    above = whole.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = histogram.select(
        "*", F.sum("n").over(near).alias("around"), F.sum("n").over(edge).alias("at_edge"), F.sum("n").over(above).alias("up"), F.sum("n").over(whole).alias("n_total"), (F.max("size").over(whole) - F.min("size").over(whole) + 1).alias("span")
    )
    beyond = (F.col("up") - F.col("n")) / F.col("n_total")
    # the mean number of values of one length: around this one, but no less than in the group as a whole
    mean = F.greatest((F.col("around") - F.col("at_edge")) / (2.0 * (NEIGHBOURS - SLACK)), (F.col("n_total") - F.col("at_edge")) / F.col("span"), F.lit(1e-3))
    # Chernoff's bound of the Poisson tail, in logarithms: P(X >= k) <= exp(k - m) (m / k)^k for k > m. One value stands at the maximum anyway.
    k = (F.col("n") - 1).cast("double")
    tail = F.when(k > mean, k - mean + k * F.log(mean / F.greatest(k, F.lit(1e-9)))).otherwise(F.lit(0.0))
    # bytes: replacement characters spread the top over three lengths, so what lies within SLACK above doesn't count as beyond
    top = beyond <= F.greatest(F.lit(BEYOND), F.col("n") / F.col("n_total"))
    return h.filter((tail < math.log(CHANCE)) & top).select(*group, "size", "n", "n_total")


def judged(values: DataFrame) -> DataFrame:
    """Every value's ending, with ``at_limit`` (its length is at a spike of its source), ``is_cut`` and ``reason``.

    ``reason`` is ``limit`` for a value at a spike without terminal punctuation, ``open_end`` for another cut value, else
    null. The endings, a few numbers for each value, are written to the shared folder, as histograms and verdicts both
    read them.
    """
    ends = cut(endings(values), "endings")
    once = of_values(ends)
    top = F.col("size") + F.when(F.col("unit") == "bytes", SLACK).otherwise(0)
    near = spikes(once).select("field_name", "source", "unit", F.col("size").alias("spike"), F.explode(F.sequence(F.col("size") - SLACK, top)).alias("size"))
    limit = near.groupBy("field_name", "source", "unit", "size").agg(F.max(F.col("size") == F.col("spike")).alias("exact"))
    chars = limit.filter("unit = 'chars'").select("field_name", "source", F.col("size").alias("n_chars"), F.col("exact").alias("at_chars"))
    bytes_ = limit.filter("unit = 'bytes'").select("field_name", "source", F.col("size").alias("n_bytes"), F.col("exact").alias("at_bytes"))
    natural = ends.filter("field_name is null").groupBy("thai_end").agg((F.sum("n_space") / F.sum("n_all")).alias("rate"))
    thai = once.filter("thai_end is not null").join(natural, "thai_end", "left")  # only Thai values carry the key, so none is null
    both = once.filter("thai_end is null").withColumn("rate", F.lit(None).cast("double")).unionByName(thai)
    both = both.join(chars, ["field_name", "source", "n_chars"], "left").join(bytes_, ["field_name", "source", "n_bytes"], "left")
    at_limit = F.col("at_chars").isNotNull() | F.col("at_bytes").isNotNull()
    exactly = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    by_limit = (at_limit & F.col("ending").isin("cut", "open", "ellipsis")) | (exactly & F.col("ending").isin("tail", "thai"))
    by_end = F.col("ending").isin("cut", "open") | ((F.col("ending") == "thai") & (F.coalesce("rate", F.lit(0.0)) < THAI_RATE))
    reason = F.when(by_limit, "limit").when(by_end, "open_end")
    return both.select("field_name", "row_id", "source", "n_chars", "n_bytes", "ending", at_limit.alias("at_limit"), (by_limit | by_end).alias("is_cut"), reason.alias("reason"))


def news_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, key: str, column: str, structured: bool) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(column).alias("field_name"), F.col(key).alias("row_id"), "source", F.col(column).alias("text"), F.lit(structured).alias("structured"))

    return part("injected_versions", "injection_id", "injected_text", False).unionByName(part("fused_news", "fused_id", "fused_content", False)).unionByName(part("aligned_news", "aligned_id", "raw_alignment", True))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(news_values(spark, sf_dir)).filter("is_cut").select("field_name", "row_id")


def p4_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut values of each column and source by reason, and their share."""
    by = judged(news_values(spark, sf_dir)).groupBy("field_name", "source")
    return by.agg(
        F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("reason") == "limit").alias("n_by_limit"), F.count_if(F.col("reason") == "open_end").alias("n_by_open_end"),
        F.count_if("at_limit").alias("n_at_limit"), F.avg(F.col("is_cut").cast("double")).alias("cut_share"),
    )


def p4_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(of_values(endings(news_values(spark, sf_dir))))


QUERIES = {"p4_found": p4_found, "p4_by_source": p4_by_source, "p4_spikes": p4_spikes}

#: The histogram test in SQL.
SQL = {
    "p4_spikes": rf"""
    WITH val AS (
      SELECT 'injected_text' AS field_name, injection_id AS row_id, any_value(source) AS source, any_value(injected_text) AS t FROM injected_versions WHERE injected_text IS NOT NULL GROUP BY injection_id
      UNION ALL SELECT 'fused_content', fused_id, any_value(source), any_value(fused_content) FROM fused_news WHERE fused_content IS NOT NULL GROUP BY fused_id
      UNION ALL SELECT 'raw_alignment', aligned_id, any_value(source), any_value(raw_alignment) FROM aligned_news WHERE raw_alignment IS NOT NULL GROUP BY aligned_id
    ), one AS (SELECT field_name, lower(source) AS source, unnest(['chars', 'bytes']) AS unit, unnest([length(t), strlen(t)]) AS size FROM val WHERE regexp_matches(t, '[^\s\p{{Z}}\x{{85}}]')),
    h AS (SELECT field_name, source, unit, size, count(*) AS n FROM one GROUP BY ALL),
    w AS (
      SELECT *, sum(n) OVER (g ORDER BY size RANGE BETWEEN {NEIGHBOURS} PRECEDING AND {NEIGHBOURS} FOLLOWING) AS around, sum(n) OVER (g ORDER BY size RANGE BETWEEN {SLACK} PRECEDING AND {SLACK} FOLLOWING) AS at_edge,
        sum(n) OVER (g ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up, sum(n) OVER (g) AS n_total, max(size) OVER (g) - min(size) OVER (g) + 1 AS span FROM h WINDOW g AS (PARTITION BY field_name, source, unit)
    ), m AS (SELECT *, greatest((around - at_edge) / {2.0 * (NEIGHBOURS - SLACK)}, (n_total - at_edge) / span, 0.001) AS mean, CAST(n - 1 AS DOUBLE) AS k FROM w)
    SELECT field_name, source, unit, CAST(size AS INTEGER) AS size, n, CAST(n_total AS BIGINT) AS n_total FROM m
    WHERE (CASE WHEN k > mean THEN k - mean + k * ln(mean / greatest(k, 1e-9)) ELSE 0 END) < ln({CHANCE}) AND (up - n) / n_total <= greatest({BEYOND}, n / n_total)
""",
}
