"""Text functions on columns. All stay in the JVM; lengths and offsets count code points."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space at the ends of a text, the same set for Spark and for the SQL counterparts.
SPACES = " \t\n\x0b\f\r\x85\xa0\u2028\u2029\u3000"
#: Runs of letters, digits and underscores in any script.
WORD = r"[\p{L}\p{N}_]+"
HAN = r"[一-鿿]"
ALIGNMENT_MARK = "====ALIGNMENT===="

#: Headings that models put before a text; fixed values, English and Chinese.
PREFIXES = ["Fused News:", "Fusion Result:", "Final Version:", "Fusion Version:", "Example Output:"]
PREFIXES_ZH = ["融合后的新闻:", "融合结果:", "最终版本:", "融合版本:", "示例输出:"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.btrim(col(c), F.lit(SPACES))


def non_blank(items: Column) -> Column:
    """The stripped items of an array that aren't empty."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def paragraphs(c: Column | str) -> Column:
    """Paragraphs: split at blank lines, failing that at lines, failing that the whole text; runs of blanks squeezed.

    An empty array for an empty, blank or null text.
    """
    text = F.regexp_replace(col(c), r"[ \t]+", " ")
    blank, line = non_blank(F.split(text, r"\n\n")), non_blank(F.split(text, r"\n"))
    return F.when(F.size(blank) > 1, blank).otherwise(F.when(F.size(line) > 1, line).otherwise(non_blank(F.array(text))))


def sentences(c: Column | str) -> Column:
    """Simple sentence units: after full-width and half-width marks, line breaks, and marks followed by space."""
    return non_blank(F.split(col(c), r"[。！？!?；;]|[\n\r]+|(?<=[.?!])[ \t\n\f\r]+"))


def full_stops(c: Column | str) -> Column:
    """Pieces between marks that end a statement, for counting complete sentences."""
    return F.split(col(c), r"[。！？!?]")


def words(c: Column | str) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({WORD})"), 1)


def value_text(df: DataFrame, name: str) -> Column:
    """A column's value as text: '' for null, text as it is, other scalars as written, anything nested as JSON."""
    kind = df.schema[name].dataType.typeName()
    nested = kind in ("array", "struct", "map", "variant")
    return F.coalesce(F.to_json(name) if nested else F.col(name).cast("string"), F.lit(""))


def has_han(c: Column | str) -> Column:
    return col(c).rlike(HAN)


def locate_span(span: Column | str, text: Column | str) -> tuple[Column, Column]:
    """(start, end) of the first occurrence, end exclusive; nulls if it is empty or isn't there."""
    at = F.when(col(span) != "", F.instr(col(text), col(span)))
    start = F.when(at > 0, at - 1).cast("int")
    return start, (start + F.length(col(span))).cast("int")


def theme(sentences_: Column, text: Column | str) -> Column:
    """A heading from the first key sentence: white space squeezed, at most 60 characters; else the text's first 50."""
    best = F.regexp_replace(strip(F.get(sentences_, F.lit(0))), r"[ \t\n\f\r]+", " ")
    cut = F.when(F.length(best) > 60, F.concat(F.substring(best, 1, 57), F.lit("..."))).otherwise(best)
    raw = F.when(F.length(col(text)) > 50, F.concat(F.substring(col(text), 1, 50), F.lit("..."))).otherwise(col(text))
    return F.when(F.size(sentences_) > 0, cut).otherwise(raw)


def strip_prefix(c: Column | str, prefixes: list[str] | None = None) -> Column:
    """Without a model's heading at the start, letter case aside."""
    for group in [prefixes] if prefixes else [PREFIXES, PREFIXES_ZH]:
        c = strip(F.regexp_replace(col(c), "(?i)^(" + "|".join(group) + ")", ""))
    return c


def strip_markup(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<[^>]+>", "")


def collapse_blank_lines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\n[ \t\n\f\r]*\n", "\n\n")


def safe_id(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^a-zA-Z0-9_]", "_")


def wrap_first(text: Column, sentence: Column, tag: Column) -> Column:
    """The first occurrence of ``sentence`` put between ``<tag>`` marks; unchanged if it isn't there."""
    at = F.instr(text, sentence)
    wrapped = F.concat(F.substr(text, F.lit(1), at - 1), F.lit("<"), tag, F.lit(">"), sentence, F.lit("</"), tag, F.lit(">"), F.substr(text, at + F.length(sentence)))
    return F.when((at > 0) & (sentence != ""), wrapped).otherwise(text)


def wrap_all(text: Column, tagged: Column) -> Column:
    """``wrap_first`` for each (sentence, tag) struct of an array, from the last to the first."""
    return F.aggregate(F.reverse(tagged), text, lambda acc, t: wrap_first(acc, t["sentence"], t["tag"]))


def remove_tagged(text: Column, tags: Column) -> Column:
    """Without the spans of the given tags; other marks are stripped and blank lines collapsed."""
    kept = F.aggregate(tags, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit("(?s)<"), t, F.lit(">.*?</"), t, F.lit(">")), F.lit("")))
    return strip(collapse_blank_lines(strip_markup(kept)))


def strip_fence(c: Column | str) -> Column:
    """Without a Markdown fence around the text."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*[ \t]*\n?", ""), r"\n?```$", ""))


def attach(fused: Column | str, alignment: Column) -> Column:
    """Legacy text form: fused text, the separator line, the alignment as JSON."""
    return F.concat(F.rtrim(col(fused), F.lit(SPACES)), F.lit(f"\n{ALIGNMENT_MARK}\n"), F.to_json(alignment))


def detach(c: Column | str) -> tuple[Column, Column]:
    """(text before the separator, text between it and a second one or the end); null without a separator."""
    parts = F.split(col(c), ALIGNMENT_MARK)
    return strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))


def hits(c: Column | str, lexicon: list[str]) -> Column:
    """How many terms of a lexicon a text contains."""
    return F.size(F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(col(c), w)))


def holds_any(c: Column | str, lexicon: list[str]) -> Column:
    out = F.lit(False)
    for w in lexicon:
        out = out | F.contains(col(c), F.lit(w))
    return out


_BLANK_LINE = re.compile(r"\n[ \t\f\r]*\n")


def blank_line_segments(c: Column | str) -> Column:
    """Segments between blank lines with character offsets, numbered in the stream of pieces, blank ones counted.

    ``array<struct<segment_id, text, start_char, end_char>>``; the text is stripped, the offsets span the piece. Null
    for null. One pass in Arrow batches, as offsets are running sums.
    """

    @F.pandas_udf("array<struct<segment_id: string, text: string, start_char: int, end_char: int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows, at = [], 0
            for n, m in enumerate([*_BLANK_LINE.finditer(t or ""), None], 1):
                end = m.start() if m else len(t or "")
                piece = (t or "")[at:end].strip(SPACES)
                if piece:
                    rows.append({"segment_id": f"seg_{n:03d}", "text": piece, "start_char": at, "end_char": end})
                at = m.end() if m else end
            out.append(rows if t is not None else None)
        return pd.Series(out)

    return run(col(c))
