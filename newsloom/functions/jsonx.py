"""JSON out of model responses: balanced objects, repair, reasons, arrays after a separator.

Balancing is not regular, so it runs in one Arrow UDF; what regular expressions can do stays in the JVM.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import ALIGNMENT_MARK, col, strip_fence


def balanced(text: str, opening: str = "{") -> str | None:
    """The first balanced object (or list) of a text; strings and escapes don't count towards the balance."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening)
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        ch = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == opening:
            depth += 1
        elif ch == closing:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


_LITERALS = {"true": "True", "false": "False", "null": "None"}
_OUTSIDE = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|,(?=\s*[}\]])|\b(true|false|null)\b""", re.S)


def _loosened(text: str, literals: bool) -> str:
    """Without trailing commas, and with JSON's literals as Python's; one scan that leaves quoted texts as they are."""

    def put(m: re.Match) -> str:
        return m.group(1) or (_LITERALS[m.group(2)] if literals else m.group(2)) if m.group(1) or m.group(2) else ""

    return _OUTSIDE.sub(put, text)


def repair(text: str) -> str | None:
    """Valid JSON from nearly valid: trailing commas dropped, then read as a literal (single quotes); None if neither helps.

    What stands inside quotation marks is never changed.
    """
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        pass
    try:
        return json.dumps(json.loads(_loosened(text, False)), ensure_ascii=False)
    except (ValueError, RecursionError):
        pass
    try:
        return json.dumps(ast.literal_eval(_loosened(text, True)), ensure_ascii=False)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def extract(text: str | None) -> tuple[str | None, str]:
    """(JSON, reason): reason is '' for valid JSON, else ``repaired``, ``unreadable``, ``no_brace_match`` or ``empty``."""
    if text is None or not text.strip():
        return None, "empty"
    found = balanced(text)
    if found is None:
        return None, "no_brace_match"
    fixed = repair(found)
    return (None, "unreadable") if fixed is None else (fixed, "" if fixed == found else "repaired")


def extract_object(c: Column | str) -> Column:
    """``struct<json, reason>`` of the first object of a response, Markdown fences aside."""

    @F.pandas_udf("json string, reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(t) for t in texts], columns=["json", "reason"])

    return run(strip_fence(c))


def greedy_object(c: Column | str) -> Column:
    """From the first to the last brace, with single quotes as double ones if that makes it JSON; null if not."""
    raw = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    double = F.translate(raw, "'", '"')
    return F.when(F.try_parse_json(raw).isNotNull() & (raw != ""), raw).when(F.try_parse_json(double).isNotNull() & (raw != ""), double)


def flat_verdict(c: Column | str) -> Column:
    """``struct<problem_exists, evidence>`` of the first flat object; false and '' where it is missing or unreadable."""
    got = F.from_json(F.regexp_extract(col(c), r"\{[^{}]*\}", 0), "problem_exists boolean, evidence string")
    return F.struct(F.coalesce(got["problem_exists"], F.lit(False)).alias("problem_exists"), F.coalesce(got["evidence"], F.lit("")).alias("evidence"))


def array_after(c: Column | str, schema: str, mark: str = ALIGNMENT_MARK) -> Column:
    """The list after a separator, else in the whole text, as an array; a single object counts as a list of one, errors as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            tail = t.split(mark, 1)[1] if isinstance(t, str) and mark in t else t
            if not isinstance(tail, str):
                out.append(None)
                continue
            lists, objects = balanced(tail, "["), balanced(tail, "{")
            first = lists if lists and (not objects or tail.find("[") < tail.find("{")) else objects
            fixed = repair(first) if first else None
            out.append(None if fixed is None else fixed if fixed.startswith("[") else f"[{fixed}]")
        return pd.Series(out)

    return F.coalesce(F.from_json(run(col(c)), schema), F.from_json(F.lit("[]"), schema))
