"""Sentence boundaries by cascading tables of ordered break and no-break rules.

A line break always ends a sentence. Inside a line, a position after terminal punctuation (and the marks it closes)
is a candidate; in Thai every space is one too. Quotations and brackets that a sentence carries are protected: no
candidate inside them counts, and after their closing mark the rules see how the quotation stands in its sentence --
at its start (``lead``), after a colon (``colon``), elsewhere (``mid``) or as a bracket (``bracket``). Each rule has a
pattern for the text before the position, one for the text after, and a verdict; the first match decides. The tables
of a text's own language come first, then those of the other languages of its script, then the common one, so a
missing or wrong language label changes little. The script is read from the text itself.

Scale: a map over rows, without a shuffle; work is linear in the text but for a binary search among its quotations. A
rule sees ``CONTEXT`` characters to either side, more than any of its patterns can span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.session import small_batches, spread, table

SEPARATOR = "====ALIGNMENT===="
OPENING = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "{": "}", '"': '"', "‹": "›", "‚": "‘’"}
BRACKETS = "(（[【《〈{"
#: Closing marks that belong to the sentence before them even where no opening mark is found.
CLOSERS = "”»」』）】》〉)]}›"
TERMINAL = regex.compile(r"[.!?…‥。！？｡।॥؟۔]+")
LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
LIST_MARK = regex.compile(r"\s*(?:[•◦▪‣·*–—-]|\d{1,3}[.)、]|\p{L}[.)]|\(\p{L}|\d{1,3}\))\s+")

#: Opening marks that a closing mark can close.
_OPENERS = {c: [o for o, closing in OPENING.items() if c in closing] for closing in OPENING.values() for c in closing}
CONTEXT = 48

BREAK, KEEP = True, False
#: (verdict, how a closed quotation stands or None for any, before, after); ``before`` ends at the position.
Rule = tuple[bool, str | None, str, str]

_UPPER = r"[\s ]+[“„«‹\"'(\[¿¡–—•*-]*\s?\p{Lu}"
_OPEN = r"[\s ]+[“„«‹\"(\[¿¡「『（]"
#: A sentence that starts without a space before it.
_JOINED = r"(?:\p{Lu}[\p{L}'’.]|[AIÀÉÓYOВИСКУЯ]\s|[“„«¿¡])"
_DIGIT = r"[\s ]+\d"
_MONTH_DE = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

COMMON_FIRST: list[Rule] = [
    (BREAK, None, r"", r"[\s ]*$"),
    (KEEP, None, r"^\s*(?:\d{1,3}|\p{L})\.$", r"\s"),
    (KEEP, None, r"", r"[,;:，；：、,)\]»”’]"),
    (BREAK, "colon", r"", r""),
    (KEEP, "lead", r"", r""),
    (KEEP, "bracket", r"[^.!?…。！？।]$", r""),
]
TABLES: dict[str, list[Rule]] = {
    "en": [
        (KEEP, None, r"(?:^|[\s (“\"«])(?:Mr|Mrs|Ms|Dr|Prof|Gen|Col|Capt|Lt|Sgt|Rev|Hon|St|Mt|Messrs|Gov|Sen|Rep)\.$", r""),
        (KEEP, None, r"\b(?:[Nn]os?|[Ff]igs?|pp?|[Vv]ol|[Cc]h|[Ss]ec|[Ee]d|vs|approx|ca|cf|i\.e|e\.g|al)\.$", r""),
        (KEEP, None, r"\b(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.$", _DIGIT),
        (BREAK, None, r"\d\s?[ap]\.\s?m\.$", _UPPER),
        (BREAK, None, r"\d\s?[ap]\.\s?m\.$", _JOINED),
    ],
    "de": [
        (KEEP, None, rf"(?<![\d:.,])\d{{1,2}}\.$", rf"\s+(?:{_MONTH_DE})\b"),
        (KEEP, None, r"\b(?:Dr|Prof|Hr|Frl|Nr|Nrn|Str|St|ca|bzw|vgl|Abs|Art|Bd|Mio|Mrd|evtl|ggf|inkl|sog|Dipl|Ing)\.$", r""),
        (KEEP, None, r"\b(?:z|d|u|i|o|s)\.$", r"\s?\p{L}{1,2}\."),
        (KEEP, None, r"\b(?:z\.\s?B|d\.\s?h|u\.\s?a|i\.\s?d\.\s?R|o\.\s?ä)\.$", r""),
    ],
    "fr": [
        (KEEP, None, r"\b(?:MM?|Mme|Mmes|Mlle|Dr|Pr|Me|Mgr|St|Ste)\.$", r""),
        (KEEP, None, r"\b(?:art|env|cf|p|pp|vol|chap|fig|n[o°]|av|bd|éd|tél)\.$", r""),
        (KEEP, None, r"\d\s?h\.$", _DIGIT),
    ],
    "es": [
        (KEEP, None, r"\b(?:Sr|Sra|Sres|Srta|Dr|Dra|Ing|Lic|Arq|Prof|Profa|Gral|Cap|Ud|Uds|D|Dña|Sto|Sta)\.$", r""),
        (KEEP, None, r"\b(?:págs?|art|aprox|núm|cap|fig|vol|avda|tel|ej)\.$", r""),
        (BREAK, None, r"\d\s?[ap]\.\s?m\.$", _UPPER),
        (KEEP, None, r"\b[ap]\.$", r"\s?m\."),
    ],
    "ru": [
        (KEEP, None, r"\b(?:ул|пр|просп|пер|пл|наб|ш|д|корп|кв|стр|рис|им|проф|акад|ред|см|ср|ок|тел|гр|обл|р-н|г-н|г-жа)\.$", r""),
        (BREAK, None, r"\d\s?г(?:г)?\.$", _UPPER),
        (KEEP, None, r"\bг\.$", r""),
        (KEEP, None, r"\bт\.$", r"\s?[едпкн]\b"),
        (KEEP, None, r"\b(?:т\.\s?е|т\.\s?д|т\.\s?п|т\.\s?к|и\.\s?о)\.$", r"\s+[\p{Ll}\d]"),
    ],
    "hi": [
        (KEEP, None, r"(?:डॉ|मी|श्री|सु|प्रो|कि|रु|नं|पं|सं|ई|पू)\.$", r""),
        (KEEP, None, r"(?<![.])\.$", r"\s*[ऀ-ॿ]"),
    ],
    "ar": [
        (KEEP, None, r"(?:^|[\s («])(?:\p{Arabic}|أ\.د|ص\.ب|ق\.م|د\.م)\.$", r""),
        (BREAK, None, r"[.!؟۔…]$", r"[\s ]+\S"),
        (BREAK, None, r"[؟!]$", r""),
    ],
    "cjk": [
        (KEEP, "mid", r"", r"\s*[\p{Han}\p{Hiragana}\p{Katakana}]"),
        (KEEP, "bracket", r"", r""),
        (BREAK, None, r"[。！？｡]$", r""),
        (BREAK, None, r"[。！？｡][”」』）】》〉\"]+$", r""),
        (BREAK, None, r"[!?][”」』）】》〉\"]*$", r""),
        (KEEP, None, r"[…‥]$", r""),
    ],
    "th": [
        (BREAK, None, r"[!?]$", r""),
    ],
    "devanagari": [
        (BREAK, None, r"[।॥][”\"»)]*$", r""),
        (BREAK, None, r"[!?][”\"»)]*$", r"\s"),
    ],
}
COMMON_LAST: list[Rule] = [
    (BREAK, None, r"[。！？।॥؟۔]$", r""),
    (KEEP, None, r"(?:^|[\s (“„«\"-])\p{Lu}\.$", r""),
    (BREAK, None, r"\d\s\p{Ll}{1,2}\.$", _UPPER),
    (KEEP, None, r"(?:^|[\s (])\p{Ll}\.$", r""),
    (BREAK, None, r"[.!?…]$", _UPPER),
    (BREAK, None, r"[.!?…]$", _OPEN),
    (BREAK, "mid", r"", _UPPER),
    (BREAK, None, r"[.!?…][”»“\"’)\]]+$", _UPPER),
    (BREAK, None, r"[!?]$", r"[\s ]+[^\p{Ll}]"),
    (BREAK, None, r"(?:\p{Ll}|\d|[)”»])\.$", r"[\s ]+[\d\p{Lo}•*–—-]"),
    (BREAK, None, r"(?:\p{L}{2}|\d{2}|[)”»])\.$", _JOINED),
    (BREAK, None, r"\p{L}[!?]+$", _JOINED),
]

#: Languages of each script in the order their tables follow.
SCRIPTS = {"latin": ["en", "de", "fr", "es"], "cyrillic": ["ru"], "arabic": ["ar"], "devanagari": ["devanagari", "hi"], "cjk": ["cjk"], "thai": ["th"]}
_LETTERS = {
    "latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "arabic": regex.compile(r"\p{Arabic}"),
    "devanagari": regex.compile(r"\p{Devanagari}"), "cjk": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"), "thai": regex.compile(r"\p{Thai}"),
}
_compiled: dict[tuple[str, str | None], list] = {}


def script_of(text: str) -> str:
    """The script most letters are in; Latin if there are none."""
    sample = text
    counts = {s: len(p.findall(sample)) for s, p in _LETTERS.items()}
    counts["cjk"] *= 2  # a character of these scripts stands for more than a letter
    return max(counts, key=lambda s: counts[s])


def cascade(script: str, lang: str | None) -> list:
    """Compiled rules of a script, the language's own table first."""
    key = (script, lang if lang in SCRIPTS[script] else None)
    if key not in _compiled:
        langs = sorted(SCRIPTS[script], key=lambda x: x != key[1])
        rules = [*COMMON_FIRST, *(r for x in langs for r in TABLES[x]), *COMMON_LAST]
        _compiled[key] = [(verdict, how, regex.compile(before) if before else None, regex.compile(after) if after else None) for verdict, how, before, after in rules]
    return _compiled[key]


def protected(line: str) -> list[tuple[int, int]]:
    """Outermost (open, close) positions of balanced quotations and brackets of a line, ascending."""
    spans, stack = [], []
    held: Counter = Counter()  # the opening marks in the stack
    for i, ch in enumerate(line):
        if stack and ch in OPENING[line[stack[-1]]]:
            held[line[stack[-1]]] -= 1
            spans.append((stack.pop(), i))
        elif ch in OPENING:
            if ch == "»" and not (i + 1 < len(line) and not line[i + 1].isspace() and (i == 0 or line[i - 1].isspace())):
                continue
            stack.append(i)
            held[ch] += 1
        elif ch in CLOSERS and any(held[o] for o in _OPENERS.get(ch, ())):  # its opening mark lies further down: those above it stay open
            while ch not in OPENING[line[stack[-1]]]:
                held[line[stack.pop()]] -= 1
            held[line[stack[-1]]] -= 1
            spans.append((stack.pop(), i))
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


class Spans:
    """The protected spans of a line, which don't overlap, by position."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans, self.starts, self.opens = spans, [a for a, _ in spans], {a for a, _ in spans}

    def around(self, at: int) -> tuple[int, int] | None:
        """The span that starts before ``at`` and ends at it or later."""
        i = bisect_left(self.starts, at) - 1
        return self.spans[i] if i >= 0 and at <= self.spans[i][1] else None


def _closed(line: str, start: int, end: int, spans: Spans) -> tuple[int, tuple[int, int] | None, bool]:
    """(position after the marks that terminal punctuation at start..end closes, the quotation closed, inside one)."""
    span = spans.around(start)
    if span is None:
        while end < len(line) and line[end] in CLOSERS and end not in spans.opens:
            end += 1
        return end, None, False
    j = end
    while j < span[1] and (line[j].isspace() or line[j] in CLOSERS or line[j] in "“”’\"'"):
        j += 1
    if j != span[1]:
        return end, None, True
    j += 1
    while j < len(line) and line[j] in CLOSERS and j not in spans.opens:
        j += 1
    return j, span, False


def _standing(line: str, begin: int, span: tuple[int, int]) -> str:
    """How a quotation stands in the sentence that starts at ``begin``; the sentence itself isn't copied."""
    if line[span[0]] in BRACKETS:
        return "bracket"
    last = span[0] - 1
    while last >= begin and line[last].isspace():
        last -= 1
    if last < begin:
        return "lead"
    while line[begin].isspace():
        begin += 1
    if last - begin < 8:
        before = line[begin : span[0]]
        mark = LIST_MARK.match(before + " ")
        if (mark and mark.end() >= len(before.rstrip()) + 1) or before.strip() in "-–—•*":
            return "lead"
    return "colon" if line[last] in ":：" else "mid"


def split_line(line: str, script: str, lang: str | None) -> list[int]:
    """Positions inside a line after which a new sentence starts."""
    rules, spans = cascade(script, lang), Spans(protected(line))
    mark = LIST_MARK.match(line)
    candidates = [(m.start(), m.end(), False) for m in TERMINAL.finditer(line)]
    if script == "thai":
        first = mark.end() if mark else 0
        spaces = [(m.start(), m.end(), True) for m in re.finditer(r"[\s ]+", line) if m.start() >= first]
        candidates = sorted(candidates + spaces)
    cuts: list[int] = []
    begin = 0
    for start, end, space in candidates:
        if space:
            around = spans.around(start)
            if (around is None or start == around[1]) and start > begin:
                cuts.append(end)
                begin = end
            continue
        pos, span, inside = _closed(line, start, end, spans)
        if inside or pos <= begin:
            continue
        how = _standing(line, begin, span) if span else None
        low = max(0, pos - CONTEXT)
        before, after = line[low:pos], line[pos : pos + CONTEXT]
        for verdict, want, b, a in rules:
            if want is not None and want != how:
                continue
            if b is not None and (not (b.search(before)) or (low and b.pattern.startswith("^\\s*"))):
                continue
            if a is not None and not a.match(after):
                continue
            if verdict and after.strip():
                cuts.append(pos)
                begin = pos
            break
    return cuts


def split(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without the white space around it.

    Null, empty and blank texts have none; a text without terminal punctuation is one sentence of each line.
    """
    if not text or not text.strip():
        return []
    script = script_of(text)
    lang = lang.strip().lower()[:2] if isinstance(lang, str) else None
    out = []
    at = 0
    for m in [*LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        line = text[at:end]
        if line.strip():
            edges = [0, *split_line(line, script, lang), len(line)]
            for a, b in zip(edges, edges[1:]):
                piece = line[a:b]
                if piece.strip():
                    lead = len(piece) - len(piece.lstrip())
                    out.append((at + a + lead, at + a + lead + len(piece.strip())))
        at = m.end() if m else end
    return out


def body(text: str | None) -> str | None:
    """A fused text up to the line that separates the alignment."""
    if text is None:
        return None
    m = re.search(rf"(?:^|(?<=[\r\n]))[ \t]*{re.escape(SEPARATOR)}", text)
    return text[: m.start()] if m else text


SENTENCE_SCHEMA = "aligned_id bigint, row_no int, sent_no int, sent_start int, sent_end int"


def sentences(aligned: DataFrame) -> DataFrame:
    """Sentences of ``aligned(aligned_id, lang, fused_content, alignment)``: row 0 is the fused text, row k the k-th alignment row.

    Null texts, rows and elements give none; a null element keeps its number.
    """
    small_batches(aligned.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, lang, fused, texts in zip(pdf.aligned_id, pdf.lang, pdf.fused_content, pdf.texts):
                for no, text in enumerate([body(fused), *(texts if texts is not None else ())]):
                    rows.extend((key, no, i, a, b) for i, (a, b) in enumerate(split(text, lang), 1))
            yield pd.DataFrame(rows, columns=["aligned_id", "row_no", "sent_no", "sent_start", "sent_end"]).astype({"aligned_id": "Int64"})

    texts = F.transform("alignment", lambda x: x["text"]).alias("texts")
    return spread(aligned.select("aligned_id", "lang", "fused_content", texts)).mapInPandas(run, SENTENCE_SCHEMA)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "aligned_news"))


def p3_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, sentences and mean sentence length by language label."""
    aligned = table(spark, sf_dir, "aligned_news")
    by = p3_found(spark, sf_dir).groupBy("aligned_id").agg(F.count("*").alias("n"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("chars"))
    return aligned.select("aligned_id", "lang").join(by, "aligned_id").groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_sentences"), (F.sum("chars") / F.sum("n")).alias("mean_chars"))


QUERIES = {"p3_found": p3_found, "p3_by_language": p3_by_language}
