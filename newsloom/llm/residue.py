"""Template residue, filler and error pages by delimiter grammars and notice patterns, discounted by context and density.

Four families: unfilled placeholders (one grammar for each kind of delimiter, names only inside), values that failed to
fill in, filler text, and error messages or notices about scripts and access. What surrounds a match decides whether it
counts, in every family:

- code (fenced, back-ticked, ``pre`` and ``code`` elements, indented blocks) is blanked out before placeholders and
  failed values are looked for, and code and quotations before filler and notices are, since reporting quotes such texts;
- in a text that explains code (``CODE_DENSITY`` code bits for each thousand characters, more than ``CODE_BITS`` of
  them) no match counts that stands in a paragraph with a code bit;
- what may be prose elsewhere must stand alone: an error title before a line end, a mark or another title.

Filler in no listed phrase shows by signals that no language has a word for: the same few words three times in a
row, keys in the order of a keyboard, and Latin script that runs on without a function word while its words recur.

Scale: a map over rows without a shuffle, one scan. Patterns are searched only in texts that hold a literal which the
pattern requires. These literals are derived from the pattern's syntax tree (``required``), so the filter can't drop a
match; one automaton finds those of all rules in one pass over the text.
"""

from __future__ import annotations

import functools
import http
import itertools
import operator
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.session import small_batches, spread, table

FAMILIES = ("placeholder", "failed_value", "filler", "notice")
#: Code bits for each thousand characters from which a text counts as one about code, if there are more than CODE_BITS.
CODE_DENSITY, CODE_BITS = 8.0, 3
#: Words in a row without a function word, and the largest share of different ones among them, of running filler.
FILLER_RUN, FILLER_VARIETY = 10, 0.85

#: Names inside delimiters: letters of any script, digits, spaces, dots and underscores.
_NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_ .|:-]*"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"  # a word's edge among ASCII characters only

#: Unmistakable delimiters.
STRICT = [
    rf"\{{\{{-?\s*#?(?:{_NAME})?\s*-?\}}\}}",
    r"\$\{[^{}\n$]+\}",
    rf"#\{{{_NAME}\}}",
    r"<%[-=#]?[^%\n]+%>",
    r"\{%[-]?\s*[^%{}\n]+%\}",
    r"%\([\p{L}_][\p{L}\p{N}_ ]*\)[sdfr]",
    rf"@@{_NAME}@@",
    rf"\[\[{_NAME}\]\]",
    rf"<<{_NAME}>>",
    r"(?<![A-Za-z\d_])__\p{L}[\p{L}\p{N}]*(?:_[\p{L}\p{N}]+)*__(?![A-Za-z\d_])",
    r"(?<![A-Za-z\d%])%[A-Z][A-Z0-9_]{2,}%(?![A-Za-z\d%])",
    r"(?<![A-Za-z])XX+[ _][\p{Lu}0-9][\p{Lu}0-9 _]*[ _]XX+(?![A-Za-z])",
    r"(?i)\[\s*(?:insert|enter|add|your)\s[^\[\]\n]+\]",
    r"(?i)\[[\p{L}0-9 _]{2,}\s(?:here|goes here|tbd|tbc|to come)\s*\]",
    r"\[(?:请|請)?(?:输入|輸入|填写|填寫|插入|此处|此處)[^\[\]\n]+\]",
    r"[（(\[<【{][^（()）\[\]<>【】{}\n]+(?:待补|待補|待填|待填写|占位|佔位|未填|未入力)[）)\]>】}]",
    r"(?i)\[(?:à compléter|zu ergänzen|por completar|einfügen|insérer|insertar)[^\[\]\n]*\]",
]
#: Elements and marks that prose and tokenizers put between angle brackets. Fixed values.
_TAGS = (
    "unk|s|pad|mask|bos|eos|cls|sep|br|hr|p|b|i|u|em|strong|a|div|span|li|ul|ol|img|td|tr|th|table|tbody|thead|h[1-6]|html|body|head|title|script|style|code|pre|sub|sup|small|big|font|center|figure|figcaption|"
    "section|article|nav|header|footer|blockquote|cite|q|input|form|button|label|iframe|video|audio|source|link|meta|svg|path|user|assistant|system|tool|bot|human|start|end|endoftext|startoftext|think"
)
#: What a field of a news template may be called, between square brackets.
_FIELDS = "headline|byline|caption|city|place|location|address|date|time|topic|lead|figure|author|source|name|title|quote|version|text|body|summary|url|link|image|photo|amount|price|number|phone|email|company|editor|reporter"
#: Single delimiters, which prose, markup and code use too.
LOOSE = [
    r"(?<![$#%{\\A-Za-z])\{[\p{L}_][\p{L}\p{M}\p{N}_]{2,}\}(?!\})",
    rf"(?<!<)<(?!/?(?:{_TAGS})>)\p{{L}}[\p{{L}}\p{{N}}]*(?:_[\p{{L}}\p{{N}}]+)*>(?!>)",
    r"<(?:figure|caption|source|title|header|section|article|label|link)_?[\p{L}\p{N}_]*>(?=[^<]*$|[^<]*<(?!/))",
    r"\[(?!(?:MASK|UNK|PAD|CLS|SEP|BOS|EOS|INST|SIC|NOTE|ED|UPDATE|VIDEO|PHOTO|AUDIO|APPLAUSE|LAUGHTER)\])[A-Z][A-Z]*(?:[_ ][A-Z0-9]+)*\](?<=[A-Z0-9_]{3}\])",
    rf"\[(?:[a-z]+[_ ])?(?:{_FIELDS})(?:[_ ]\d+)?\]",
    r"\[(?:num|number of|no of|count of|list of)[_ ][a-z]+\]",
    r"(?<![A-Za-z\d%.,])%(?:\d\$)?[sd](?![A-Za-z\d%])",
]
#: Values that failed to fill in.
FAILED = [
    r"\[object Object\]",
    r"#(?:REF|VALUE|NAME|NUM|NULL|DIV/0)[!?]|#N/A",
    r"(?<![A-Za-z\d_.'\"(=])NaN(?![A-Za-z\d_(=])",
    r"(?<![A-Za-z\d_'\"(=.-])undefined(?![A-Za-z\d_'\"(=-])",
    rf"{_B}null null{_B}|\((?:null|nil|None|undefined)\)|{_B}Invalid [Dd]ate{_B}",
    rf"(?m)(?:^|[:：]\s*|{_B}(?:[Bb]y|[Uu]pdated|[Pp]ublished|[Pp]hoto)\s+)(?:null|None|nil|NULL)(?=\s*$)",
    rf"(?<=[\p{{L}}\p{{N}},]\s)None(?![A-Za-z0-9_])(?! of(?![A-Za-z0-9_]))|(?<=[{_CJK}\p{{Thai}}\p{{Devanagari}}\p{{Arabic}}。！？”」])None(?![A-Za-z])|(?<![A-Za-z])None(?=[{_CJK}\p{{Thai}}])",
    rf"(?<![A-Za-z\d_'\"(=.:-])(?<!:\s)(?<!(?<![A-Za-z])(?:auf|bei|gegen|unter|über|um|von|zu|mit|Uhr|gleich)\s)null(?=\s+\p{{Ll}}|[,.;]?\s*$|\s+\p{{Lu}}|[{_CJK}\p{{Thai}}])(?!\s+(?:Uhr|Grad|Komma|und|and void|hypothesis|Prozent|zu|Meter|result))",
]

#: The classic dummy text. Fixed value.
_LOREM = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|adipisicing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|"
    "consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum"
)
#: Those of its words that no other language here has; a run must hold one.
_LOREM_OWN = "lorem|ipsum|dolor|amet|consectetur|adipiscing|adipisicing|elit|eiusmod|tempor|incididunt|labore|dolore|aliqua|enim|minim|veniam|nostrud|exercitation|ullamco|laboris|aliquip|reprehenderit|cillum|fugiat|pariatur|excepteur|occaecat|cupidatat|proident|deserunt|mollit|laborum"
FILLER = [
    rf"(?<![A-Za-z])(?:{_LOREM_OWN})(?:[ ,.\n]++(?:{_LOREM})(?![A-Za-z])){{3}}",
    r"lorem ipsum dolor",
    rf"(?:{_B}(?:TK|blah|foo bar){_B}\s+){{2,}}(?:TK|blah|foo bar){_B}",
    r"(?:placeholder|dummy|filler|sample) (?:sentence|paragraph|text|copy) (?:number )?\d+|this is (?:dummy|placeholder|sample|filler) (?:copy|text|content)" + _B,
    r"(?:sample|placeholder|dummy|filler) (?:paragraph|text|copy|content)[,;:]? (?:please )?(?:replace|delete|remove|to be replaced)",
    rf"(?m)(?:^|(?<=[.!?。\n])\s*|(?<=[.!?。\n]))(?:your |the )?(?:text|story|copy|content|headline|body|article) (?:goes|starts|comes|begins) (?:in this box|here){_B}",
    r"texte (?:provisoire|factice|de remplissage)[^.\n]{0,20}remplacer|texto de (?:prueba|relleno|muestra)[^.\n]{0,16}(?:sustituir|reemplazar|cambiar)",
    r"hier steht (?:später|bald|dann) (?:der|ihr|ein) (?:artikel|text)|(?:blindtext|platzhaltertext|mustertext)[^.\n]{0,20}(?:ersetzen|austauschen)",
    r"(?:ici|votre) (?:viendra |sera )?(?:le |votre )?texte (?:ici|à venir)|aquí (?:va|irá) el texto",
    r"占位文[本字][，,]?请?替换|正文(?:内容)?待(?:填写|补充?)|请在(?:这里|此处)(?:输入|填写)|(?:测试){3,}|此处为(?:示例|占位)(?:文[字本]|内容)|ここに(?:本文|テキスト|文章)|ダミー(?:テキスト|文章)|(?:これは)?サンプル(?:テキスト|文章)",
    r"текст[- ](?:заглушка|рыба)|здесь (?:будет|появится) текст|это (?:пробный|тестовый) текст|هذا نص (?:تجريبي|مؤقت|بديل)|यह (?:नमूना|डमी) (?:पाठ|टेक्स्ट)|ข้อความตัวอย่าง",
]

_ALONE = rf"(?=\s*(?:$|nginx|Code:|[-–—|.:;!/,\n。！)\]）】*_]|\p{{Lu}}|\d|[“\"'<(\[#]|[{_CJK}]))"
#: Codes of HTTP errors with the phrases of the standard.
_STATUS = {s.value: s.phrase for s in http.HTTPStatus if s.value >= 400}
_CODES = "|".join(map(str, sorted(_STATUS)))
_PHRASES = "|".join(sorted({p.replace("-", "[- ]?").replace("Timeout", "Time-?out") for p in [*_STATUS.values(), "Gateway Time-out", "Request Timeout"]}, key=len, reverse=True))
#: Error titles and notices; those that prose uses as well must stand alone.
NOTICE = [
    rf"{_B}(?:HTTP|Error|Erreur|Fehler|Ошибка)?\s?(?:{_CODES})\s?[:–/-]?\s*(?i:{_PHRASES}){_B}",
    rf"(?m)(?:^|(?<=[.!?。:：\]»”|\n-])\s*|(?<=[.!?。:：\]»”|\n-])|(?<=[\p{{Han}}\d])\s*)(?:(?:Error|Erreur|Fehler|Oops!?)\s+)?(?<![\d$€£])(?<!\d[.,])(?:{_CODES})(?=\s*(?:$|nginx|[-–—|.:\n*_)\]]|Code:|Ray |Request|Reference|Try again|Go back|Return to))(?!\.\d)",
    rf"(?m){_B}Error (?:{_CODES}){_B}(?=\s*(?:$|nginx|[-–—|.:\n*_)\]]|\p{{Lu}}))",
    rf"(?:Error|Erreur|Fehler|HTTP) ?(?:{_CODES}) ?[:–-] ?\p{{L}}|(?:{_CODES}) (?:页面|页面不存在|お探し|ページ|服务|网关|禁止)",
    rf"(?m){_B}(?:Internal Server Error|Bad Gateway|Service Unavailable|Too Many Requests|Gateway Time-?out){_B}{_ALONE}",
    rf"(?m){_B}(?:Access denied|Access Denied|Accès refusé|Acceso denegado|Zugriff verweigert|Page not found|Page introuvable|Página no encontrada|Seite nicht gefunden|Servicio no disponible){_ALONE}|(?:Доступ запрещ[её]н|Страница не найдена){_ALONE}",
    rf"(?i){_B}(?:we (?:can['’]t|cannot|couldn['’]t) find (?:that|this|the) page|the (?:page|article|story|content) you (?:asked|are looking|were looking|requested)(?: for)? (?:has been|could not|cannot|was|does|is no)|(?:this|the requested) page (?:does not|doesn['’]t|could not) )",
    rf"(?i){_B}the server is temporarily unable{_B}|{_B}your session has (?:expired|timed out){_B}|{_B}you (?:don['’]t|do not) have permission to (?:view|access|read|see){_B}|{_B}unusual traffic from your{_B}|{_B}(?:confirm|verify|prove) (?:that )?you are (?:not a robot|human|a human){_B}",
    rf"(?i){_B}this (?:content|page|video|article) is (?:not|currently not|un)\s?available in your (?:area|region|country){_B}|{_B}subscribe (?:now )?to (?:continue|keep) reading{_B}|{_B}log ?in to (?:continue|read|view){_B}|{_B}checking your browser before{_B}",
    rf"(?i){_B}(?:enable|activate|allow|turn on|switch on)\s(?:[\p{{L}} ]{{0,16}}{_B})?(?:javascript|scripts?|cookies){_B}[^.\n。]{{0,60}}?{_B}(?:to (?:continue|view|read|see|use|proceed|load|display)|in your browser|for this (?:site|page)|and (?:reload|refresh|try))",
    rf"(?i){_B}please (?:enable|activate|turn on|allow) (?:javascript|scripts|cookies){_B}|{_B}(?:this|our|the) (?:site|page|website|app|application) (?:requires|needs|works best with) (?:javascript|scripts|cookies)|{_B}scripts? (?:are|is) (?:blocked|disabled|turned off){_B}",
    rf"(?i){_B}javascript is (?:disabled|required|turned off|not enabled|off){_B}|{_B}your browser (?:does not|doesn['’]t) support{_B}",
    r"(?i)(?:veuillez|merci de|vous devez) (?:activer|autoriser) (?:javascript|les scripts|les cookies)|activez javascript|javascript est désactivé|les scripts sont (?:bloqués|désactivés)|bitte aktivieren sie (?:javascript|cookies)|aktivieren sie (?:bitte )?javascript|ohne (?:skripte|javascript) kann|javascript ist (?:deaktiviert|ausgeschaltet|erforderlich)",
    r"(?i)(?:active|habilite|activa|habilita) javascript|javascript está (?:desactivado|deshabilitado)|(?:su|tu) navegador (?:no|tiene) |включите javascript|javascript отключ[её]н|для просмотра[^.\n]{0,30}(?:javascript|скрипты)|скрипты (?:отключены|заблокированы)",
    r"(?i)يرجى تفعيل|الرجاء تفعيل|تم تعطيل جافا|कृपया (?:जावास्क्रिप्ट|javascript)|जावास्क्रिप्ट (?:सक्षम|चालू)|เปิดใช้(?:งาน)? ?javascript|กรุณาเปิด",
    r"(?i)请(?:启用|开启|打开|允许) ?(?:javascript|脚本|cookie)|(?:禁用|未启用|关闭)了? ?(?:脚本|javascript)[^”]|javascript ?を(?:有効|オン)|スクリプト(?:が(?:無効|ブロック)|を(?:有効|許可))|訪問的頁面|您访问的页面|页面(?:不存在|未找到|找不到)|お探しのページ|ページが(?:見つかりません|存在しません)|服务器内部错误|内部服务器错误|网关超时|服务(?:暂时)?不可用",
    r"(?:您|你)没有权限|没有权限(?:查看|访问)|访问(?:过于频繁|被拒绝|受限)|请输入验证码|サーバー(?:が混み合|エラー|に接続)|アクセス(?:が拒否|できません|が集中)|しばらくしてから(?:お試し|再度)",
    r"(?i)erreur 40\d ?:|cette page n['’]existe (?:plus|pas)|service (?:temporairement )?indisponible|der (?:dienst|server) ist (?:derzeit|zurzeit|momentan) nicht|(?:diese|die) seite (?:existiert nicht|gibt es nicht|wurde nicht gefunden|konnte nicht)|esta página (?:no existe|ya no)|servicio no disponible",
    r"(?i)сервер временно|страница не (?:найдена|существует)|الصفحة (?:غير موجودة|التي تبحث)|पृष्ठ नहीं मिला|ไม่พบหน้า",
    r"Traceback \(most recent call last\)|(?m:^)\s*File \"[^\"\n]+\", line \d+|^\s*(?:Key|Type|Value|Attribute|Index|Name|Runtime|Zero\w+)Error: |Exception in thread \"",
    r"(?m)^[ \t]+at [\w.$<>]+\([\w.$]+\.(?:java|kt|scala|py|js|ts|go|rb|cs):\d+",
    r"\{\"error\": ?\{|\{\"(?:error|message|status)\": ?(?:\"|\d{3}(?!\d))[^{}\n]{0,120}(?:error|denied|forbidden|not found|unavailable)|(?i:fatal error: uncaught|warning: (?:undefined|include)(?![a-z])|stack trace:)",
    rf"(?i)loading(?:…|\.\.\.) ?(?:please wait|if (?:nothing|the page))|if (?:the|this) (?:problem|issue|error) (?:persists|continues|remains|goes on), |{_B}request id: ?[0-9a-f-]{{6,}}|{_B}reference #[0-9a-f]{{6,}}|{_B}ray (?:id:? )?[0-9a-f]{{8,}}",
]

#: Function words of the languages here in Latin script; ordinary prose seldom does a dozen words without one. Fixed values.
FUNCTION_WORDS = frozenset(
    "the a an of to in on and or is are was were be been it its that this these those for with as at by from has have had not but he she they we you his her their our who which what when where there into than if so no all will would can could about after before over under more most other some any only out up then now may "
    "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren wird werden wurde wurden hat haben hatte nicht auch als am auf aus bei bis durch für gegen im mit nach seit über um unter von vor zu zum zur zwischen sie er es wir ihr sich dass wenn wie noch nur schon aber "
    "le la les un une du de et ou est sont était étaient ont avait pas ne que qui dans sur par pour avec sans sous au aux ce cette ces son sa ses leur leurs il elle ils elles nous vous se plus comme mais où dont entre après avant depuis vers chez "
    "el los las uno una unos unas del al y o es son era eran fue fueron ha han había en con sin sobre su sus lo este esta estos estas como más pero desde hasta cuando donde ya muy también".split()
)
_LATIN = regex.compile(r"\p{Latin}+$")
_MARKS = ".,!?;()\"'“”‘’"
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_KEY_ROWS = tuple(row[i : i + 3] for row in _KEYS for i in range(len(row) - 2))

_CODE = regex.compile(r"(?s)```.*?(?:```|$)|`[^`\n]+`|<(pre|code)\b[^>]*>.*?</\1>")
#: Indented blocks after a blank line whose lines look like code.
_INDENTED = regex.compile(r"(?m)(?<=\n[ \t]*\n)(?:(?: {4}|\t)(?!\s*at )[^\n]*[=(){};\[\]][^\n]*(?:\n|$))+")
_QUOTED = regex.compile(r"“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|「[^」\n]+」|『[^』\n]+』|(?<![\p{L}\p{N}{:,\[\"])\"(?!error)[^\"\n{}:]+\"(?![\p{L}\p{N}:,}\]])")
_ALIKE = (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("\u212a", "k"))


@dataclass(frozen=True)
class Rule:
    family: str
    pattern: str
    literals: frozenset[str]
    search: object


def fold(text: str) -> str:
    """Lower case in which every literal of a matching pattern stands as it is derived."""
    if not text.isascii():
        for x, y in _ALIKE:
            if x in text:
                text = text.replace(x, y)
    return text.lower()


def _exact(items) -> set[str] | None:
    """All strings a part of a pattern can match, in lower case, if they are few."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            one = {fold(chr(arg))}
        elif op is sre.IN:
            if any(o is not sre.LITERAL for o, _ in arg):
                return None
            one = {fold(chr(a)) for _, a in arg}
        elif op is sre.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            if any(p is None for p in parts):
                return None
            one = set().union(*parts)
        elif op is sre.SUBPATTERN:
            one = _exact(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and (arg[0], arg[1]) == (0, 1):
            one = _exact(arg[2])
            one = None if one is None else one | {""}
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            one = {""}
        else:
            return None
        if one is None or len(out) * len(one) > 64:
            return None
        out = {a + b for a in out for b in one}
    return out


def _needed(items) -> frozenset[str] | None:
    """Literals of which every match of a part holds one; the choice with the longest and fewest ones. None if there are none."""
    found: list[frozenset[str]] = []
    run = {""}

    def close() -> None:
        if "" not in run:
            found.append(frozenset(run))

    for item in items:
        op, arg = item
        one = _exact([item])
        if one is not None and len(run) * len(one) <= 64:
            run = {a + b for a in run for b in one}
            continue
        close()
        run = {""}
        if one is not None:
            run = set(one)
        elif op is sre.SUBPATTERN:
            got = _needed(arg[3])
            found += [got] if got else []
        elif op is sre.BRANCH:
            parts = [_needed(x) for x in arg[1]]
            found += [frozenset().union(*parts)] if all(parts) else []
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            got = _needed(arg[2])
            found += [got] if got else []
    close()
    return max(found, key=lambda s: (min(min(map(len, s)), 4), -len(s)), default=None)


def required(pattern: str) -> frozenset[str] | None:
    """Literals in lower case of which every text that matches ``pattern`` holds one; None if the pattern requires none.

    Classes of characters count as unknown, so the result can only be too weak, never too strong.
    """
    return _needed(sre_parser.parse(regex.sub(r"\\[pP]\{[^}]*\}", r"\\w", pattern)))


@functools.lru_cache(maxsize=1)
def rules() -> list[Rule]:
    out = []
    for family, patterns, flags in (("placeholder", STRICT, ""), ("loose", LOOSE, ""), ("failed_value", FAILED, ""), ("filler", FILLER, "(?i)"), ("notice", NOTICE, "")):
        for p in patterns:
            p = flags + p
            literals = required(p)
            if not literals:
                raise ValueError(f"no literal is required by {p}")
            out.append(Rule(family, p, literals, regex.compile(p)))
    return out


@functools.lru_cache(maxsize=1)
def automaton():
    """Finds which rules' literals a text holds; values are the numbers of the rules."""
    import ahocorasick

    by: dict[str, list[int]] = {}
    for n, r in enumerate(rules()):
        for x in r.literals:
            by.setdefault(x, []).append(n)
    out = ahocorasick.Automaton()
    for x, numbers in by.items():
        out.add_word(x, tuple(numbers))
    out.make_automaton()
    return out


def keyboard(word: str) -> bool:
    """Whether a word runs along a row of the keyboard."""
    return len(word) > 2 and any(word in row for row in _KEYS)


def recurring(text: str) -> bool:
    """Whether two or three words stand three times in a row, or a word four times without commas."""
    low = text.lower().replace(".", "").replace("!", "")
    apart, joined = low.split(), low.replace(",", "").split()
    for k, words in ((1, apart), (2, joined), (3, joined)):
        run = b"\1" * max(2 * k, 3)
        same = bytes(map(operator.eq, words, words[k:]))
        at = same.find(run)
        while at >= 0:
            unit = words[at : at + k]
            if all(w.isalpha() for w in unit) and (len(set(unit)) > 1 or (k == 1 and len(unit[0]) > 1)):
                return True
            at = same.find(run, at + 1)
    return False


def _plain(words: list[str], i: int) -> bool:
    """Whether a word is Latin script, no function word, and no name (a capital inside a sentence)."""
    word = words[i].strip(_MARKS)
    if not word or word.lower() in FUNCTION_WORDS or not word.isalpha() or not (word.isascii() or _LATIN.match(word)):
        return False
    return not (word[0].isupper() and i and words[i - 1][-1:] not in (".", "!", "?"))


def running_filler(text: str) -> bool:
    """Filler that no phrase names: recurring units, keyboard rows, Latin script without function words.

    A run without a breaking word is looked for from its end, so most words of ordinary prose are never tested.
    """
    if recurring(text):
        return True
    for line in text.split("\n"):
        words = line.split(" ")
        i = 0
        while i + FILLER_RUN <= len(words):
            j = i + FILLER_RUN - 1
            while j >= i and _plain(words, j):
                j -= 1
            if j >= i:
                i = j + 1
                continue
            end = i + FILLER_RUN
            while end < len(words) and _plain(words, end):
                end += 1
            if len({w.strip(_MARKS).lower() for w in words[i:end]}) <= FILLER_VARIETY * (end - i):
                return True
            i = end + 1
    low = text.lower()
    if any(x in low for x in _KEY_ROWS):
        words = [w.strip(_MARKS) for w in low.split()]
        return any(keyboard(a) and keyboard(b) for a, b in itertools.pairwise(words))
    return False


def _blank(m) -> str:
    return " " * (m.end() - m.start())


def flags(text: str | None, prefilter: bool = True) -> tuple[bool, bool, bool, bool]:
    """Whether a text holds a placeholder, a failed value, filler and a notice. A null, empty or blank text holds none.

    Code and quotations are blanked out at equal length, so a match keeps its place and its paragraph.
    """
    if not text or text.isspace():
        return False, False, False, False
    todo = set(range(len(rules())))
    if prefilter:
        todo = {n for _, numbers in automaton().iter(fold(text)) for n in numbers}
    code, bits = text, []
    if "`" in text or "<pre" in text or "<code" in text:
        bits = [m.span() for m in _CODE.finditer(text)]
        code = _CODE.sub(_blank, text)
    lined = _INDENTED.sub(_blank, code) if "\n    " in code or "\n\t" in code else code
    prose = _QUOTED.sub(_blank, code)
    about_code = len(bits) > CODE_BITS and len(bits) * 1000 > len(text) * CODE_DENSITY

    def coded(start: int, end: int) -> bool:
        return any(x < end and y > start for x, y in bits)

    def counts(a: int, b: int) -> bool:
        if not about_code:
            return True
        end = text.find("\n\n", b)
        return not coded(text.rfind("\n\n", 0, a) + 1, len(text) if end < 0 else end)

    found = dict.fromkeys((*FAMILIES, "loose"), False)
    for n in sorted(todo):
        rule = rules()[n]
        if not found[rule.family]:
            where = prose if rule.family in ("filler", "notice") else lined
            found[rule.family] = any(counts(*m.span()) for m in rule.search.finditer(where))
    if not found["filler"]:
        if about_code:
            parts = [m.span() for m in regex.finditer(r"(?s).+?(?:\n\n|$)", prose)]
            found["filler"] = any(running_filler(prose[a:b]) for a, b in parts if not coded(a, b))
        else:
            found["filler"] = running_filler(prose)
    return found["placeholder"] or found["loose"], found["failed_value"], found["filler"], found["notice"]


def with_flags(documents: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with a boolean for each family and ``is_residue``; rows keep their number."""
    small_batches(documents.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + ", ".join(f"{c} boolean" for c in (*FAMILIES, "is_residue"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [flags(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([g[i] for g in got], pa.bool_()) for i in range(4)] + [pa.array([any(g) for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=[*keep, *FAMILIES, "is_residue"])

    return spread(documents.select(*keep, text_col)).mapInArrow(run, schema)


def flag_residue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` keys with a flag for each family and ``is_residue``. Null, empty and blank texts are no cases; rows keep their number."""
    return with_flags(documents, [id_col], text_col)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_residue(table(spark, sf_dir, "documents")).filter("is_residue").select("doc_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with content and without residue."""
    documents = table(spark, sf_dir, "documents").filter("text is not null and text rlike '(?U)\\\\S'")
    return with_flags(documents, ["doc_id", "lang", "source", "n_chars"]).filter("not is_residue").select("doc_id", "lang", "source", "n_chars")


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and cases of each family by source."""
    flagged = with_flags(table(spark, sf_dir, "documents"), ["source"])
    return flagged.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.count_if(k).alias(f"n_{k}") for k in FAMILIES])


QUERIES = {"p9_found": p9_found, "p9_clean": p9_clean, "p9_by_source": p9_by_source}
