import json
import random

from newsloom.llm import residue as P
from newsloom.llm import sentences as S
from newsloom.llm import truncation as T


def parts(text, lang=None):
    return [text[a:b] for a, b in S.split(text, lang)]


def test_languages():
    cases = [
        (["Dr. Jo Hill met J. R. Fox at 3 p.m. near St. Ives.", "It rained."], " "),
        (["“Is anyone there?” Ann shouted from the roof.", "A plate says: “Danger! Do not cross.”", "He left (see p. 4.) at once."], " "),
        (["Am 3. Mai stieg der Pegel, z. B. in Ulm, um 2,5 m.", "„Raus! Sofort!“ rief Eva."], " "),
        (["M. Petit a cité l'art. 9, soit env. 3 pages.", "« Qui est là ? » a crié Luc.", "Il finit ainsi : « 3 maisons. »"], " "),
        (["¿Vino la Dra. Sol a las 5 a. m. al dique?", "El parte acababa así: «9 casas.»", "¡Qué noche!"], " "),
        (["Г-н Яров жил на ул. Речной, д. 2, до 1988 г. в городе.", "«Кто там?» — крикнул он."], " "),
        (["记录写道：“28户停电。”", "“快走！马上走！”祝松喊道。", "据涂樵介绍，水位（常年为4米。），已升高。"], ""),
        (["「橋は失った。」と木は話した。", "沢は「水位は3.5メートル。」とだけ伝えた。"], ""),
        (["डॉ. राम ने कहा कि स्तर 4.5 मी. रहा।", "“पुल गया। सड़क है।” ऐसा कहा।"], " "),
        (["ذكر د. سالم أن المنسوب بلغ 4.5 م. في البلدة.", "«فقدنا الجسر. بقي الطريق»، قال سالم."], " "),
        (["น้ำท่วมถึงบ้าน", "ชาวบ้านอพยพ?", "จบ"], " "),
    ]
    for sentences, gap in cases:
        assert parts(gap.join(sentences)) == sentences, parts(gap.join(sentences))
        assert parts(gap.join(sentences), "xx") == sentences


def test_lines_marks_and_blanks():
    assert parts("Heading\r\n- One. Two.\n\n 1. Three\n  • Four  ") == ["Heading", "- One.", "Two.", "1. Three", "• Four"]
    assert parts("") == parts(None) == parts(" \n\t") == []
    assert parts("End here.Next one.") == ["End here.", "Next one."]
    assert parts("no end") == ["no end"] and parts("an “open quote. Next one.") == ["an “open quote.", "Next one."]
    assert S.body("a\n====ALIGNMENT====\nb") == "a\n" and S.body(None) is None and S.body("a") == "a"


def test_positions_cover_the_text():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["A b", ". ", "! ", "“", "”", "(", ")", "\n", "。", "é", "3.5", "Dr. ", "…"]) for _ in range(rng.randrange(40)))
        last = 0
        for a, b in S.split(t):
            assert last <= a < b and t[a:b] == t[a:b].strip() and not t[last:a].strip()
            last = b
        assert not t[last:].strip()


def test_long_lines_take_linear_time():
    import time

    def took(k):
        began = time.perf_counter()
        S.split("He said “Go now. Stop.” and ran, " * k + "(" * k + "x. " + "」" * k, "en")
        return time.perf_counter() - began

    took(10)
    assert took(8000) < 40 * max(took(800), 0.01)


def test_sentence_rows(spark):
    el = "struct<sent_idx: int, text: string, sources: array<int>, evidence: array<string>, conflict_resolved: string>"
    schema = f"aligned_id bigint, lang string, fused_content string, alignment array<{el}>, row_no int"
    df = spark.createDataFrame([(1, "en", "Ann ran. Cid sat.\n====ALIGNMENT====\n[1. 2.]", [(1, "X y.", None, None, None), None, (3, None, None, None, None), (4, "Zoe won. Will too.", None, None, None)], 9), (2, None, None, None, 9)], schema)
    assert [tuple(r) for r in S.sentences(df).orderBy("row_no", "sent_no").collect()] == [(1, 0, 1, 0, 8), (1, 0, 2, 9, 17), (1, 1, 1, 0, 4), (1, 4, 1, 0, 8), (1, 4, 2, 9, 18)]
    assert S.sentences(df.limit(0)).count() == 0


def test_endings():
    assert T.ending("All done.") == ("closed", True) and T.ending("He said “done.”")[0] == "closed"
    assert T.ending("The river ro")[0] == "open" and T.ending("water � ".replace("�", "�"))[0] == "cut"
    assert T.ending("It fell […]")[0] == "cut" and T.ending("by rain... (more)")[0] == "cut" and T.ending("Then nothing…")[0] == "ellipsis"
    assert T.ending("Done.\n\nReporting: the North desk")[0] == "tail" and T.ending("x.\n- pumps: 4")[0] == "tail" and T.ending("x.\nUlm: 35,8")[0] == "tail"
    assert T.ending("“" + "He left. " * 90)[0] == "open" and T.ending("“" + "He left. " * 90 + "”")[0] == "closed"
    assert T.ending("a cité l'art.")[0] == "open" and T.ending("signed by Dr.")[0] == "open" and T.ending("closed at 7 p.m.")[0] == "closed" and T.ending("")[0] == "closed"
    full = json.dumps([{"sent_idx": 1, "text": "a", "conflict_resolved": ""}])
    for good in (full, f"```json\n{full}\n```", full + "\n====ALIGNMENT====", full + " // end", full.replace('": ', '"= '), full + "\nAll sentences are covered.", "Sentence 1 rests on version 2."):
        assert T.structure_end(good)[0] == "closed", good
    for bad in (full[:-1], full[:20], full[:-9], "```json\n" + full[:30], full + "\n====ALIGN", "Sentence 1 rests on ver"):
        assert T.structure_end(bad)[0] == "open", bad


VALUES = "field_name string, row_id bigint, source string, text string, structured boolean"


def test_spikes(spark):
    rng = random.Random(2)
    prose = lambda n: ("riverbank " * 60)[: n - 1] + "."
    rows = [("f", i, "A" if i % 2 else "a", prose(rng.randrange(50, 300)), False) for i in range(120)]
    rows += [("f", 200 + i, "a", prose(297) + "...", False) for i in range(12)] + [("f", 300, "a", prose(299), False), ("f", 301, "a", "Then nothing…", False), ("f", 302, "a", None, False), ("f", 303, "a", " ", False), ("f", 200, "a", prose(297) + "...", False)]
    got = T.judged(spark.createDataFrame(rows, VALUES))
    assert {r.row_id for r in got.filter("is_cut").collect()} == {200 + i for i in range(12)} and got.count() == 134
    assert [(r.unit, r.size) for r in T.spikes(T.of_values(T.endings(spark.createDataFrame(rows, VALUES)))).orderBy("unit").collect()] == [("bytes", 300), ("chars", 300)]
    assert {r.reason for r in got.filter("is_cut").collect()} == {"limit"}  # the closed ends at and off the limit stay
    assert T.judged(spark.createDataFrame([], VALUES)).count() == 0


def test_spikes_are_decided_by_chance(spark):
    def at(lengths):
        rows = [("f", i, "s", "x" * n, False) for i, n in enumerate(lengths)]
        return {(r.unit, r.size) for r in T.spikes(T.of_values(T.endings(spark.createDataFrame(rows, VALUES)))).collect()}

    rng = random.Random(3)
    assert at([rng.randrange(50, 1000) for _ in range(200)]) == set()  # no limit
    assert at([rng.randrange(50, 990) for _ in range(30)] + [1000] * 5) == {("chars", 1000), ("bytes", 1000)}  # few values are enough
    assert at([rng.randrange(50, 990) for _ in range(30)] + [700] * 5) == set()  # not at the maximum
    assert at([1000]) == set()


def test_thai_ends_by_rate(spark):
    words = ["น้ำท่วม", "บ้านเรือน", "ชาวบ้าน", "สะพาน", "เจ้าหน้าที่"]
    text = " ".join("".join(words[(i + j) % 5] for j in range(3)) for i in range(5))
    for copies in (2, 40):  # the verdict on a text doesn't depend on the size of the corpus
        rows = [("f", i, "s" + str(i % 7), text, False) for i in range(copies)] + [("f", 900, "s", text + " " + words[0], False), ("f", 901, "s", text + " น้ำท", False)]
        got = {r.row_id: (r.is_cut, r.reason) for r in T.judged(spark.createDataFrame(rows, VALUES)).filter("row_id >= 900").collect()}
        assert got == {900: (False, None), 901: (True, "open_end")}
    assert list(T.thai_contexts("ชาวบ้าน บ้าน")) == [(c, s) for c, s in (("ชาว", False), ("าวบ", False), ("วบ้", False), ("บ้า", False), ("้าน", True), ("บ้า", False))]


CASES = [
    "Title: {{ headline }}", "The ${place} council met.", "Sources: <%= figure %>", "By XXX DATE XXX", "the #REF! site", "Photo: [object Object]", "[INSERT BYLINE] said", "met <source_name> today", "Updated undefined", "stayed None until 3",
    "Lorem ipsum dolor sit amet elit", "Body text body text body text.", "404 Not Found", "Access denied\n\nnginx", "Please enable JavaScript to continue.", "请启用 JavaScript 后重新加载本页。", "（地点待补）举行", "Traceback (most recent call last):", '{"error": {"status": 403}}', "rose by NaN twice", "in %s and", "Published: (null)", "[This site requires JavaScript.] The council met.",
    "Sed enim minim veniam quis nostrud labore et dolore", "jkl jkl jkl jkl", "Your story begins in this box", "ici viendra le texte à venir", "Error 405", "408 / Request Timeout", "zxcv zxcv", "aaa bbb. Aaa bbb, aaa bbb.", "511 Network Authentication Required",
    "Mirum lanta corvo deline, mirum corvo lanta. Deline corvo mirum lanta.",
]
CLEAN = [
    "The archive answered every request with error 404 for 14 hours.", "“Please enable JavaScript” was the only line readers saw.", "“请启用JavaScript”是居民看到的一行字。", "writes the city into a field it calls `{{ city }}` before", "Undefined borders slow the work.", "Access denied signs now hang at the quarry.", "jokes that the lorem ipsum is older",
    'keeps its readings as {"station": "X", "level": 35.6} in files', "The set {1, 2, 23} of gauges failed [sic].", "the m<unk>ovement <|endoftext|> </s>", "Only the placeholder stones stand.", "Costs rose by 13% (from $2), wrote A <a@mail.example>.", "[Update 13:13] Ann has left.", "A gateway timeout delayed 8253 alerts.", "7,404 pumps; None of them failed.", "Costs rose to $3402\nin all.", "No, no, no.", "", " ", None,
]


def test_residue(spark):
    rows = [(i, t, True) for i, t in enumerate(CASES + CLEAN)]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id bigint, text string, notice boolean")
    got = P.flag_residue(df).collect()
    assert len(got) == len(rows) + 1
    wrong = {(r.doc_id, (CASES + CLEAN)[r.doc_id]) for r in got if r.is_residue != (r.doc_id < len(CASES))}
    assert not wrong, wrong
    assert P.flag_residue(df.limit(0)).count() == 0


def test_derived_literals_drop_no_match():
    """With and without the filter by required literals all flags agree, on the cases, on pieces of patterns and on random joins."""
    assert P.required("(?i)foo(?:bar|Baz)?[xy]z") == {"fooxz", "fooyz", "foobarxz", "foobaryz", "foobazxz", "foobazyz"}
    assert P.required("a*b|[0-9]+") is None and P.required("(?:ab+|cd)?e") == {"e"} and P.required(r"\w+(?:one|two)\d") == {"one", "two"}
    pieces = [c for c in CASES + CLEAN if c] + [x for r in P.rules() for x in r.literals] + ["\n\n", " ", "`x`", "“", "”", "ſ", "K", "İ", "Σ"]
    rng = random.Random(7)
    for text in pieces + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]:
        for t in (text, text.upper(), text.title()):
            assert P.flags(t) == P.flags(t, prefilter=False), t


def test_context_of_every_family():
    tutorial = "Use `a`, `b` and `c` with `d` in {}.\n\nA second part follows here."
    for bad in ("{{ city }}", "#REF!", "“lorem ipsum dolor”", "this page does not exist"):
        assert not any(P.flags(tutorial.format(bad))), bad
    assert any(P.flags(tutorial.format("x") + "\n\n{{ city }} will follow.")) and any(P.flags("The {{ city }} of `a`."))
    assert not any(P.flags("An example:\n\n    call({{ city }});\n    stop();\n"))
    assert any(P.flags("{{ " + "n" * 300 + " }}")) and not any(P.flags("“" + "n " * 200 + "Error 405”"))
