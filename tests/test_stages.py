import json

from newsloom import cli
from newsloom.models.providers import HashEmbedder, PatternEntities, StubModel
from newsloom.operators import evaluate as E
from newsloom.operators import stages as S


class Answer:
    def __init__(self, text):
        self.text = text

    def complete(self, system, user):
        if "fail" in user:
            raise RuntimeError("down")
        return self.text


TEXT = "洪水淹没了整个城区，救援人员在夜间疏散了两千名居民到学校避难。\n短句。\n订阅我们的电子报，请输入电子信箱，感谢您的支持，早安世界每天见面。"
NEWS = "id string, title string, content string, main_topic string"


def test_segment_news(spark):
    df = spark.createDataFrame([("1", "洪水", TEXT, "灾害"), ("2", "t", " ", None), ("3", None, None, None)], NEWS)
    got = {r.id: r for r in S.segment_news(df, HashEmbedder()).collect()}
    assert "救援" in got["1"].cleaned_content and "短句" not in got["1"].cleaned_content and got["1"].processing_success
    assert got["1"].segment_count == 1 and got["1"].segments[0].original_indices == [0] and got["1"].segmentation_stats.total_chars == len(got["1"].cleaned_content) and got["1"].segments[0].theme
    assert got["2"].cleaned_content is None and got["3"].processing_success is None and len(got) == 3
    assert S.segment_news(df.limit(0), HashEmbedder()).count() == 0
    assert S.themes(spark.createDataFrame([("1", 1, "A b c. D.")], "id string, segment_id int, content string")).collect()[0].theme == "A b c."


def test_repeated_news_rows_are_not_doubled(spark):
    row = ("1", "洪水", TEXT, "灾害")
    once = S.segment_news(spark.createDataFrame([row], NEWS), HashEmbedder()).collect()
    twice = S.segment_news(spark.createDataFrame([row, row, ("1", "other", TEXT + "\n" + "水位上涨到警戒线以上，居民表示非常担心堤坝的安全情况。", None)], NEWS), HashEmbedder()).collect()
    assert len(twice) == 3 and [r.cleaned_content for r in twice if r.title == "洪水"] == [once[0].cleaned_content] * 2


class Broken:
    def embed(self, texts):
        raise RuntimeError("no model")


def test_segments_without_embeddings_join_by_length(spark):
    pars = "\n".join(f"第{i}段：洪水之后救援人员表示，居民已经全部疏散到学校避难，" + "水" * 120 for i in range(6))
    df = spark.createDataFrame([("1", "洪水", pars, "灾害")], NEWS)
    got = S.segment_news(df, Broken()).collect()[0]
    assert got.segment_count == 2 and [len(s.original_indices) for s in got.segments] == [3, 3] and got.segments[0].importance_score > 0


def test_keywords_keep_a_paragraph(spark):
    text = "The ferry to Lower Marsh stays in port until the gauge is read again by noon.\nNothing else in this line is of any use to anyone who looks for it today."
    df = spark.createDataFrame([("1", "Ferry stays", text, None)], NEWS)
    assert S.segment_news(df, Broken()).collect()[0].cleaned_content.startswith("The ferry")
    kw = S.keywords_of("Ferry stays, ferry leaves the port", S.KeywordTokenizer(), 3)
    assert kw == ["ferry", "stays", "leaves"] and S.keywords_of("洪水淹没洪水", S.KeywordTokenizer(), 1) == ["洪水"] and S.keywords_of(None, S.KeywordTokenizer(), 3) == []
    assert S.best_sentences("Aa bb. Cc dd ee ff. Gg.", ["cc", "dd"], S.WordTokenizer(), 2, in_order=True) == ["Aa bb.", "Cc dd ee ff."]


def test_fuse_and_align(spark):
    items = spark.createDataFrame([("1", "a", "b", ""), ("2", None, "only", " "), ("3", "fail", "b", None), ("4", None, None, None)], "id string, rewritten_v1 string, rewritten_v2 string, rewritten_v3 string")
    got = {r.id: (r.fused_content, r.fusion_method) for r in S.fuse(items, Answer("Fused News: x")).collect()}
    assert got == {"1": ("x", "model"), "2": ("only", "single_version"), "3": ("fail", "fallback"), "4": ("", "single_version")}
    rows = spark.createDataFrame([("1", "text"), ("2", " "), ("3", "fail")], "id string, fused_content string")
    good = json.dumps([{"sent_idx": 1, "text": "text", "sources": [1], "evidence": ["t"], "conflict_resolved": ""}])
    got = {r.id: (len(r.alignment), r.alignment_error) for r in S.align(rows, Answer("====ALIGNMENT====\n" + good)).collect()}
    assert got["1"] == (1, None) and got["2"] == (0, "missing_fused_content") and got["3"][1].startswith("RuntimeError")


def test_inject(spark):
    v = spark.createDataFrame([("1", "v1", "In 1999 it rose 3 m."), ("1", "v2", "In 1999 it fell.")], "id string, version_id string, text string")
    answer = json.dumps({"modified_text": "In 1998 it rose.", "conflicts": [{"entity_text": "1999", "original_span": "1999", "injected_span": "1998", "type": "date"}]})
    for shared in (False, True):
        r = S.inject(v, Answer(answer), PatternEntities(), shared).collect()
        assert [(x.injected_text, x.conflicts[0].span_start, x.conflicts[0].span_end) for x in r] == [("In 1998 it rose.", 3, 7)] * 2
        if shared:
            assert r[0].shared_entities == ["1999"]
    r = S.inject(v, Answer("no json"), PatternEntities()).collect()
    assert r[0].injected_text == r[0].text and r[0].conflicts[0].type == "unknown"


def test_checks_and_similarity(spark):
    t = E.tasks(spark.createDataFrame([("1", "x"), ("2", "fail")], "id string, text string"), ["style"])
    got = {r.id: r.problem_exists for r in S.check_problems(t, Answer('{"problem_exists": true, "evidence": "e"}')).collect()}
    assert got == {"1": True, "2": False}
    f = spark.createDataFrame([("1", "same words here", "same words here", None, "other", "same words here")], "id string, input_text string, rewritten_v1 string, rewritten_v2 string, rewritten_v3 string, fused_content string")
    r = {x.version_id: x for x in S.version_similarity(f, "id", HashEmbedder()).collect()}
    assert set(r) == {"original", "rewritten_v1", "rewritten_v3"} and r["rewritten_v1"].semantic > 0.999 and r["rewritten_v3"].jaccard == 0 and r["rewritten_v1"].levenshtein == 1
    down = {x.version_id: x for x in S.version_similarity(f, "id", Broken()).collect()}
    assert all(x.semantic == x.tfidf for x in down.values())  # word pairs stand in
    assert StubModel().complete("", " a  b ") == "a b"


def test_command(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"id": "1", "rewritten_v1": "a b", "rewritten_v2": "c d"}]))
    assert cli.main(["fuse", str(tmp_path / "in.json"), str(tmp_path / "out"), "--sample", "5"]) == 0
    assert spark.read.json(str(tmp_path / "out")).collect()[0].fused_content == "a b c d"
    (tmp_path / "news.json").write_text(json.dumps([{"id": "n1", "content": "First part here.\n\nSecond part here."}, {"id": "n2", "content": " "}]))
    assert cli.main(["rewrite", str(tmp_path / "news.json"), str(tmp_path / "rw")]) == 0
    assert {r.id for r in spark.read.json(str(tmp_path / "rw" / "summary")).collect()} == {"n1"} and (tmp_path / "rw" / "trace").exists()
    (tmp_path / "fused.json").write_text(json.dumps([{"id": "f", "input_text": "a b", "fused_content": "a b"}]))
    assert cli.main(["evaluate", str(tmp_path / "fused.json"), str(tmp_path / "ev")]) == 0
    assert spark.read.json(str(tmp_path / "ev")).collect()[0].evaluation_success
