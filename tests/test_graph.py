import json

from pyspark.sql import functions as F

from newsloom.models import providers as P
from newsloom.models.providers import StubModel
from newsloom.operators import evaluate as E
from newsloom.operators import graph as G
from newsloom.operators import stages as S
from newsloom.operators import versions as V
from newsloom.functions import text as X
from newsloom.sources import io

SEGMENTS = "doc bigint, segment_id string, text string"


class Answers:
    """Answers by what the prompt holds."""

    def __init__(self, by):
        self.by = by

    def complete(self, system, user):
        for part, answer in self.by.items():
            if part in user:
                return answer
        raise RuntimeError("down")


ANALYSIS = Answers({
    "Alpha": json.dumps({"tags": [{"tag_id": "a", "tag_type": "core", "sentence": "Alpha one."}, {"tag_type": "quote", "sentence": "Alpha two."}],
                         "reduced_versions": [{"version_id": "v1", "keep_tag_ids": ["a", "s1_tag_2", "x"], "suggestions": "short"}, {"version_id": "v2", "keep_tag_ids": []}]}),
    "Beta": json.dumps({"tags": [], "reduced_versions": [{"version_id": "v2", "keep_tag_ids": ["s2_auto_1"]}]}),
    "Gamma": "no json",
})
ROWS = [(1, "s1", "Alpha one. Alpha two.\n\nAlpha rest."), (1, "s2", "Beta."), (2, "s1", "Gamma."), (3, "s1", " ")]


def test_analysis_and_masks(spark):
    analyzed = G.analyze_segments(spark.createDataFrame(ROWS, SEGMENTS), ANALYSIS)
    got = {(r.doc, r.segment_id): r for r in analyzed.collect()}
    one = got[(1, "s1")]
    assert [t.full_tag_id for t in one.tags] == ["s1_a", "s1_tag_2", "s1_auto_1"] and one.tags[2].sentence == "Alpha rest."
    assert one.reduced_versions[0].keep_tag_ids == ["s1_a", "s1_tag_2", "s1_x"]
    assert one.tagged_text == "<s1_a>Alpha one.</s1_a> <s1_tag_2>Alpha two.</s1_tag_2>\n\n<s1_auto_1>Alpha rest.</s1_auto_1>"
    assert got[(2, "s1")].error == "no_brace_match" and got[(2, "s1")].tags == [] and got[(3, "s1")].error is None
    masked = {(r.doc, r.version_id): r for r in G.masks(analyzed).collect()}
    assert masked[(1, "v1")].mask == ["s1_auto_1", "s2_auto_1"] and masked[(1, "v1")].suggestions == ["short"]
    assert masked[(1, "v2")].keep_tag_ids == ["s2_auto_1"] and masked[(1, "v2")].mask == ["s1_a", "s1_tag_2", "s1_auto_1"]
    assert {k[1] for k in masked if k[0] == 2} == {"reduced_v1", "reduced_v2", "reduced_v3"}
    reduced = {(r.doc, r.version_id): r for r in G.apply_masks(G.masks(analyzed)).collect()}
    assert [s.text for s in reduced[(1, "v1")].segments] == ["Alpha one. Alpha two.", ""] and reduced[(1, "v2")].text == "\n\nBeta." and reduced[(2, "reduced_v1")].text == "Gamma."
    assert G.masks(analyzed.limit(0)).count() == 0


def test_versions_that_keep_nothing_draw_a_third(spark):
    many = Answers({"A": json.dumps({"tags": [{"tag_id": f"t{i}", "sentence": f"A{i}."} for i in range(7)], "reduced_versions": []})})
    analyzed = G.analyze_segments(spark.createDataFrame([(1, "s", " ".join(f"A{i}." for i in range(7)))], SEGMENTS), many)
    rows = G.masks(analyzed).collect()
    assert len(rows) == 3 and all(len(r.mask) == 5 and r.keep_tag_ids == [] for r in rows) and G.masks(analyzed).collect() == rows


class Strict:
    """Passes a text that says fixed."""

    def judge(self, source, rewrite):
        if "raise" in source:
            raise ValueError("bad judge")
        return {"passed": "fixed" in rewrite, "score": 0.4, "feedback": "wrong", "missing": [{"text": "m", "where_hint": "end"}], "suggested_edits": [{"text": "e", "position_hint": "p"}]}


class Learner:
    """Writes fixed once it gets feedback."""

    def complete(self, system, user):
        if "mute" in user:
            return " "
        return "fixed" if "Content to add:" in user and "never" not in user else user.split("\n")[0]


def test_rewrites(spark):
    texts = ["good", "never", "mute", "raise", " "]
    reduced = spark.createDataFrame([(i, 1, [{"segment_id": "s", "text": t}]) for i, t in enumerate(texts)], "doc bigint, version_no int, segments array<struct<segment_id: string, text: string>>")
    got = {r.doc: r for r in G.rewrite_versions(reduced, Learner(), Strict(), G.WordJudge(diversity=True)).collect()}
    assert got[0].ok and got[0].final_rewritten_text == "fixed" and [h.faithful for h in got[0].history] == [False, True]
    assert got[0].history[1].feedback_used == "Faithfulness issues: wrong\nContent to add:\n- m (position: end)\nSpecific modification suggestions:\n- Modify: e (position: p)"
    for i in (1, 2, 3):
        assert got[i].used_fallback and got[i].final_passed and not got[i].ok and got[i].final_rewritten_text == texts[i] and len(got[i].history) == 3
    assert not got[4].final_passed and got[4].used_fallback and got[4].history == []
    versions = G.assemble(spark.createDataFrame([(1, 1, "a", "x", True, False, True), (1, 1, "b", "y", True, True, False), (1, 2, "a", "z", True, False, True), (2, 1, "a", "", False, True, False)],
                          "doc bigint, version_no int, segment_id string, final_rewritten_text string, final_passed boolean, used_fallback boolean, ok boolean"))
    v = {(r.doc, r.version_no): r for r in versions.collect()}
    assert v[(1, 1)].final_rewritten_text == "x\n\ny" and v[(1, 1)].success_ratio == 0.5 and v[(1, 2)].quality_label == "Fully Successful" and v[(1, 2)].version_id == "rewritten_v2"
    assert [(r.doc, r.version_no) for r in G.best_versions(versions).collect()] == [(1, 2)]
    runs = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 2)], "doc bigint, attempt int, max_attempts int")
    assert {r.doc: r.final_status for r in G.evaluate_runs(versions, runs).collect()} == {1: "success", 2: "retry", 3: "fallback"}
    assert G.degraded(spark.createDataFrame(ROWS[:2], SEGMENTS), StubModel()).collect()[0].final_rewritten_text == "Alpha one. Alpha two. Alpha rest."


def test_graph_end_to_end(spark):
    versions, summaries = G.rewrite_graph(spark.createDataFrame(ROWS[:2], SEGMENTS), StubModel(), ANALYSIS, G.WordJudge(), G.WordJudge(diversity=True))
    assert versions.count() == 2
    s = summaries.collect()[0]
    assert s.total_versions == 2 and [t.version_id for t in s.top_rewrites] == ["rewritten_v1", "rewritten_v2"] and s.top_rewrites[0].success_ratio == 0.5


def test_judges():
    model = G.ModelJudge(Answers({"ok": 'so: {"passed": true, "score": 1}', "odd": '{"score": 1}'}), "check")
    assert model.judge("a", "ok")["passed"] and not model.judge("a", "odd")["passed"] and not model.judge("", "ok")["passed"] and "RuntimeError" in model.judge("a", "down")["feedback"]
    assert G.compose_feedback({"passed": True}, {"passed": False, "feedback": "plain"}) == "Diversity suggestions: plain"
    assert G.WordJudge().judge("a b", "a c") == {"passed": True, "score": 0.5, "feedback": "", "missing": [{"text": "b", "where_hint": ""}]}


def test_providers():
    assert P.response_text({"choices": [{"message": {"content": "x"}}]}) == P.response_text("x") == P.response_text([{"text": "x"}]) == P.response_text({"generations": [[{"text": "x"}]]}) == "x"
    assert P.response_text(None) == ""
    calls = []

    def fail():
        calls.append(1)
        raise OSError("down")

    assert P.RetryPolicy(tries=4).run(fail) == (None, "OSError: down") and len(calls) == 4
    assert P.stage_model("http", "align", base_urls=["u"], model="m").temperature == 0.0 and P.RETRIES["rewrite"].linear


def test_evaluation_of_items(spark):
    alignment = json.dumps([{"sent_idx": 1, "text": "One bad.", "sources": [1], "evidence": ["e"]}, {"sent_idx": 2, "text": "Two.", "sources": [], "evidence": []}])
    rows = [("1", "One bad. Two.", f"One bad. Two.\n====ALIGNMENT====\n{alignment}", "One.", None), ("2", "x", " ", "y", None), ("3", "Three.", "Three.\n====ALIGNMENT====\nno json", None, None), ("3", "Three.", "Three.\n====ALIGNMENT====\nno json", None, None)]
    items = spark.createDataFrame(rows, "id string, input_text string, fused_content string, rewritten_v1 string, rewrite_2 string")

    class Finds:
        def complete(self, system, user):
            return json.dumps({"problem_exists": "bad" in user and user.startswith(("style", "wording")), "evidence": ""})

    got = {r.id: r for r in S.evaluate_items(items, Finds(), P.HashEmbedder()).collect()}
    assert len(got) == 3 and (got["1"].global_problem_count, got["1"].sentence_problem_count, got["1"].total_problem_count) == (1, 1, 2)
    assert got["1"].global_problems == {"style": 1} and got["1"].sentence_problems == {"wording": 1} and got["1"].similarity_success and got["1"].semantic_similarity > 0
    assert not got["2"].evaluation_success and got["2"].global_problem_count is None and not got["2"].similarity_success
    assert got["3"].sentence_problem_count == 0 and got["3"].sentence_problems == {}
    flat = S.evaluate_items(items, Finds(), P.HashEmbedder()).withColumn("by_type", F.col("global_problems"))
    assert {(r.problem, r.n) for r in E.type_totals(flat, "global").collect()} == {("style", 1), (None, 1)}
    tally = E.batch_tally(S.evaluate_items(items, Finds(), P.HashEmbedder()).withColumn("batch", F.lit(1)), "batch").collect()[0]
    assert (tally.n_items, tally.n_success, tally.total_global_problems, tally.total_sentence_problems) == (3, 2, 1, 1)


def test_method_means(spark):
    rows = spark.createDataFrame([(1, "original", 0.4, 1.0, None), (1, "rewritten_v1", 0.8, 1.0, 0.0), (2, "rewritten_v1", 0.9, 0.9, 0.9)], "id int, version_id string, semantic double, tfidf double, jaccard double")
    got = {r.id: r for r in E.method_means(rows, "id", ["semantic", "tfidf", "jaccard"], "semantic").collect()}
    assert abs(got[1].semantic - 0.6) < 1e-9 and got[1].jaccard == 0.0 and got[1].verdict == "medium" and got[1].methods_differ and got[1].original_low
    assert got[1].observations == ["original_low", "methods_differ", "check_wording"] and got[2].observations == []
    assert got[2].verdict == "high" and not got[2].methods_differ and not got[2].original_low
    items = spark.createDataFrame([("f", "o", None, "b", "c"), (" ", "o", "a", None, None), ("f", None, "a", None, None)], "fused_content string, input_text string, rewritten_v1 string, rewrite_1 string, rewritten_v2 string").withColumn("id", F.monotonically_increasing_id())
    assert [(r.version_id, r.text) for r in E.candidates(items, "id").collect()] == [("original", "o"), ("rewrite_1", "b"), ("rewritten_v2", "c")]


def test_entities_totals_and_values(spark):
    e = spark.createDataFrame([(1, "Ulm", "GPE", 9), (1, "Ulm", "GPE", 3), (1, "Ulm", "FAC", 1), (1, "", "DATE", 0), (2, "Ulm", "GPE", 5), (2, None, "GPE", 5)], "id int, text string, label string, start_char int")
    assert {(r.id, r.text, r.start_char) for r in V.usable_entities(e, ["id"], "start_char").collect()} == {(1, "Ulm", 3), (2, "Ulm", 5)}
    c = spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (1, None), (2, "b")], "id int, entity_text string")
    assert {r.id: (r.total_conflicts, r.entities_with_conflicts) for r in V.conflict_totals(c, ["id"]).collect()} == {1: (4, 1), 2: (1, 1)}
    df = spark.createDataFrame([("t", [1, 2], 5), (None, None, None)], "s string, a array<int>, n int")
    assert [tuple(r) for r in df.select(*[X.value_text(df, c) for c in df.columns]).collect()] == [("t", "[1,2]", "5"), ("", "", "")]


def test_list_only_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"id": "3"}')
    (tmp_path / "c.json").write_text("[{")
    assert sorted(r.id for r in io.read_list(spark, str(tmp_path), io.FUSED_SCHEMA).filter("id is not null").collect()) == ["1", "2"]
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in io.unreadable_files(spark, str(tmp_path), True).collect()} == {("b.json", "not_a_list"), ("c.json", "not_json")}


def test_items_of_any_shape(spark, tmp_path):
    shapes = [
        [{"id": "1", "rewritten_v1": "a", "rewritten_v2": None}, "bare", 7],
        {"id": "2", "top_rewrites": [{"final_rewritten_text": "t"}, "s", 3]},
        {"meta": [1], "items": [{"news_id": "3", "text": "T", "rewrites": [{"summary": "x"}], "input_text": ""}, "skipped"]},
        {"item_id": "4", "final_text": "f"},
    ]
    for i, shape in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(json.dumps(shape))
    (tmp_path / "bad.json").write_text("{")
    got = {tuple(r) for r in io.read_items(spark, str(tmp_path)).collect()}
    assert got == {("1", "", "a", "", ""), ("", "bare", "", "", ""), ("", "", "", "", ""), ("2", "", "t", "s", ""), ("3", "T", "x", "", ""), ("4", "", "f", "", "")}
