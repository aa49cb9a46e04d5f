import numpy as np
from pyspark.sql import functions as F

from newsloom.functions import jsonx, score, similarity, text
from newsloom.models import providers as P
from newsloom.operators import evaluate as E
from newsloom.operators import masking as M
from newsloom.operators import rewrite as R
from newsloom.operators import segment as G
from newsloom.operators import versions as V
from newsloom.sources import io
from newsloom.streaming import feeds

LEX = score.Lexicon()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).collect()[0].r


def test_text_functions(spark):
    assert one(spark, "a  b\n\n c \n", text.paragraphs) == ["a b", "c"]
    assert one(spark, "a\nb", text.paragraphs) == ["a", "b"]
    assert one(spark, " 　", text.paragraphs) == [] and one(spark, None, text.paragraphs) == []
    assert one(spark, "一。二！Three. Four? five;", text.sentences) == ["一", "二", "Three.", "Four", "five"]
    assert one(spark, "Fused News: x", text.strip_prefix) == "x"
    assert one(spark, "```json\n{}\n```", text.strip_fence) == "{}"
    assert one(spark, "\n\na\n\nb", text.blank_line_segments) == [("seg_002", "a", 2, 3), ("seg_003", "b", 5, 6)]
    tagged = one(spark, "A b. C d. A b.", lambda c: text.wrap_all(c, F.array(F.struct(F.lit("C d.").alias("sentence"), F.lit("t1").alias("tag")), F.struct(F.lit("A b.").alias("sentence"), F.lit("t2").alias("tag")))))
    assert tagged == "<t2>A b.</t2> <t1>C d.</t1> A b."
    assert one(spark, tagged, lambda c: text.remove_tagged(c, F.array(F.lit("t1")))) == "A b.  A b."
    body, rest = text.detach(F.lit("x\n====ALIGNMENT====\n[1]\n====ALIGNMENT====\n2"))
    assert spark.range(1).select(body.alias("a"), rest.alias("b")).collect()[0] == ("x", "[1]")
    start, end = text.locate_span(F.lit("桥"), F.lit("大桥桥"))
    assert spark.range(1).select(start.alias("a"), end.alias("b")).collect()[0] == (1, 2)
    assert one(spark, "s" * 61 + ". x", lambda c: text.theme(text.sentences(c), c)) == "s" * 57 + "..."


def test_decision_list(spark):
    def decide(p, s=0.0):
        return one(spark, p, lambda c: score.decision(c, LEX, F.lit(s)))

    assert decide("短" * 24) == "short" and decide("洪水" + "来" * 30) == "keep" and decide("x" * 30 + "2024年") == "keep"
    assert decide("订阅我们的电子报" + "x" * 30) == "blacklist" and decide("x" * 60, 0.1) == "irrelevant" and decide("x" * 60, 0.3) == "keep"
    assert abs(one(spark, "洪水市说1" + "x" * 60, lambda c: score.threshold(c, LEX)) - 0.05) < 1e-9


def test_similarity(spark):
    got = spark.createDataFrame([("a b c", "b c d", [1.0, 0.0], [0.0, 0.0])], "a string, b string, x array<double>, y array<double>")
    r = got.select(similarity.jaccard("a", "b").alias("j"), similarity.levenshtein("a", "b").alias("l"), similarity.cosine("x", "y").alias("c"), similarity.cosine("x", "x").alias("d"), similarity.tfidf("a", "a").alias("t")).collect()[0]
    assert (r.j, r.c, r.d) == (0.5, 0.0, 1.0) and abs(r.t - 1) < 1e-12 and 0 < r.l < 1
    assert one(spark, "", lambda c: similarity.jaccard(c, F.lit("a"))) == 0.0


def test_merges(spark):
    docs = spark.createDataFrame([(1, "\n".join("x" * n for n in (100, 350, 300, 10, 700, 200)), 0), (2, None, 0), (3, "", 0), (4, "short", 0)], "doc_id bigint, text string, segment_id int")
    got = [(r.doc_id, r.segment_id, r.char_count, r.original_indices) for r in G.length_segments(docs).orderBy("doc_id", "segment_id").collect()]
    assert got == [(1, 1, 450, [0, 1]), (1, 2, 300, [2]), (1, 3, 700, [4]), (1, 4, 200, [5])]
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert G.merge_vectors([a, a, b], [300, 300, 300], 0.5, 0.35) == [1, 1, 2]
    assert G.merge_vectors([a, a], [399, 399 + 50], 0.5, 0.35) == [1, 2]
    assert G.segment_stats(G.length_segments(docs.limit(0))).count() == 0


def test_key_sentences_and_keywords(spark):
    docs = spark.createDataFrame([(1, "Water rose. A. Water water fell fast."), (2, None)], "doc_id bigint, text string")
    assert [r.ord for r in G.key_sentences(docs, ["water"], 2).orderBy("ord").collect()] == [0, 2]
    assert [(r.word, r.n) for r in G.corpus_keywords(docs, 1).collect()] == [("water", 3)]
    assert G.document_keywords(docs, 2).count() == 2


def test_versions_and_conflicts(spark):
    items = spark.createDataFrame([("1", None, "v2", " "), ("2", "a", "b", "c")], "id string, rewritten_v1 string, rewritten_v2 string, rewritten_v3 string")
    assert [(r.n_usable, r.needs_fusion, r.fallback_text) for r in V.usable_versions(items).orderBy("id").collect()] == [(1, False, "v2"), (3, True, "a")]
    e = spark.createDataFrame([("1", v, t, "X") for v, t in (("a", "k"), ("b", "k"), ("b", "m"), ("b", "m"))], "id string, version_id string, text string, label string")
    assert [r.text for r in V.shared_entities(e).collect()] == ["k"]
    c = spark.createDataFrame([("1", "e", "a", "1", "t", 1), ("1", "e", "a", "2", "t", 2), ("1", "e", "b", "3", None, 3), ("1", "", "b", "9", None, 4), ("1", "f", "a", "1", "t", 5)], "id string, entity_text string, version_id string, injected_span string, conflict_type string, ord int")
    assert [(r.v1, r.v1_value, r.v2_value) for r in V.version_pair_conflicts(c, "ord").collect()] == [("a", "2", "3")]
    assert [r.entity_text for r in V.entity_conflicts(c).collect()] == ["e"]
    assert {(r.conflict_type, r.version_id): r.n_conflicts for r in V.conflict_counts(c).collect()}[("unknown", None)] == 2
    for f in (V.entity_conflicts, lambda x: V.version_pair_conflicts(x, "ord"), V.conflict_counts):
        f(c.limit(0)).collect()


def test_masks(spark):
    tags = spark.createDataFrame([(1, "s1", t, f"S{t}.") for t in ("a", "b", "c")], "doc bigint, seg string, tag_id string, sentence string")
    keep = spark.createDataFrame([(1, "s1", "a"), (1, "s1", "zz"), (1, "s1", "a")], "doc bigint, seg string, tag_id string")
    mask = M.mask(tags, keep, ["doc", "seg", "tag_id"])
    assert sorted(r.tag_id for r in mask.collect()) == ["b", "c"]
    assert M.masked(tags, mask, ["doc", "seg", "tag_id"]).count() == 2
    seg = spark.createDataFrame([(1, "s1", "Sa. Sb. Sc. Rest.")], "doc bigint, seg string, text string")
    assert M.apply_mask(seg, mask).collect()[0].text == "Sa. Rest."
    full = M.full_tag_ids(keep, tags.withColumn("full_tag_id", F.lit("F"))).select("full_tag_id").distinct()
    assert {r[0] for r in full.collect()} == {"F", "s1_zz"}
    pars = spark.createDataFrame([(1, 0, "Sa. x"), (1, 1, "y"), (2, 0, "z")], "doc bigint, ord int, paragraph string")
    assert sorted((r.doc, r.tag_id) for r in M.uncovered(pars, tags).collect()) == [(1, "auto_1"), (2, "auto_0")]
    assert M.sample_tags(tags, ["doc"]).count() == 1
    assert M.keep_union(keep, ["doc"]).collect()[0].keep_tag_ids == ["a", "zz"]


def test_json(spark):
    assert jsonx.extract('x {"a": "}", "b": {"c": 1}} y') == ('{"a": "}", "b": {"c": 1}}', "")
    assert jsonx.extract("{'a': 1,}") == ('{"a": 1}', "repaired") and jsonx.extract("none")[1] == "no_brace_match" and jsonx.extract(" ")[1] == "empty" and jsonx.extract("{a: b}")[1] == "unreadable"
    assert one(spark, 'so: {"problem_exists": true, "evidence": "e"}', jsonx.flat_verdict) == (True, "e") and one(spark, "no", jsonx.flat_verdict) == (False, "")
    schema = "array<struct<sent_idx: int, text: string>>"
    assert [r.text for r in one(spark, 'x\n====ALIGNMENT====\n[{"sent_idx": 1, "text": "a"},]', lambda c: jsonx.array_after(c, schema))] == ["a"]
    assert len(one(spark, '{"sent_idx": 1}', lambda c: jsonx.array_after(c, schema))) == 1 and one(spark, "none", lambda c: jsonx.array_after(c, schema)) == []
    assert one(spark, "a {'k': 'v'} b", jsonx.greedy_object) == '{"k": "v"}'


class Flaky:
    def complete(self, system, user):
        if "bad" in user:
            raise ValueError("no")
        return user.upper()


def test_models_and_rewrites(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "id int, p string")
    got = {r.id: (r.response, r.response_error) for r in P.apply_model(df, "p", Flaky()).collect()}
    assert got[1] == got[2] == ("A", None) and got[3] == (None, "ValueError: no") and got[4] == (None, None)
    s = R.version_scores(spark.createDataFrame([(1, True, False, True), (1, True, True, False)], "doc int, final_passed boolean, used_fallback boolean, ok boolean"), ["doc"]).collect()[0]
    assert (s.success_ratio, s.fallback_ratio, s.quality_label) == (0.5, 0.5, "Partially Successful")
    assert P.HashEmbedder().embed(["same text", "same text"]).std(axis=0).max() == 0
    assert [e[1] for e in P.PatternEntities().entities("In 1999 12% in Paris")] == ["DATE", "PERCENT", "GPE"]
    assert P.entity_rows(df, "p", P.PatternEntities()).count() == 0 and P.embed_column(df, "p", P.HashEmbedder()).filter("embedding is null").count() == 1


def test_evaluation(spark):
    df = spark.createDataFrame([("a", True, 1, 2, None), ("a", True, 2, 2, 0.5), ("b", False, 9, 9, 1.0)], "source string, evaluation_success boolean, global_problem_count int, sentence_problem_count int, semantic_similarity double")
    r = E.corpus_report(df).collect()[0]
    assert (r.total_news_evaluated, r.average_global_problems, r.avg_semantic_similarity) == (2, 1.5, 0.25)
    assert E.corpus_report(df.limit(0)).collect()[0].total_news_evaluated == 0
    t = E.tasks(df.select("source"), E.GLOBAL_PROBLEMS).withColumn("problem_exists", F.col("problem") == "style")
    assert {(x.source, x.problem): x.n for x in E.problem_counts(t, "source", "global").collect()} == {("a", "style"): 2, ("a", None): 2, ("b", "style"): 1, ("b", None): 1}


def test_sources(spark, tmp_path):
    (tmp_path / "v.json").write_text('[{"news_id": "n", "text": "T", "rewrites": [{"text": "a"}, {"summary": "b"}]}, {"id": "m", "rewritten_v2": "x", "final_text": "f"}, {"final_text": "f"}]')
    got = [tuple(r) for r in io.read_versions(spark, str(tmp_path / "v.json")).collect()]
    assert got == [("n", "T", "a", "b", ""), ("m", "", "", "x", ""), ("", "", "f", "", "")]
    (tmp_path / "t.json").write_text('["one", "two"]')
    assert [r.input_text for r in io.read_texts(spark, str(tmp_path / "t.json")).collect()] == ["one", "two"]
    (tmp_path / "n.json").write_text('{"id": "1", "content": " c "}')
    news = io.read_news(spark, str(tmp_path / "n.json"))
    assert [r.content for r in io.articles(news).collect()] == ["c"] and io.cleaned_news(news.withColumn("cleaned_content", F.lit(None).cast("string"))).collect()[0].content == " c "
    io.write_by_item(news.select("id", "content"), str(tmp_path / "out"), "id")
    assert (tmp_path / "out" / "id=1").exists() and io.head(news, 0, "id").count() == 1


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = feeds.stream_paragraphs(feeds.read_parquet_feed(spark, str(tmp_path / "in"), docs)).writeStream.format("memory").queryName("pars").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pars").count() == 2
