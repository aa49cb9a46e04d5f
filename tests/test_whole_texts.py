"""Operators over whole texts: nothing is cut, dropped by script or replaced by a shorter field."""

import random

from pyspark.sql import functions as F

from newsloom.functions import similarity
from newsloom.operators import evaluate as E
from newsloom.plans import reports

FUSED = "fused_id bigint, input_text string, rewritten_v1 string, rewritten_v2 string, rewritten_v3 string, fused_content string"


def brute_distance(a, b):
    """Plain dynamic programme of the edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_against_brute_force():
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh ", "洪水救援人员", "наводнение", "فيضان", "बाढ़", "น้ำท่วม", "é桥ж𝄞a"):
        for _ in range(40):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in "ab")
            assert similarity.edit_distance(a, b) == brute_distance(a, b), (a, b)
            assert similarity.edit_distance(a, a) == 0


def test_levenshtein_texts(spark, tmp_path):
    rng = random.Random(4)
    zh = "".join(rng.choice("洪水淹没了整个城区救援人员夜间疏散") for _ in range(700))
    zh2 = zh[:350] + "新" + zh[360:] + "。"
    th, ru = "น้ำท่วมเมืองทั้งหมดเมื่อคืนนี้", "Наводнение затопило город ночью"
    en = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    en2 = en[:400] + "ZZZ" + en[500:]
    rows = [(1, zh, zh2, " \n", zh, zh), (2, en2, th, None, en, en), (3, ru, ru + "!", th, "", ru), (4, "a", None, None, None, None)]
    spark.createDataFrame(rows, FUSED).write.parquet(f"{tmp_path}/fused_news.parquet")
    got = {(r.fused_id, r.version_id): r.similarity for r in reports.QUERIES["levenshtein_texts"](spark, str(tmp_path)).collect()}
    want = {}
    for i, *texts, fused in rows:
        for name, t in zip(("input_text", "rewritten_v1", "rewritten_v2", "rewritten_v3"), texts):
            if t is not None and fused is not None:
                want[(i, name)] = 0.0 if not t.strip() else round(1 - brute_distance(fused, t) / max(len(fused), len(t)), 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    long = spark.createDataFrame([(en, en2)], "a string, b string").select(E.similarity_columns(F.col("a"), F.col("b"))["levenshtein"].alias("l")).collect()[0].l
    assert abs(long - want[(2, "input_text")]) < 1e-6
