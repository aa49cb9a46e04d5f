import random

from newsloom.llm import repetition as R
from newsloom.llm import spans as S

SCHEMA = "fused_id bigint, input_text string, rewritten_v1 string, fused_content string, start int"


def brute(rows):
    where = {}
    for r in rows:
        for t in r[1:4]:
            for i in range(len(t or "") - S.LENGTH + 1):
                where.setdefault(t[i : i + S.LENGTH], set()).add(r[0])
    out = set()
    for r in rows:
        for name, t in zip(S.FIELDS, r[1:4]):
            on = [False] * (len(t or "") + 1)
            for i in range(len(t or "") - S.LENGTH + 1):
                if len(where[t[i : i + S.LENGTH]]) > 1:
                    on[i : i + S.LENGTH] = [True] * S.LENGTH
            start = None
            for i, x in enumerate(on):
                if x and start is None:
                    start = i
                elif not x and start is not None:
                    out.add((r[0], name, start, i))
                    start = None
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij 桥éก") for _ in range(n))
    a, b, c = text(700), text(199), text(200)
    rows = [
        (1, a, text(300), None, 0), (2, text(50) + a[100:400] + text(60), a[350:700], "", 0), (3, b, c, text(400), 0), (4, b + text(300), "x" + c + "y", a[0:250] + a[450:700], 0),
        (5, "ab" * 400, "", None, 0), (6, "ab" * 150, "short", None, 0), (7, a[300:560], a, a, 0), (7, a[300:560], a, a, 0),
    ]
    return rows + [(100 + i, text(120) + a[200:500] + text(120), None, None, 0) for i in range(8)]


def found(spark, rows):
    return {tuple(r) for r in S.shared_spans(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spark, rows) == brute(rows)
    for group in (1, 3):  # larger groups go window by window
        monkeypatch.setattr(S, "GROUP", group)
        assert found(spark, rows) == brute(rows)


def test_rows_come_through_chains(spark, monkeypatch):
    rows = corpus(1)
    monkeypatch.setattr(S, "GROUP", 10**6)
    assert found(spark, rows) == brute(rows)
    real = S.chains  # without chains nothing is found
    monkeypatch.setattr(S, "chains", lambda anchored, k=S.K, least=0.0: real(anchored, k, 1e9))
    assert found(spark, rows) == set()


def test_exact_runs_compare_characters():
    rng = random.Random(9)
    a = "".join(rng.choice("ab") for _ in range(900))
    b = a[:250] + "x" + a[251:600] + "yy" + a[600:]
    want = {(0, 0, 250), (251, 251, 349), (600, 602, 300)}
    at = [(x, x) for x in (100, 140, 300, 400, 480)] + [(x, x + 2) for x in (610, 700, 790)]
    assert set(S.exact_runs(at, S.codes_of(a), S.codes_of(b))) == want
    assert S.exact_runs([(0, 0)], S.codes_of("c" * 199), S.codes_of("c" * 199)) == []  # equal hashes don't make a span, characters do
    assert S.exact_runs([(100, 100)], S.codes_of("a" * 300), S.codes_of("a" * 150 + "b" * 150)) == []


def test_empty_and_null(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.shared_spans(df).count() == 0 and S.passages(df).count() == 0
    long = "".join(random.Random(5).choice("abcdef") for _ in range(400))
    assert found(spark, [(None, long, None, None, 0), (1, long, long, None, 0)]) == set()


def test_chain_and_align():
    anchors = [(0, 10), (100, 110), (500, 20), (220, 230)]
    best = S.chain(anchors)[0]
    assert best[1] == [0, 1, 3] and len(S.chain(anchors)) == 2
    assert S.identity("abc", "abc", [], 2) == 1.0 and S.identity("abcdefgh", "abcxefgh", [(0, 0), (4, 4)], 3) == 1 - 1 / 8
    assert abs(S.identity("a" * 5 + "b" * 40, "a" * 5 + "b" * 38, [(0, 0), (5, 5), (7, 5)], 5) - (1 - 2 / 45)) < 1e-9
    tree = S.Fenwick(4)
    tree.put(2, (5.0, 1))
    assert tree.get(2)[1] == -1 and tree.get(3) == (5.0, 1)


def test_passages(spark, monkeypatch):
    rows = S.passages(spark.createDataFrame(corpus(1), SCHEMA)).collect()
    assert rows and all(S.PASSAGE_IDENTITY <= r.identity <= 1.0 and r.score >= S.PASSAGE_SCORE and r.fused_id < r.other_id for r in rows)
    monkeypatch.setattr(S, "GROUP", 2)
    grouped = S.passages(spark.createDataFrame(corpus(1), SCHEMA)).collect()
    ends = lambda rs: {(r.fused_id, r.field_name) for r in rs} | {(r.other_id, r.other_field) for r in rs}
    assert ends(grouped) == ends(rows) and {r.linked_by for r in grouped} == {"pair", "group"}  # no text loses its last link


def test_recall_of_fuzzy_passages(spark):
    """Passages of 400 characters with an edit every 60 to 140 characters between unrelated texts."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))

    def edited(t):
        out, i = [], 0
        while i < len(t):
            j = i + rng.randrange(60, 140)
            out += [t[i:j], rng.choice(("", "X", "YZ"))]
            i = j + rng.choice((0, 1))
        return "".join(out)

    rows = []
    for i in range(60):
        p = text(400)
        rows += [(2 * i, text(200) + p + text(100), None, None, 0), (2 * i + 1, text(80) + edited(p) + text(250), None, None, 0)]
    rows += [(500 + i, text(600), None, None, 0) for i in range(40)]
    got = S.passages(spark.createDataFrame(rows, SCHEMA)).collect()
    hit = {r.fused_id // 2 for r in got if r.fused_id // 2 == r.other_id // 2}
    assert len(hit) >= 0.9 * 60 and all(r.fused_id // 2 == r.other_id // 2 for r in got)


def test_repeated_share():
    s = "the river rose by two metres in a night. "
    assert R.repeated(s) == (0, 31) and R.repeated(s * 3)[0] == 62
    assert R.repeated("The river rose 5 metres here\n" + "the RIVER  rose 17 metres here")[0] > 0
    assert R.repeated("甲乙丙丁戊己庚辛壬癸" * 2) == (10, 20) and R.repeated("甲乙丙丁戊己庚辛壬" * 2)[0] == 0
    assert R.repeated("") == R.repeated(" 12 \n") == (0, 0)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rng = random.Random(2)
    for _ in range(30):
        units = [rng.choice(words[:6]) for _ in range(40)]
        on = [False] * 40
        for i in range(36):
            if any(units[j : j + 5] == units[i : i + 5] for j in range(i)):
                on[i : i + 5] = [True] * 5
        assert R.repeated(" ".join(units))[0] == sum(len(u) for u, x in zip(units, on) if x)


def texts(spark, rows):
    return spark.createDataFrame(rows, "field_name string, row_id bigint, lang string, source string, text string")


def prose(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def test_outliers(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(70)]
    clean = [("f", i, "en", "s" if i % 3 else "S ", prose(rng, vocab, 60 + i % 40)) for i in range(90)]
    spam = [("f", 1000 + i, None if i % 2 else "en", "s", "buy these cheap boats right now today. " * 9 + prose(rng, vocab, 20)) for i in range(30)]
    slight = []
    for i in range(10):
        t = prose(rng, vocab, 80)
        slight.append(("f", 3000 + i, "en", "s", t + " " + " ".join(t.split()[:6])))
    rest = [("f", 2000, "en", "s", None), ("f", 2001, "en", "s", ""), ("f", 2002, "en", None, " \n"), spam[0]]
    df = texts(spark, clean + spam + slight + rest)
    got = {r.row_id: r for r in R.scored(df).collect()}
    assert len(got) == 130 and {i for i, r in got.items() if r.rejected and r.share >= 1 / 3} == {1000 + i for i in range(30)}
    # the estimate decides: few ordinary texts are rejected, and texts with a little repetition aren't all
    assert sum(got[i].rejected for i in range(90)) <= 9 and all(got[3000 + i].share > 0 for i in range(10)) and not all(got[3000 + i].rejected for i in range(10))
    assert {r.row_id for r in R.scored(df, every=False).collect()} == {i for i, r in got.items() if r.rejected}
    assert {r.row_id for r in R.repetitive(df).collect()} == {1000 + i for i in range(30)}
    monkeypatch.setattr(R, "CUTOFF", 1e18)  # without an outlier nothing is found, whatever the share
    assert R.repetitive(df).count() == 0


def test_without_estimate_every_text_is_checked(spark):
    assert R.scored(texts(spark, [])).count() == 0
    spam = [("f", i, "en", "s", "buy these cheap boats right now today. " * 9) for i in range(2)]
    small = R.scored(texts(spark, spam)).collect()
    assert all(r.rejected and r.distance2 is None for r in small) and R.repetitive(texts(spark, spam)).count() == 2


def test_smallest_determinant():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (140, 4)), rng.normal(9, 0.7, (60, 4))])  # three in ten are a group of outliers
    mean, cov, det = R.smallest_determinant(x)
    assert np.abs(mean).max() < 0.5 and np.isfinite(det) and R.smallest_determinant(x, starts=5)[2] >= det - 1e-9
    d = x - mean
    d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(R.HALF_FACTOR * cov), d)
    assert d2[140:].min() > 100 and (d2[:140] > R.CUTOFF).mean() < 0.1
    again = R.concentrate(x, mean, cov, 102)
    assert abs(again[2] - det) < 1e-6  # converged
