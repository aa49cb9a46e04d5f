import random

import numpy as np

from newsloom.llm import spans as S

SCHEMA = "fused_id bigint, input_text string, rewritten_v1 string, fused_content string"


def test_every_partner_is_chained(spark, monkeypatch):
    """Records 2 and 3 share a passage; record 1, first by id, holds only half of its seeds and records 4 and 5 are copies."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghij 桥éก") for _ in range(n))
    a, short = text(900), text(200)
    edited = "".join(a[i : i + 130] + "#" for i in range(0, 900, 130))
    two, three = text(80) + a + text(80), text(40) + edited + text(90)
    rows = [(1, text(200) + a[:450] + text(200), None, None), (2, two, two[:500] + "x", None), (3, None, three, ""), (4, two, None, None), (5, None, None, two), (6, short, None, None), (7, None, short + "z", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(1, 2), (1, 3), (2, 3), (6, 7)}
    for group in (S.GROUP, 2):
        monkeypatch.setattr(S, "GROUP", group)
        got = S.passages(df).collect()
        pairs = {(r.fused_id, r.other_id) for r in got}
        assert pairs == want if group > 2 else pairs <= want and {x for p in pairs for x in p} == {x for p in want for x in p}
        assert len({tuple(r) for r in got}) == len(got)
    monkeypatch.setattr(S, "GROUP", 16)
    got = S.passages(df).collect()
    best = lambda x, y: max(r.span_end - r.span_start for r in got if (r.fused_id, r.other_id) == (x, y))
    assert best(2, 3) > 800 and best(1, 3) > 270  # the ends may lack a seed
    assert {r.n_copies for r in got if r.fused_id == 2 and r.field_name == "input_text"} == {3}  # records 4 and 5 hold it too
    classes = {(r.rec, r.field): (r.of_rec, r.of_field, r.n_copies) for r in S.members(df).collect()}
    assert classes[(4, 0)] == classes[(5, 2)] == classes[(2, 0)] == (2, 0, 3) and classes[(2, 1)] == (2, 1, 1)


def anchored(n, seed):
    """Anchors of two texts that repeat themselves: a dense grid with gaps."""
    rng = random.Random(seed)
    return sorted({(rng.randrange(n) * 3, rng.randrange(n) * 3) for _ in range(n * n // 3)})


def test_rows_of_anchors_give_the_same_chains():
    for n, seed in ((1, 0), (6, 1), (25, 2), (40, 3)):
        at = anchored(n, seed) or [(0, 0)]
        a, b = (np.array(x, dtype=np.int64) for x in zip(*at))
        for k, gap in ((5, 1000), (40, 1000), (5, 12)):
            assert list(S.chain_rows(a, b, k, max_gap=gap)) == S.chain(at, k, max_gap=gap)


def whole(rows):
    """Every two distinct texts of different records, chained over all their common seeds."""
    first = {}
    for r in sorted(rows):
        for f, t in enumerate(r[1:4]):
            if t and len(t) >= S.PASSAGE_LENGTH:
                first.setdefault(t, (r[0], f))
    out, seeds = [], {w: S.seeds_of(S.codes_of(t), S.PASSAGE_LENGTH, S.PASSAGE_K) for t, w in first.items()}
    text = {w: t for t, w in first.items()}
    for x in seeds:
        for y in seeds:
            if x[0] < y[0]:
                at = sorted((int(p), int(q)) for p, h in zip(*seeds[x]) for q, g in zip(*seeds[y]) if h == g)
                for score, m in S.chain(at, S.PASSAGE_K):
                    (a, b), (c, d) = at[m[0]], at[m[-1]]
                    c, d = c + S.PASSAGE_K, d + S.PASSAGE_K
                    same = S.identity(text[x][a:c], text[y][b:d], [(at[i][0] - a, at[i][1] - b) for i in m], S.PASSAGE_K)
                    if score >= S.PASSAGE_SCORE and same >= S.PASSAGE_IDENTITY:
                        out.append((x[0], S.FIELDS[x[1]], a, c, y[0], S.FIELDS[y[1]], b, d, len(m), round(score, 6), round(same, 9)))
    return sorted(out)


def test_large_groups_lose_no_pair(spark, monkeypatch):
    """40 texts share a passage (edited in some), the first of them holds a part of it only, two more repeat themselves, and 20 share a sentence."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij 桥éก") for _ in range(n))
    a, s = text(400), text(90)
    parts = lambda i: a[:120] if i == 1 else a[:150] + ("#" if i % 3 else "") + a[150:260] + ("" if i % 5 else "!!") + a[260:]
    rows = [(i, text(60) + parts(i) + text(50), text(150) + s + text(9) if i <= 20 else None, text(100)) for i in range(1, 41)]
    rows += [(50, "ab" * 90 + text(50), None, "-" * 130 + a[:200]), (51, text(30) + "ab" * 60, "", text(70) + "-" * 100)]
    want = whole(rows)
    for group in (16, 2):
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "BLOCK", 256 if group > 2 else 7)
        got = S.passages(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((*r[:9], round(r.score, 6), round(r.identity, 9)) for r in got) == want
        pairs = {(r.fused_id, r.other_id) for r in got if r.field_name == r.other_field == "input_text"}
        assert {(i, j) for i in range(1, 41) for j in range(i + 1, 41)} <= pairs and (50, 51) in pairs
        assert {r.linked_by for r in got if r.fused_id == 2 and r.other_id == 3} == {"group"}


def test_texts_of_a_chain_meet():
    """Seeds of two texts at random distances: wherever a chain reaches the score, the texts have a key that is long in one of them."""
    rng, found, keyed = random.Random(1), 0, lambda x, of, keys, long: dict(zip(keys[of == x].tolist(), long[of == x].tolist()))
    for _ in range(4000):
        n = rng.randrange(2, 9)
        steps = [rng.choice([rng.randrange(1, 15), rng.randrange(80, 145), rng.randrange(1, 60), rng.randrange(1, 200)]) for _ in range(n)]
        a, b = np.cumsum(steps), np.cumsum([max(1, x + rng.choice([0, 0, 0, rng.randrange(-20, 21)])) for x in steps])
        h = np.array([rng.getrandbits(63) for _ in range(n)])
        if rng.random() < 0.5:
            h[rng.randrange(n)] = h[0]
        i, j = S.common(h, h)
        score = max(x for x, _ in S.chain(list(zip(a[i].tolist(), b[j].tolist())), S.PASSAGE_K))
        if score >= S.PASSAGE_SCORE:
            got = S.keys_of(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([h, h]), S.PASSAGE_K, S.PASSAGE_SCORE - S.PASSAGE_K)
            one, other = keyed(0, *got), keyed(1, *got)
            assert any(one[x] or other[x] for x in one.keys() & other.keys())
            found += 1
    assert found > 2000
    for t in ("ab" * 400, "-" * 900):  # a text that repeats itself has few keys
        pos, h = S.seeds_of(S.codes_of(t), S.PASSAGE_LENGTH, S.PASSAGE_K)
        assert {x for _, x, y in zip(*S.keys_of(np.repeat([0, 1], len(pos)), np.tile(pos, 2), np.tile(h.view(np.int64), 2), S.PASSAGE_K, 20.0)) if y} and len(pos) > 300
