"""Long exact spans and fuzzy passages shared between records, by k-mer seeds, collinear chains and alignment.

1. ``seeds``: each text keeps the k-mers that are the smallest by hash in some window of ``LENGTH - K + 1`` k-mers, so
   every stretch of ``LENGTH`` characters that two texts share holds a seed that both of them kept.
2. ``anchors``: seeds meet by content. For exact spans a seed of up to ``GROUP`` places joins each two of its places in
   different records, so a place has a bounded number of partners (5 has the rest). For passages the texts meet by
   ``linked``, two or three seeds close to each other, without which no chain reaches ``PASSAGE_SCORE``: so each two
   texts that can have a passage are chained over all their common seeds, however many texts a seed stands in.
3. ``chain``: the anchors of two texts are chained in the order of both, with gap costs, through Fenwick trees for prefix
   maxima, or through whole rows of them where the texts repeat themselves.
4. Alignment: for exact spans the characters of both texts are compared along the diagonals of a chain's anchors
   (``exact_runs``), and runs of at least ``LENGTH`` are kept; passages get the identity of a banded alignment
   (``identity``).
5. For exact spans, seeds of more than ``GROUP`` places (a passage in a third of all records) have too many partners to
   chain. There every window of ``LENGTH`` characters around a place is a key of a hash aggregation, by two independent
   64-bit hashes; a window is shared if two records have it. So no link is lost and no pairs of a large group are formed.

Scale: seeds are one position in about fifty and are written once; counting them is a partial aggregation, and only
seeds of at least two records go on. Texts are joined with chains by their record, and Spark picks the side to move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.similarity import edit_distance
from newsloom.sources.session import cut, small_batches, spread, table

FIELDS = ("input_text", "rewritten_v1", "fused_content")
LENGTH = 200
K = 100
#: The same for fuzzy passages, which are seeded more densely so that edits leave seeds.
PASSAGE_LENGTH = 80
PASSAGE_K = 40
#: A chain with a lower score or identity is no passage.
PASSAGE_SCORE = 60.0
PASSAGE_IDENTITY = 0.8
#: Places of a seed up to which all of them are joined with each other for exact spans.
GROUP = 16
SALTS = 16
#: Texts of a link that meet the others of it in one task.
BLOCK = 256
#: Anchors for each seed of a text above which ``chain_rows`` chains them.
DENSE = 8
#: Texts are hashed in pieces of this many characters; positions inside a piece fit the low bits of a sort key.
PIECE = 1 << 20
#: Chains: weight of a seed, cost of a skipped or shifted character, and the longest gap bridged.
GAP_COST = 0.2
MAX_GAP = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base & _MASK, dtype=np.uint64))


_POW = {b: _powers(1 << 16, b) for b in (_BASE, pow(_BASE, -1, 1 << 64))}


def powers(n: int, base: int) -> np.ndarray:
    """base**1 .. base**n modulo 2**64, grown as needed."""
    if len(_POW[base]) < n:
        _POW[base] = _powers(1 << (n - 1).bit_length(), base)
    return _POW[base][:n]


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k characters; equal characters give equal hashes wherever they stand."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    c = (codes.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xC2B2AE3D27D4EB4F)
    c ^= c >> np.uint64(32)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(c * powers(n, _BASE), out=total[1:])
    h = (total[k:] - total[:-k]) * powers(n - k + 1, pow(_BASE, -1, 1 << 64))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def minima(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each window of ``w`` values."""
    n = len(values) - w + 1
    pad = -len(values) % w
    v = np.concatenate([values, np.full(pad, _MASK, dtype=np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def seeds_of(codes: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a text's seeds, ascending; none in a text shorter than ``length``."""
    w = length - k + 1
    at, found = [], []
    for start in range(0, max(len(codes) - length + 1, 0), PIECE - length + 1):
        h = hashes(codes[start : start + PIECE], k)
        low = np.uint64(PIECE - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        pos = np.unique((minima(key, w) & low).astype(np.int64))
        at.append(pos + start), found.append(h[pos])
    if not at:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    pos, first = np.unique(np.concatenate(at), return_index=True)
    return pos, np.concatenate(found)[first]


def seeds(records: DataFrame, id_col: str, fields: tuple[str, ...], length: int = LENGTH, k: int = K) -> DataFrame:
    """``(h, rec, field, pos)``: the seeds of every field of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rec, field, pos, h = [], [], [], []
            for f in range(len(fields)):
                for i, text in zip(ids, batch.column(f + 1).to_pylist()):
                    if text is not None and len(text) >= length:
                        p, x = seeds_of(codes_of(text), length, k)
                        rec.append(np.full(len(p), i)), field.append(np.full(len(p), f)), pos.append(p), h.append(x)
            cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(h, np.uint64).view(np.int64)), pa.array(cat(rec, np.int64)), pa.array(cat(field, np.int8)), pa.array(cat(pos, np.int32))], names=["h", "rec", "field", "pos"]
            )

    return spread(records.select(F.col(id_col).cast("bigint"), *fields).filter(F.col(id_col).isNotNull())).mapInArrow(run, "h bigint, rec bigint, field byte, pos int")


def shared_seeds(found: DataFrame) -> DataFrame:
    """``(h, n, rec, field, pos, first)``: the places of seeds that stand in at least two records, with their number and first place.

    Counts are copied under ``SALTS`` salts, so that the places of one seed meet them in as many tasks.
    """
    place = F.struct("rec", "field", "pos")
    counted = found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max("rec").alias("last")).filter("first.rec < last")
    salted = counted.select("h", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.withColumn("salt", F.pmod(F.hash("rec", "field", "pos"), F.lit(SALTS))).join(salted, ["h", "salt"]).select("h", "n", "rec", "field", "pos", "first")


def anchors(shared: DataFrame) -> DataFrame:
    """``(rec, field, p_rec, p_field, anchors)``: each two texts of different records with all places of their common seeds of up to ``GROUP`` places.

    The text with the smaller key comes first; the anchors of two texts are bounded by their lengths.
    """
    place = F.struct("rec", "field", "pos")
    few = shared.filter(F.col("n") <= GROUP).groupBy("h").agg(F.sort_array(F.collect_list(place)).alias("p"))
    two = few.select(F.explode("p").alias("a"), "p").select("a", F.explode("p").alias("b")).filter("a.rec < b.rec")
    keys = ["rec", "field", "p_rec", "p_field"]
    rows = two.select("a.rec", "a.field", F.col("b.rec").alias("p_rec"), F.col("b.field").alias("p_field"), F.col("a.pos").alias("pos"), F.col("b.pos").alias("p_pos"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "p_pos"))).alias("anchors"))


class Fenwick:
    """Prefix maxima of (score, index) by rank."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank] = value
            rank += rank & -rank

    def get(self, rank: int) -> tuple[float, int]:
        """Largest of the ranks below ``rank``."""
        best = (float("-inf"), -1)
        while rank > 0:
            best = max(best, self.best[rank])
            rank -= rank & -rank
        return best


def chain(anchors: list[tuple[int, int]], k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[tuple[float, list[int]]]:
    """Collinear chains of anchors (position in a, position in b), each anchor in one chain: (score, indexes).

    The score of a chain is k for each anchor, less what overlaps the one before, less ``gap_cost`` for each
    character by which the gaps in a and b exceed the anchors. In the order of a, the best predecessor of an anchor
    is a prefix maximum over positions in b of score + gap_cost * (a + b). Chains break at gaps over ``max_gap``.
    """
    order = sorted(range(len(anchors)), key=lambda i: anchors[i])
    rank = {b: r for r, b in enumerate(sorted({b for _, b in anchors}))}
    tree = Fenwick(len(rank))
    score, before = [0.0] * len(anchors), [-1] * len(anchors)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and anchors[order[j]][0] == anchors[order[i]][0]:
            j += 1
        for x in order[i:j]:  # anchors at one position of a don't precede each other
            a, b = anchors[x]
            top, p = tree.get(rank[b])
            score[x] = float(k)
            if p >= 0:
                pa_, pb = anchors[p]
                da, db = a - pa_, b - pb
                gain = min(k, da, db) - gap_cost * (max(0, da - k) + max(0, db - k)) - gap_cost * abs(da - db)
                if da <= max_gap and db <= max_gap and score[p] + gain > score[x]:
                    score[x], before[x] = score[p] + gain, p
        for x in order[i:j]:
            a, b = anchors[x]
            tree.put(rank[b], (score[x] + gap_cost * (a + b), x))
        i = j
    return list(paths(sorted(range(len(anchors)), key=lambda x: (-score[x], anchors[x])), score, before, k))


def paths(best: Sequence[int], score: Sequence[float], before: Sequence[int], k: int) -> Iterator[tuple[float, list[int]]]:
    """The chains that ``before`` leads through, from the ends in the order of ``best``; each anchor in one of them."""
    used = bytearray(len(best))
    for x in best:
        members, y = [], x
        while y >= 0 and not used[y]:
            members.append(y)
            used[y] = 1
            y = before[y]
        if members:  # where a better chain has the rest, the first anchor counts in full
            yield float(score[x] - (score[members[-1]] - k if y >= 0 else 0.0)), members[::-1]


def chain_rows(a: np.ndarray, b: np.ndarray, k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> Iterator[tuple[float, list[int]]]:
    """The chains of ``chain`` for anchors in ascending order: all anchors at one position of a are taken at once, over an array of all ranks.

    Where texts repeat themselves their anchors are many more than their positions.
    """
    n = len(a)
    values, rank = np.unique(b, return_inverse=True)
    top, last = np.full(len(values) + 1, -np.inf), np.full(len(values) + 1, -1, dtype=np.int64)  # best value and anchor of each rank, after a first that has none
    score, before = np.full(n, float(k)), np.full(n, -1, dtype=np.int32)
    edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    for i, j in zip(edges[:-1], edges[1:]):
        r = rank[i:j]
        highest = np.maximum.accumulate(top)
        new = np.cumsum(np.r_[False, highest[1:] > highest[:-1]])  # of equal values the last anchor counts
        p = (np.maximum.accumulate(np.where(top == highest, last, -1) + new * (n + 1) + 1) - new * (n + 1) - 1)[r]
        has = np.flatnonzero(p >= 0)
        q = p[has]
        da, db = a[i] - a[q], b[i:j][has] - b[q]
        gain = np.minimum(np.minimum(k, da), db) - gap_cost * (np.maximum(0, da - k) + np.maximum(0, db - k)) - gap_cost * np.abs(da - db)
        better = (da <= max_gap) & (db <= max_gap) & (score[q] + gain > k)
        score[i + has[better]], before[i + has[better]] = (score[q] + gain)[better], q[better]
        value = score[i:j] + gap_cost * (a[i] + b[i:j])
        win = value >= top[r + 1]
        top[r[win] + 1], last[r[win] + 1] = value[win], np.arange(i, j)[win]
    return paths(memoryview(np.lexsort((b, a, -score))), memoryview(score), memoryview(before), k)


CHAIN_SCHEMA = "rec bigint, field byte, start int, end int, p_rec bigint, p_field byte, p_start int, p_end int, score double, anchors array<struct<pos: int, p_pos: int>>"


def chains(anchored: DataFrame, k: int = K, least: float = 0.0) -> DataFrame:
    """Collinear chains of each two linked texts (``CHAIN_SCHEMA``) with a score of at least ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec, field, p_rec, p_field, mine in pdf.itertuples(index=False):
                at = [(x["pos"], x["p_pos"]) for x in mine]
                for score, members in chain(at, k):
                    if score >= least:
                        (a, b), (c, d) = at[members[0]], at[members[-1]]
                        rows.append((rec, field, a, c + k, p_rec, p_field, b, d + k, score, [{"pos": at[i][0], "p_pos": at[i][1]} for i in members]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAIN_SCHEMA.split(", ")[:9]] + ["anchors"])

    return anchored.mapInPandas(run, CHAIN_SCHEMA)


def keys_of(text: np.ndarray, pos: np.ndarray, h: np.ndarray, k: int, need: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, whether it is a long one): the twos and threes of seeds by which ``linked`` finds partners, each key of a text once.

    ``text`` and, in a text, ``pos`` ascend. Gains of at least ``need``, above 0 and above ``-need`` ask for distances up
    to ``near`` of them. Twos are long from ``need`` to ``near(need)``. Threes are made of twos that aren't, and long if
    they reach over more than ``k``: where a text has a long two, its partners have the same two, long or not.
    """
    near = lambda least: (k * (1 + 2 * GAP_COST) - least) / (2 * GAP_COST)
    h = h.astype(np.int64).view(np.uint64)
    place = (text.astype(np.int64) << 32) + pos
    i, j, d = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for step in range(1, len(pos)):
        apart = place[step:] - place[:-step]
        at = np.flatnonzero(apart <= near(-need))
        if not len(at):
            break
        i.append(at), j.append(at + step), d.append(apart[at])
    i, j, d = np.concatenate(i), np.concatenate(j), np.concatenate(d)
    mix = lambda x, y: (x ^ (x >> np.uint64(29))) * np.uint64(_BASE) + y
    long = (d >= need) & (d <= near(need))
    of, keys = [text[i]], [mix(h[i], h[j])]
    first, then = ~long & (d <= near(0)), ~long
    begin, middle, d1, follow, end, d2 = i[first], j[first], d[first], i[then], j[then], d[then]
    if np.bincount(middle, minlength=len(h)) @ np.bincount(follow, minlength=len(h)) > 1 << 21:
        if text[0] != text[-1]:  # text by text
            parts = [keys_of(text[x], pos[x], h[x].view(np.int64), k, need) for x in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        one, other = (np.unique(np.stack([h[x].view(np.int64), h[y].view(np.int64), z]), axis=1) for x, y, z in ((begin, middle, d1), (follow, end, d2)))
        x, y = common(one[1], other[0])  # the text repeats itself: equal twos count once, wherever they stand
        three, reach = mix(mix(one[0][x].view(np.uint64), one[1][x].view(np.uint64)), other[1][y].view(np.uint64)), one[2][x] + other[2][y]
        of.append(np.full(len(x), text[0]))
    else:
        x, y = common(middle, follow)
        three, reach = mix(mix(h[begin[x]], h[middle[x]]), h[end[y]]), d1[x] + d2[y]
        of.append(text[begin[x]])
    of, keys, long = np.concatenate(of), np.concatenate([*keys, three ^ np.uint64(_MASK >> 1)]), np.r_[long, reach > k]
    order = np.lexsort((~long, keys, of))
    of, keys, long = of[order], keys[order], long[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])][: len(keys)])
    return of[new], keys[new].view(np.int64), long[new]


def linked(held: DataFrame, k: int, least: float) -> DataFrame:
    """``(rec, field, p_rec, p_field)``: each two texts of different records that can have a chain of score ``least``, above ``k``.

    ``held`` has the shared seeds of each text (``rec``, ``field``, ``pos``, ``h``). A chain's anchors after its lowest
    gain ``least - k`` in all and never fall back to none. Anchors that lie within ``k`` characters gain no more step by
    step than the last of them right after the first. With each such run taken as one step, either one step gains
    ``least - k``, or the first two reach over more than ``k`` in one of the texts, the first gains something and both
    together do. So the texts share two seeds, or three, within the distances of ``keys_of``, long in one of the texts.
    Texts meet by the hashes of these; in blocks of about ``BLOCK``, so that a key of many texts
    makes its pairs in many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                of, key, long = keys_of(np.repeat(np.arange(len(pdf)), pdf["pos"].map(len)), np.concatenate(pdf["pos"].tolist()), np.concatenate(pdf["h"].tolist()), k, least - k)
                yield pd.DataFrame({"l": key, "long": long, "rec": pdf["rec"].to_numpy()[of], "field": pdf["field"].to_numpy()[of]})

    links = cut(held.select("rec", "field", "pos", "h").mapInPandas(run, "l bigint, long boolean, rec bigint, field byte"), "links")
    counted = links.groupBy("l").agg(F.count("*").alias("n"), F.min("rec").alias("first"), F.max("rec").alias("last"), F.max("long").alias("any")).filter("first < last and any")
    places = links.join(counted.select("l", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "l")
    left = places.filter("long").select("l", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct("rec", "field").alias("a"))
    right = places.select("l", F.pmod(F.hash("rec", "field"), "blocks").alias("block"), F.struct("rec", "field").alias("b"), F.col("long").alias("p_long"))
    met = left.join(right, ["l", "block"]).filter("a.rec < b.rec or a.rec > b.rec and not p_long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.select("a.rec", "a.field", F.col("b.rec").alias("p_rec"), F.col("b.field").alias("p_field")).distinct()


def common(h: np.ndarray, p_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in both arrays of each two equal values, in the order of the first and then the second."""
    order = np.argsort(p_h, kind="stable")
    low, high = np.searchsorted(p_h[order], h, "left"), np.searchsorted(p_h[order], h, "right")
    n = high - low
    i = np.repeat(np.arange(len(h)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]]


def bends(at: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """A chain's anchors without those inside a stretch of overlapping ones on one diagonal, where the texts are equal."""
    out: list[tuple[int, int]] = []
    inside = lambda p, q: q[0] - p[0] == q[1] - p[1] and q[0] - p[0] <= k
    for i, x in enumerate(at):
        if not (0 < i < len(at) - 1 and inside(at[i - 1], x) and inside(x, at[i + 1])):
            out.append(x)
    return out


PAIR_SCHEMA = "rec bigint, field byte, start int, end int, p_rec bigint, p_field byte, p_start int, p_end int, n_seeds int, score double, many boolean, anchors array<struct<pos: int, p_pos: int>>"


def chains_of_pairs(pairs: DataFrame, held: DataFrame, k: int, least: float) -> DataFrame:
    """Chains over all common seeds of each two texts (``PAIR_SCHEMA``) with a score of at least ``least``.

    ``held`` has the shared seeds of each text as arrays ``pos``, ``h`` and ``many`` (whether the seed has more than
    ``GROUP`` places); ``many`` of a chain tells whether one of its seeds has. ``anchors`` are its ``bends``.
    """
    names = [c.split()[0] for c in PAIR_SCHEMA.split(", ")[:11]] + ["anchors"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec, field, p_rec, p_field, pos, h, many, p_pos, p_h in pdf.itertuples(index=False):
                i, j = common(h, p_h)
                a, b = pos[i].astype(np.int64), p_pos[j].astype(np.int64)
                rich = np.asarray(many, dtype=bool)[i]
                for score, members in chain_rows(a, b, k) if len(i) > DENSE * len(pos) else chain(list(zip(a.tolist(), b.tolist())), k):
                    if score >= least:
                        at = bends([(int(a[x]), int(b[x])) for x in members], k)
                        (x, y), (z, w) = at[0], at[-1]
                        rows.append((rec, field, x, z + k, p_rec, p_field, y, w + k, len(members), score, bool(rich[members].any()), [{"pos": p, "p_pos": q} for p, q in at]))
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    other = held.select(F.col("rec").alias("p_rec"), F.col("field").alias("p_field"), F.col("pos").alias("p_pos"), F.col("h").alias("p_h"))
    both = pairs.join(held, ["rec", "field"]).join(other, ["p_rec", "p_field"])
    return both.select("rec", "field", "p_rec", "p_field", "pos", "h", "many", "p_pos", "p_h").mapInPandas(run, PAIR_SCHEMA)


def with_texts(chained: DataFrame, texts: DataFrame, reach: int = 0) -> DataFrame:
    """``chained`` with the passages' characters and ``reach`` more on either side (``text``, ``p_text``), starting at ``at`` and ``p_at``.

    ``texts`` is ``(rec, texts)``. A record in several rows gives each of them.
    """
    low = lambda c: F.greatest(F.col(c) - reach, F.lit(0))
    piece = lambda f, a, b: F.substring(F.get("texts", F.col(f).cast("int")), low(a) + 1, F.col(b) + reach - low(a))
    left = chained.join(texts, "rec").withColumn("text", piece("field", "start", "end")).drop("texts")
    both = left.join(texts.withColumnRenamed("rec", "p_rec"), "p_rec").withColumn("p_text", piece("p_field", "p_start", "p_end")).drop("texts")
    return both.filter("text is not null and p_text is not null").withColumn("at", low("start")).withColumn("p_at", low("p_start"))


def exact_runs(at: list[tuple[int, int]], a: np.ndarray, b: np.ndarray, length: int = LENGTH, k: int = K) -> list[tuple[int, int, int]]:
    """(start in a, start in b, size) of the runs of at least ``length`` equal characters along the anchors' diagonals.

    ``at`` holds the anchors' places in the pieces ``a`` and ``b``. Each anchor's run is looked for ``length - k``
    characters to either side, which every window of ``length`` characters around it needs.
    """
    out, reach = [], length - k
    by: dict[int, list[int]] = {}
    for x, y in at:
        by.setdefault(y - x, []).append(x)
    for d, places in by.items():
        end = -1
        spans: list[list[int]] = []
        for x in sorted(places):
            low, high = max(x - reach, 0, -d), min(x + k + reach, len(a), len(b) - d)
            if spans and low <= end:
                spans[-1][1] = max(end, high)
            else:
                spans.append([low, high])
            end = spans[-1][1]
        for low, high in spans:
            if high - low >= length:
                same = np.flatnonzero(np.r_[True, a[low:high] != b[low + d : high + d], True])
                for i in np.flatnonzero(np.diff(same) > length):
                    out.append((low + int(same[i]), low + int(same[i]) + d, int(same[i + 1] - same[i]) - 1))
    return out


SPAN_SCHEMA = "rec bigint, field byte, start int, end int"


def spans_in_chains(pieces: DataFrame) -> DataFrame:
    """The exact spans of both texts of each chain with its characters, ``SPAN_SCHEMA``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                at = [(y["pos"] - x.at, y["p_pos"] - x.p_at) for y in x.anchors]
                for a, b, size in exact_runs(at, codes_of(x.text), codes_of(x.p_text)):
                    rows.append((x.rec, x.field, x.at + a, x.at + a + size))
                    rows.append((x.p_rec, x.p_field, x.p_at + b, x.p_at + b + size))
            yield pd.DataFrame(rows, columns=["rec", "field", "start", "end"])

    return pieces.select("rec", "field", "p_rec", "p_field", "anchors", F.col("at"), "p_at", "text", "p_text").mapInPandas(run, SPAN_SCHEMA)


def spans_by_window(many: DataFrame, texts: DataFrame) -> DataFrame:
    """The exact spans around the places ``(rec, field, pos)`` of seeds with many places: windows that two records have."""
    reach = LENGTH - K

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec, field, pos, texts in pdf.itertuples(index=False):
                text = texts[field]
                if text is None:
                    continue
                start = max(0, pos - reach)
                c = codes_of(text[start : pos + LENGTH])
                a, b = hashes(c, LENGTH), hashes(c[::-1], LENGTH)[::-1]
                rows.append(pd.DataFrame({"h1": a.view(np.int64), "h2": b.view(np.int64).copy(), "rec": rec, "field": field, "start": start + np.arange(len(a))}))
            if rows:
                yield pd.concat(rows)

    places = many.select("rec", "field", "pos").join(texts, "rec").select("rec", "field", "pos", "texts")
    windows = cut(places.mapInPandas(explode, "h1 bigint, h2 bigint, rec bigint, field byte, start int").distinct(), "windows")
    shared = windows.groupBy("h1", "h2").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).filter("a < b")
    return windows.join(shared, ["h1", "h2"], "left_semi").select("rec", "field", "start", (F.col("start") + LENGTH).alias("end"))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Maximal runs of each text from overlapping or touching spans; a text's spans are bounded by its length."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def merged(parts: pd.Series) -> pd.Series:
        out = []
        for spans in parts:
            got: list[dict] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if got and a <= got[-1]["end"]:
                    got[-1]["end"] = max(b, got[-1]["end"])
                else:
                    got.append({"start": a, "end": b})
            out.append(got)
        return pd.Series(out)

    grouped = spans.groupBy("rec", "field").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    return grouped.select("rec", "field", F.explode(merged("parts")).alias("r")).select("rec", "field", "r.start", "r.end")


def shared_spans(records: DataFrame, id_col: str = "fused_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(id_col, field_name, span_start, span_end)``: maximal runs of characters that stand in a stretch of at least
    ``LENGTH`` characters which occurs verbatim in some field of another record.

    Null fields, texts shorter than ``LENGTH`` and rows with a null id give nothing; repeated rows of one id share
    with other ids only, and count once.
    """
    small_batches(records.sparkSession)
    shared = cut(shared_seeds(cut(seeds(records, id_col, fields), "seeds")), "shared")
    texts = records.select(F.col(id_col).cast("bigint").alias("rec"), F.array(*fields).alias("texts"))
    small = chains(anchors(shared))
    found = spans_in_chains(with_texts(small, texts, LENGTH - K)).unionByName(spans_by_window(shared.filter(F.col("n") > GROUP), texts))
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field").cast("int") + 1)
    return merge_runs(found).select(F.col("rec").alias(id_col), name.alias("field_name"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def members(records: DataFrame, id_col: str = "fused_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(rec, field, of_rec, of_field, n_copies)``: the class of equal texts that each text of at least ``PASSAGE_LENGTH`` characters belongs to.

    A class is named by its first text. Null texts and rows with a null id belong to none; a repeated id counts once.
    """
    base = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("rec"), *fields).dropDuplicates(["rec"])
    stack = ", ".join(f"cast({i} as byte), if(length({f}) >= {PASSAGE_LENGTH}, sha2({f}, 256), null)" for i, f in enumerate(fields))
    long = base.selectExpr("rec", f"stack({len(fields)}, {stack}) as (field, digest)").filter("digest is not null")
    classes = long.groupBy("digest").agg(F.min(F.struct("rec", "field")).alias("first"), F.count("*").alias("n_copies"))
    return long.join(classes, "digest").select("rec", "field", F.col("first.rec").alias("of_rec"), F.col("first.field").alias("of_field"), "n_copies")


def passages(records: DataFrame, id_col: str = "fused_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Fuzzy passages between distinct texts of different records: chains of score ``PASSAGE_SCORE`` and identity ``PASSAGE_IDENTITY`` or more.

    Copies of a text are one class (``members``); a row stands for all members of the two classes it names by their
    first texts, and ``n_copies`` and ``other_copies`` tell how many there are. Each two classes are compared over all
    their common seeds; ``linked_by`` is ``group`` where one of the passage's seeds stands at more than ``GROUP``
    places, else ``pair``. Empty and short texts have no passages.
    """
    small_batches(records.sparkSession)
    base = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("rec"), *fields).dropDuplicates(["rec"])
    own = cut(members(records, id_col, fields).filter("rec = of_rec and field = of_field").select("rec", "field", "n_copies"), "classes")
    chosen = own.groupBy("rec").agg(F.collect_list("field").alias("chosen"))
    distinct = base.join(chosen, "rec").select("rec", *[F.when(F.array_contains("chosen", F.lit(i).cast("byte")), F.col(f)).alias(f) for i, f in enumerate(fields)])
    shared = cut(shared_seeds(cut(seeds(distinct, "rec", fields, PASSAGE_LENGTH, PASSAGE_K), "seeds")), "shared")
    texts = distinct.select("rec", F.array(*fields).alias("texts"))

    @F.pandas_udf("double")
    def same(a: pd.Series, b: pd.Series, at: pd.Series, p_at: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([identity(x, y, [(z["pos"] - i, z["p_pos"] - j) for z in c], PASSAGE_K) for x, y, i, j, c in zip(a, b, at, p_at, anchors)], dtype="float64")

    held = shared.groupBy("rec", "field").agg(F.sort_array(F.collect_list(F.struct("pos", "h", (F.col("n") > GROUP).alias("many")))).alias("s"))
    held = cut(held.select("rec", "field", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"), F.col("s.many").alias("many")), "held")
    chained = cut(chains_of_pairs(linked(held, PASSAGE_K, PASSAGE_SCORE), held, PASSAGE_K, PASSAGE_SCORE), "chains")
    rows = with_texts(chained, texts).withColumn("identity", same("text", "p_text", "at", "p_at", "anchors")).filter(F.col("identity") >= PASSAGE_IDENTITY)
    rows = rows.withColumn("linked_by", F.when(F.col("many"), "group").otherwise("pair"))
    rows = rows.join(own, ["rec", "field"]).join(own.select(F.col("rec").alias("p_rec"), F.col("field").alias("p_field"), F.col("n_copies").alias("other_copies")), ["p_rec", "p_field"])
    name = F.array(*[F.lit(f) for f in fields])
    return rows.select(
        F.col("rec").alias(id_col), F.element_at(name, F.col("field").cast("int") + 1).alias("field_name"), F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.col("p_rec").alias("other_id"), F.element_at(name, F.col("p_field").cast("int") + 1).alias("other_field"), F.col("p_start").alias("other_start"), F.col("p_end").alias("other_end"),
        "n_seeds", "score", "identity", "linked_by", "n_copies", "other_copies",
    )


def identity(a: str, b: str, at: list[tuple[int, int]], k: int) -> float:
    """1 less the edit distance over the longer length, aligned through the chain: exact between anchors, nothing crosses them.

    The stretches between anchors are short (at most ``MAX_GAP``), so the work is linear in the passage.
    """
    if a == b:
        return 1.0
    x = y = edits = 0
    for p, q in at:
        if p >= x and q >= y:  # an anchor that overlaps the one before on another diagonal is left to the next gap
            edits += edit_distance(a[x:p], b[y:q])
            x, y = p + k, q + k
        elif p - x == q - y:
            x, y = p + k, q + k
    edits += edit_distance(a[x:], b[y:])
    return 1 - edits / max(len(a), len(b), 1)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "fused_news"))


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "fused_news"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the class of equal texts that ``p5_passages`` names, and the number of its members."""
    name = F.array(*[F.lit(f) for f in FIELDS])
    of = lambda c: F.element_at(name, F.col(c).cast("int") + 1)
    return members(table(spark, sf_dir, "fused_news")).select(F.col("rec").alias("fused_id"), of("field").alias("field_name"), F.col("of_rec").alias("class_id"), of("of_field").alias("class_field"), "n_copies")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each text that stands elsewhere too; 0 for a text that shares nothing, no row for a null text."""
    records = table(spark, sf_dir, "fused_news")
    spans = shared_spans(records).groupBy("fused_id", "field_name").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    stack = ", ".join(f"'{f}', length({f})" for f in FIELDS)
    lengths = records.selectExpr("fused_id", f"stack({len(FIELDS)}, {stack}) as (field_name, n_chars)").filter("n_chars is not null").groupBy("fused_id", "field_name").agg(F.max("n_chars").cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return lengths.join(spans, ["fused_id", "field_name"], "left").select("fused_id", "field_name", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_passages": p5_passages, "p5_classes": p5_classes, "p5_shares": p5_shares}

#: The definitions in SQL: all windows of ``LENGTH`` characters, and classes of equal texts.
SQL = {
    "p5_found": """
    WITH field AS (SELECT fused_id, unnest(['input_text', 'rewritten_v1', 'fused_content']) AS field_name, unnest([input_text, rewritten_v1, fused_content]) AS t FROM (SELECT DISTINCT fused_id, input_text, rewritten_v1, fused_content FROM fused_news)),
    place AS (SELECT fused_id, field_name, t, unnest(range(length(t) - 199)) AS i FROM field WHERE length(t) >= 200),
    win AS (SELECT fused_id, field_name, i, md5(substr(t, i + 1, 200)) AS s FROM place),
    hit AS (SELECT fused_id, field_name, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(DISTINCT fused_id) > 1)),
    edge AS (SELECT *, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY fused_id, field_name ORDER BY i)),
    run AS (SELECT *, sum(new) OVER (PARTITION BY fused_id, field_name ORDER BY i) AS r FROM edge)
    SELECT fused_id, field_name, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 200 AS INTEGER) AS span_end FROM run GROUP BY fused_id, field_name, r
""",
    "p5_classes": """
    WITH field AS (SELECT fused_id, unnest(['input_text', 'rewritten_v1', 'fused_content']) AS field_name, unnest([0, 1, 2]) AS f, unnest([input_text, rewritten_v1, fused_content]) AS t FROM (SELECT DISTINCT fused_id, input_text, rewritten_v1, fused_content FROM fused_news)),
    long AS (SELECT * FROM field WHERE length(t) >= 80)
    SELECT fused_id, field_name, first_value(fused_id) OVER w AS class_id, first_value(field_name) OVER w AS class_field, count(*) OVER (PARTITION BY t) AS n_copies FROM long WINDOW w AS (PARTITION BY t ORDER BY fused_id, f)
""",
}
