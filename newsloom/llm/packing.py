"""Filling containers of fixed capacity with items by a configuration linear program.

The histogram of item sizes (at most ``capacity`` numbers, whatever the corpus) goes to the driver. There the
configuration LP -- as few containers as possible so that their configurations cover the histogram -- is solved
by multiplicative weights: each size has a weight, the best configuration for the weights is a knapsack solved by
dynamic programming, and the weights of the sizes it covers fall. The fractional solution is a mix of
configurations, rounded down in each shard of the items; what the rounding leaves over fills the remaining gaps
best fit first, then new containers. No item is split unless it exceeds the capacity; such an item gives full
pieces and one remainder, which is packed like an item.

Scale: texts are sized where they are read, only (id, size) is shuffled, and the size table is written once to the
shared folder, as two jobs read it. Shards are hashes of the id of about ``SHARD_ITEMS`` items, so no task's input
grows with the corpus; a shard leaves at most about half a container unfilled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.tokens import count_udf, default_vocabulary
from newsloom.sources.session import cut, small_batches, spread, table

CAPACITY = 2048
SHARD_ITEMS = 20_000
#: The LP prices configurations on this many units of capacity; sizes are rounded to the nearest unit.
UNITS = 256
#: Rounds at most, and the duality gap at which they end.
ROUNDS = 1500
GAP = 0.005
STEP = 0.5
EAGER = 40.0

PACK_SCHEMA = "container_id bigint, position int, doc_id bigint, piece_no int, token_start bigint, n_tokens int"


def knapsack(value: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Counts of each size 1..U in the best configuration of capacity U for ``value`` (by size, 0 at unused sizes)."""
    u = len(value) - 1
    best, take = np.zeros(u + 1), np.zeros(u + 1, dtype=np.int64)
    for c in range(1, u + 1):
        options = best[c - 1 :: -1][:c] + value[1 : c + 1]  # last item of size 1..c
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], take[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    counts = np.zeros(u + 1, dtype=np.int64)
    while u > 0:
        if take[u]:
            counts[take[u]] += 1
            u -= int(take[u])
        else:
            u -= 1
    return counts


@dataclass
class Cover:
    """A fractional cover: (counts by size, how many of them), its value, the best lower bound found and the rounds it took."""

    patterns: list[tuple[np.ndarray, float]]
    value: float
    bound: float
    rounds: int

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def solve(demand: np.ndarray, rounds: int = ROUNDS, step: float = STEP, gap: float = GAP) -> Cover:
    """Fractional cover of ``demand`` (by size in units) by configurations.

    Multiplicative weights for the covering LP: the weight of a size is exp(-EAGER * its coverage) over its
    demand; each round takes the best configuration for the weights as often as covers ``step`` of the demand of
    its scarcest size. The sum is scaled so that the least covered size is just covered. By LP duality the weights of a
    round bound every cover from below: demand times weights over the weight of the best configuration. Rounds end
    when value and best bound are within ``gap``. Deterministic.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return Cover([], 0.0, 0.0, 0)
    d = demand[sizes].astype(float)
    covered, total = np.zeros(len(sizes)), 0.0
    bound = float(d @ sizes) / (len(demand) - 1)  # with the sizes as weights no configuration weighs more than the capacity
    used: dict[bytes, list] = {}
    done = 0
    for done in range(1, rounds + 1):
        value = np.zeros(len(demand))
        value[sizes] = np.exp(-(covered - covered.min()) * EAGER) / d
        counts = knapsack(value)[sizes]
        bound = max(bound, float(d @ value[sizes]) / float(counts @ value[sizes]))
        amount = step * float((d / np.maximum(counts, 1e-9))[counts > 0].min())
        entry = used.setdefault(counts.tobytes(), [counts, 0.0])
        entry[1] += amount
        total += amount
        covered += counts * amount / d
        if covered.min() > 0 and total / covered.min() <= bound * (1 + gap):
            break
    scale = float(covered.min()) if covered.min() > 0 else float(covered[covered > 0].min())
    left, out = d.copy(), []
    for counts, amount in sorted(used.values(), key=lambda e: -float(e[0] @ sizes)):
        n = min(amount / scale, float((left / np.maximum(counts, 1e-9))[counts > 0].min()))
        if n > 0:
            left -= counts * n
            full = np.zeros(len(demand), dtype=np.int64)
            full[sizes] = counts
            out.append((full, n))
    return Cover(out, total / scale, bound, done)


class Gaps:
    """Open containers by free space, best fit found through a bit mask of the spaces in use."""

    def __init__(self, capacity: int) -> None:
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, container: int, space: int) -> None:
        if space > 0:
            self.by_space[space].append(container)
            self.mask |= 1 << space

    def fit(self, size: int) -> tuple[int, int] | None:
        m = self.mask >> size
        if not m:
            return None
        space = size + (m & -m).bit_length() - 1
        container = self.by_space[space].pop()
        if not self.by_space[space]:
            self.mask &= ~(1 << space)
        return container, space


def to_units(sizes: np.ndarray, capacity: int, units: int) -> np.ndarray:
    return np.maximum(1, (sizes * units + capacity // 2) // capacity)


def fill(sizes: np.ndarray, patterns: list[tuple[np.ndarray, float]], share: float, capacity: int, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each item of a shard; ``share`` is the shard's part of all items.

    A configuration names the classes of a container's items. As classes are rounded, the last item is the largest
    that still fits, whatever its class; items of the configuration that no longer fit stay for the rest.
    """
    container, position = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int32)
    unit = to_units(sizes, capacity, units).tolist()
    size_list = sizes.tolist()
    by_class: list[dict[int, list[int]]] = [{} for _ in range(units + 1)]  # class, size, items
    waiting, left = 0, [0] * (units + 1)  # sizes with items as a bit mask; items by class
    for i in np.argsort(-sizes, kind="stable").tolist():
        by_class[unit[i]].setdefault(size_list[i], []).append(i)
        waiting |= 1 << size_list[i]
        left[unit[i]] += 1
    held: list[int] = []
    space: list[int] = []

    def take(u: int, size: int) -> int:
        nonlocal waiting
        items = by_class[u][size]
        i = items.pop()
        left[u] -= 1
        if not items:
            del by_class[u][size]
            waiting &= ~(1 << size)
        return i

    def put(i: int, c: int) -> None:
        container[i], position[i] = c, held[c]
        held[c] += 1
        space[c] -= size_list[i]

    for counts, amount in patterns:
        need = [int(u) for u in np.flatnonzero(counts)[::-1] for _ in range(counts[u])]
        of = [(int(u), int(counts[u])) for u in np.flatnonzero(counts)]
        for _ in range(int(amount * share + 0.5)):
            if any(left[u] < k for u, k in of):
                break
            held.append(0), space.append(capacity)
            c = len(held) - 1
            for u in need[:-1]:
                fits = [x for x in by_class[u] if x <= space[c]]
                if fits:
                    put(take(u, max(fits)), c)
            m = waiting & ((2 << space[c]) - 1)
            if m:
                size = m.bit_length() - 1
                put(take(int(to_units(np.array([size]), capacity, units)[0]), size), c)
    gaps = Gaps(capacity)
    for c, s in enumerate(space):
        gaps.put(c, s)
    for i in sorted((i for by_size in by_class for items in by_size.values() for i in items), key=lambda i: (-size_list[i], i)):
        got = gaps.fit(size_list[i])
        if got is None:
            held.append(0), space.append(capacity)
            c = len(held) - 1
        else:
            c = got[0]
        put(i, c)
        gaps.put(c, space[c])
    return container, position


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, other)`` of each document whose text is neither null nor empty; ``other`` tells rows with a null id apart.

    A repeated id counts once, with its longest text; of rows with a null id, equal texts count once.
    """
    small_batches(documents.sparkSession)
    docs = spread(documents.select(id_col, text_col).filter(F.col(text_col).isNotNull() & (F.col(text_col) != ""))).select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("other"),
        count_udf(vocabulary or default_vocabulary())(text_col).alias("n_tokens"),
    )
    return docs.groupBy("doc_id", "other").agg(F.max("n_tokens").alias("n_tokens"))


def histogram(items: DataFrame, capacity: int, units: int) -> tuple[np.ndarray, int]:
    """(number of items by size in units, number of items) of ``items``, without the full pieces of longer ones; at most ``capacity`` rows are read."""
    rest = F.expr(f"if(n_tokens <= {capacity}, n_tokens, n_tokens % {capacity})")
    demand, total = np.zeros(units + 1, dtype=np.int64), 0
    for r in items.groupBy(rest.alias("size")).agg(F.count("*").alias("n")).collect():
        total += r.n
        if r.size > 0:
            demand[int(to_units(np.array([r.size]), capacity, units)[0])] += r.n
    return demand, total


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, units: int = UNITS) -> DataFrame:
    """Containers for ``sizes(doc_id, n_tokens)``: one row for each item or piece of an item longer than ``capacity``.

    ``container_id`` is unique over all shards, ``position`` counts from 0 within a container, ``token_start`` is
    the piece's first token in its document. An item of size 0 or null takes no container. Empty input gives no
    rows. Equal sizes are told apart by id only, so the result doesn't depend on the partitioning.
    """
    units = min(units, capacity)
    items = cut(sizes.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("int").alias("n_tokens"), (F.col("other") if "other" in sizes.columns else F.lit(None).cast("bigint")).alias("other")), "sizes")
    demand, total = histogram(items, capacity, units)
    patterns = solve(demand).patterns
    shards = max(1, -(-total // shard_items))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        docs, n = pdf.doc_id.to_numpy(), pdf.n_tokens.to_numpy(dtype=np.int64)
        full = np.where(n > capacity, n // capacity, 0)
        last = n - full * capacity
        has = last > 0
        container, position = fill(last[has], patterns, has.sum() / max(total, 1), capacity, units)
        opened = int(container.max()) + 1 if len(container) else 0
        parts = [pd.DataFrame({"container_id": container, "position": position, "doc_id": docs[has], "piece_no": full[has], "token_start": (full * capacity)[has], "n_tokens": last[has]})]
        if full.sum():
            no = np.concatenate([np.arange(k) for k in full[full > 0]])
            parts.append(pd.DataFrame({"container_id": opened + np.arange(full.sum()), "position": 0, "doc_id": np.repeat(docs, full), "piece_no": no, "token_start": no * capacity, "n_tokens": capacity}))
        out = pd.concat(parts)
        out["container_id"] += int(key[0]) << 32
        return out.astype({"container_id": "int64", "position": "int32", "piece_no": "int32", "token_start": "int64", "n_tokens": "int32"})

    shard = F.pmod(F.xxhash64("doc_id", "other"), F.lit(shards))
    return items.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda key, pdf: run(key, pdf), PACK_SCHEMA)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(table(spark, sf_dir, "documents")))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, the fewest that could hold the tokens, and the share of space in use."""
    by = p8_pack(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return by.agg(
        F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.expr(f"cast(ceil(sum(tokens) / {CAPACITY}) as bigint)").alias("least_containers"),
        (F.sum("tokens") / (F.count("*") * CAPACITY)).alias("fill"),
    )


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the linear program: its value, the lower bound from the weights, their gap, and the rounds; sizes in units."""
    demand, total = histogram(token_sizes(table(spark, sf_dir, "documents")).filter("n_tokens > 0"), CAPACITY, UNITS)
    got = solve(demand)
    return spark.createDataFrame([(total, got.value, got.bound, got.gap, got.rounds)], "n_items bigint, lp_value double, lp_bound double, gap double, rounds int")


QUERIES = {"p8_pack": p8_pack, "p8_summary": p8_summary, "p8_bounds": p8_bounds}
