"""Corpus encoding with a public byte-level BPE by content-defined chunk reuse.

1. ``chunk``: every text is cut where a rolling hash of its last ``WINDOW`` characters hits a mask, so equal
   passages of different documents give equal chunks. Each Arrow batch emits a distinct chunk once, with the
   places it stands at.
2. ``encode``: chunks meet by content; each is encoded once. Its first and last piece, up to the first and from
   the last position where no token can cross, stay text; the ids in between are final.
3. ``join``: the chunks of a document in order; at each join the open text of both sides is encoded again,
   reaching over as many chunks as it takes until both ends lie at closed positions.

A position is closed if a letter stands before it and none after it, or a digit before it and none after it. No token
crosses one: every alternative of the pre-tokeniser that can end in a letter (digit) ends there. So the encodings of both
sides agree exactly with the whole text's there, by construction and without a test at run time, whatever the chunks.
That holds for ``PATTERN`` only, so a vocabulary of another pre-tokeniser is refused.

Scale: two shuffles, of distinct chunk texts and of packed ids (two bytes each). A chunk that stands in a third of
all documents is emitted once a batch, and after ``SALT_EVERY`` batches of a task under another salt, so no task
gets all of it; it is then encoded once for each salt.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.session import small_batches, spread, table

#: Pre-tokeniser of the public vocabulary; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Default place of the vocabulary: the installed package of public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"

WINDOW = 16
#: A chunk has 2**CHUNK_BITS characters on average.
CHUNK_BITS = 9
SALT_EVERY = 64
CLOSED = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_PLACE = np.dtype([("doc", "<i8"), ("text", "<i8"), ("pos", "<i4"), ("n", "<i4")])


def default_vocabulary() -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    for root in ([Path(spec.origin).parent] if spec and spec.origin else []) + [Path("/opt/tokenizers")]:
        if (root / VOCABULARY).exists():
            return str(root / VOCABULARY)
    raise FileNotFoundError(VOCABULARY)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a vocabulary file, built once in each Python worker. Other vocabularies than ``VOCABULARY`` raise ``ValueError``."""
    import tiktoken

    if Path(path).name != VOCABULARY:
        raise ValueError(f"closed positions are known for the pre-tokeniser of {VOCABULARY} only, not for {Path(path).name}")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids are packed in two bytes")
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(texts: list[str]) -> list[list[int]]:
    """Cut positions inside each text; they depend on the ``WINDOW`` characters before them only."""
    joined = "".join(texts)
    if not joined:
        return [[] for _ in texts]
    h = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = (h + np.uint64(1)) * _MULTIPLIERS[0]
    h ^= h >> np.uint64(29)
    step = 1
    for m in _MULTIPLIERS:  # doubling: after four rounds a value covers WINDOW characters
        g = h * m
        g[step:] += h[:-step] if step < len(h) else 0
        g ^= g >> np.uint64(31)
        h, step = g, step * 2
    hits = np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS)) == 0) + 1
    ends = np.cumsum([len(t) for t in texts])
    out = []
    for end, t in zip(ends.tolist(), texts):
        start = end - len(t)
        lo, hi = np.searchsorted(hits, (start + WINDOW, end))
        out.append((hits[lo:hi] - start).tolist())
    return out


def split_closed(text: str) -> tuple[str, str, str] | None:
    """(head, middle, tail) cut at the first and last position that no token crosses; None if there is none inside."""
    first = CLOSED.search(text)
    while first and first.end() in (0, len(text)):
        first = CLOSED.search(text, first.end() + 1) if first.end() < len(text) else None
    if not first:
        return None
    a = first.end()
    size = 64
    while True:  # the last one, from the back
        start = max(a, len(text) - size)
        b = max((m.end() for m in CLOSED.finditer(text, start) if m.end() < len(text)), default=a)
        if b > a or start == a:
            return text[:a], text[a:b], text[b:]
        size *= 4


def chunk(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(piece, salt, places)``: each distinct chunk of a batch with the places it stands at, packed."""
    schema = "piece string, salt int, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or "" for t in batch.column(1).to_pylist()]
            found: dict[str, list[tuple]] = {}
            for doc, text, at in zip(ids.tolist(), texts, cuts(texts)):
                key = xxhash.xxh64_intdigest(text) - 2**63
                edges = [0, *(c for c in at if c < len(text)), len(text)]
                n = len(edges) - 1
                for pos in range(n):
                    found.setdefault(text[edges[pos] : edges[pos + 1]], []).append((doc, key, pos, n))
            salts = []
            for piece in found:
                k = hash(piece)
                seen[k] = times = seen.get(k, -1) + 1
                salts.append(times // SALT_EVERY)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(salts, pa.int32()), pa.array([np.array(p, dtype=_PLACE).tobytes() for p in found.values()], pa.binary())],
                names=["piece", "salt", "places"],
            )

    return spread(documents.select(id_col, text_col)).mapInArrow(run, schema)


def encode_chunks(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each place of a chunk: ``head`` and ``tail`` as text, ``ids`` packed; a chunk without a closed position is all head."""
    schema = "doc bigint, txt bigint, pos int, n int, head string, ids binary, tail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        known: dict[bytes, tuple] = {}
        for batch in batches:
            head, ids, tail, places, counts = [], [], [], [], []
            for piece, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                key = xxhash.xxh128_digest(piece)
                got = known.get(key)
                if got is None:
                    parts = split_closed(piece)
                    got = (parts[0], np.array(enc.encode_ordinary(parts[1]), dtype="<u2").tobytes(), parts[2]) if parts else (piece, b"", None)
                    if len(known) >= 50_000:
                        known.clear()
                    known[key] = got
                at = np.frombuffer(packed, dtype=_PLACE)
                places.append(at)
                counts.append(len(at))
                head.append(got[0]), ids.append(got[1]), tail.append(got[2])
            at = np.concatenate(places) if places else np.empty(0, _PLACE)
            pick = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(at[c])) for c in ("doc", "text", "pos", "n")]
                + [pa.array(head, pa.string()).take(pick), pa.array(ids, pa.binary()).take(pick), pa.array(tail, pa.string()).take(pick)],
                names=["doc", "txt", "pos", "n", "head", "ids", "tail"],
            )

    return chunks.repartition("piece", "salt").mapInArrow(run, schema)


def join_chunks(encoded: DataFrame, vocabulary: str, id_col: str) -> DataFrame:
    """``(id_col, ids)`` of each document from its chunks, joins encoded again."""
    schema = f"{id_col} bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        joins: dict[str, bytes] = {"": b""}

        def again(text: str) -> bytes:
            got = joins.get(text)
            if got is None:
                if len(joins) >= 100_000:
                    joins.clear()
                got = np.array(enc.encode_ordinary(text), dtype="<u2").tobytes()
                if len(text) < 64:
                    joins[text] = got
            return got

        at, last, open_, parts = None, -1, "", []
        docs, rows = [], []

        def flush() -> pa.RecordBatch:
            sizes = np.cumsum([0] + [len(r) // 2 for r in rows])
            values = np.frombuffer(b"".join(rows), dtype="<u2").astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))], names=[id_col, "ids"])
            docs.clear(), rows.clear()
            return out

        def done() -> None:
            if at is not None:
                parts.append(again(open_))
                docs.append(at[0]), rows.append(b"".join(parts))

        for batch in batches:
            for doc, txt, pos, head, ids, tail in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))):
                if (doc, txt) != at:
                    done()
                    at, last, open_, parts = (doc, txt), -1, "", []
                if pos == last:  # the same document in a repeated row
                    continue
                last = pos
                if tail is None:
                    open_ += head
                else:
                    parts += [again(open_ + head), ids]
                    open_ = tail
            yield flush()
        done()
        yield flush()

    return encoded.repartition("doc").sortWithinPartitions("doc", "txt", "pos").mapInArrow(run, schema)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids)`` of every document; an empty list for an empty and for a null text.

    Strings of special tokens are ordinary text. Rows repeated in id and text count once; one id with several
    texts gives a row of each. Rows with a null id are encoded directly, one row each.
    """
    vocabulary = vocabulary or default_vocabulary()
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    whole = join_chunks(encode_chunks(chunk(docs.filter(F.col(id_col).isNotNull()), id_col, text_col), vocabulary), vocabulary, id_col)
    rest = docs.filter(F.col(id_col).isNull()).select(id_col, encode_udf(vocabulary)(text_col).alias("ids"))
    return whole.unionByName(rest)


def encode_udf(vocabulary: str):
    """Direct encoding of a column, without reuse."""

    @F.pandas_udf("array<int>")
    def ids(text):
        enc = encoder(vocabulary)
        return text.map(lambda t: enc.encode_ordinary(t) if isinstance(t, str) else [])

    return ids


def count_udf(vocabulary: str):
    """Number of tokens of a column; 0 for null."""

    @F.pandas_udf("int")
    def n(text):
        enc = encoder(vocabulary)
        return text.map(lambda t: len(enc.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int32")

    return n


def reuse(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: chunks, distinct chunks, characters, and the share of characters that need no encoding because their chunk is known."""
    places = F.octet_length("places") / F.lit(_PLACE.itemsize)
    pieces = chunk(documents, id_col, text_col).groupBy("piece").agg(F.sum(places).cast("bigint").alias("n"))
    size = F.length("piece").cast("bigint")
    return pieces.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(size * F.col("n")), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum(size * (F.col("n") - 1)) / F.nullif(F.sum(size * F.col("n")), F.lit(0)), F.lit(0.0)).alias("reused_share"),
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids, "p7_reuse": p7_reuse}
