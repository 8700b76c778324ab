"""Best-fit packing of tokenised documents (best-two-fit).

Which pieces share a sequence depends on their lengths alone, so the plan is made on the
histogram of piece lengths (``size`` numbers, whatever the input). A sequence is filled greedily:
the longest piece left, then again and again the longest that fits. Then its smallest piece is
taken out and replaced by the two unpacked pieces that fill the widened gap best, if they fill it
better than the one did. A filled pattern is used as often as the histogram allows before the
next is built, so the plan has few patterns.

Spark does the rest: every piece gets its rank within its length (a count per length and hash
bucket, prefix sums over buckets, a row number inside a bucket of about sqrt(n) pieces, so no
length is ever one task), and the plan turns (length, rank) into (sequence, offset).

Plan size: every pattern uses up some length, and after a length's count has fallen below what a
pattern needs it can appear in fewer further patterns than it fits into a sequence. That bounds
the plan by about ``size * ln(size)`` patterns of at most ``sqrt(2 * size)`` slots, about a
million slots for 2048 and far fewer in practice.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each on its own;
an empty table gives no rows; extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CACHE_ENTRIES, chunk_words, is_plain, library, word_encoder
from .common import land, map_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# By vocabulary: chunks met since the last turn, and those of the turn before. What is met again moves on to
# the newer ones, so frequent chunks stay when the others are let go.
_seen: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit, by the library."""
    lib = library(path)
    plain = [is_plain(t) for t in texts]
    split = pc.ascii_split_whitespace(pa.array([t.lower() for t, p in zip(texts, plain, strict=True) if p], pa.large_string()))
    chunks = split.flatten().dictionary_encode()
    ids = pa.array(_chunk_ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), path), pa.large_binary()).take(chunks.indices)
    # the ids of all chunks lie end to end, a text's from its first chunk's to its last one's
    _, starts, data = ids.buffers()
    edges = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(split) + 1)
    whole = memoryview(data or b"")
    found = (whole[a:b].tobytes() for a, b in zip(edges, edges[1:]))
    return [next(found) if p else np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, p in zip(texts, plain, strict=True)]


def _chunk_ids(chunks: list[str], path: str) -> list[bytes]:
    """Ids of each of these different chunks."""
    seen, before = _seen.setdefault(path, ({}, {}))
    if len(seen) > CACHE_ENTRIES:
        seen, before = _seen[path] = {}, seen
    fresh = _fresh(chunks, seen, before)
    mixed = {c: chunk_words(c) for c in fresh if not c.isalpha()}
    words = [c for c in fresh if c not in mixed]  # these chunks are words themselves
    words += _fresh(set(chain.from_iterable(mixed.values())).difference(words), seen, before)
    seen.update(zip(words, word_encoder(path).encode(words), strict=True))
    for c, ws in mixed.items():
        seen[c] = b"".join(map(seen.__getitem__, ws))
    return list(map(seen.__getitem__, chunks))


def _fresh(chunks: Iterable[str], seen: dict[str, bytes], before: dict[str, bytes]) -> list[str]:
    """``chunks`` met neither now nor before; those met before only move to ``seen``."""
    new = [c for c in chunks if c not in seen]
    seen.update((c, before[c]) for c in new if c in before)
    return [c for c in new if c not in seen] if before else new


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``size`` ids of every document's ids followed by ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text").to_pylist(), path),
                               strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at:at + 4 * size]
                for col, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    col.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, cut, PIECES)


@dataclass
class Plan:
    """Slots sorted by (length, first rank): rank r of a slot goes to sequence
    ``sequence + (r - rank) // repeat`` at ``offset + (r - rank) % repeat * length``."""

    length: np.ndarray
    rank: np.ndarray
    repeat: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def best_two_fit(histogram: dict[int, int], size: int) -> Plan:
    left = np.zeros(size + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    used = np.zeros(size + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0
    while True:
        stock = np.flatnonzero(left)
        if not stock.size:
            break
        pattern, gap = _fill(left, stock, size)
        if gap and len(pattern) > 1:
            _swap_smallest(left, pattern, gap)
        lengths, need = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // need).min())
        at = 0
        for n, k in zip(lengths[::-1].tolist(), need[::-1].tolist(), strict=True):
            slots.append((n, int(used[n]), k, made, at))
            used[n] += k * times
            left[n] -= k * times
            at += n * k
        made += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5).T
    return Plan(*table, made)


def _fill(left: np.ndarray, stock: np.ndarray, size: int) -> tuple[list[int], int]:
    """Longest first, then the longest that still fits, until nothing fits."""
    pattern: list[int] = []
    gap, at = size, stock.size - 1
    while at >= 0 and gap:
        n = int(stock[at])
        take = min(int(left[n]), gap // n)
        pattern += [n] * take
        gap -= n * take
        at = min(at - 1, int(np.searchsorted(stock, gap, side="right")) - 1)
    return pattern, gap


def _swap_smallest(left: np.ndarray, pattern: list[int], gap: int) -> None:
    """Replace the smallest piece by the two unpacked ones that leave the smallest gap, if smaller."""
    smallest = min(pattern)
    room = gap + smallest
    spare = left.copy()
    np.subtract.at(spare, pattern, 1)
    one = np.flatnonzero(spare[:room + 1])
    if not one.size:
        return
    most = np.searchsorted(one, room - one, side="right") - 1  # partner: the longest that fits
    same = (most >= 0) & (one[most] == one) & (spare[one] < 2)
    most = np.where(same, most - 1, most)
    total = np.where(most >= 0, one + one[most], 0)
    best = int(total.argmax())
    if total[best] > smallest:
        pattern.remove(smallest)
        pattern += [int(one[best]), int(one[most[best]])]


def pack_pieces(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (landed first: their ranks must not change)."""
    pieces = land(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_two_fit(histogram, size)
    ranked = _ranked(pieces, histogram, size)
    span = np.int64(1) << 40  # ranks are below 2**40, lengths below 2**23
    keys = plan.length * span + plan.rank

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        slot = np.searchsorted(keys, length * span + rank, side="right") - 1
        nth = rank - plan.rank[slot]
        seq = plan.sequence[slot] + nth // plan.repeat[slot]
        offset = plan.offset[slot] + nth % plan.repeat[slot] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)],
                                          [*names, "sequence_id", "offset"])

    return map_batches(ranked, place, f"{PIECES}, sequence_id long, offset long")


def _ranked(pieces: DataFrame, histogram: dict[int, int], size: int) -> DataFrame:
    """``rank``: 0.. within each length, without one task per length."""
    total = sum(histogram.values())
    group = max(1, math.isqrt(total))
    buckets = F.array(*[F.lit(-(-histogram.get(n, 0) // group) or 1) for n in range(1, size + 1)])
    split = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                               F.element_at(buckets, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = land(split.groupBy("length", "bucket").agg(F.count("*").alias("n"))
                .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = split.withColumn("nth", F.row_number().over(inside))
    return (numbered.join(base, ["length", "bucket"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank")))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return pack_pieces(token_pieces(docs, path, size, end_id), size)
