"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers, floor(256 * x), and packed into blocks of ``BLOCK_ROWS`` rows. A
block keeps, for every dimension, the list of its rows by that component. A query walks all lists
of a block together, from the large end where its own component is positive and from the small end
where it is negative. Every row met is scored in full (random access). The sum of the query's
components times the components at the current depth bounds every row not met yet; the walk stops
when that bound is below the k-th best score so far (a row with an equal score could still win the
tie by its id). The depth doubles from step to step, so a walk has few steps.

Every share of the query blocks meets every bucket of candidate blocks in a cogroup: query blocks are
copied once per bucket, candidate blocks once per share of about ``QUERY_BLOCKS`` query blocks, so a
group is bounded and neither side is broadcast or collected.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate; rows with a null vec_id take no part; a vec_id that repeats is one vector
(the smallest of them); vectors of another length than the query's are no candidates of it; ties
go to the smaller vec_id; fewer than k candidates are all returned; empty vectors score 0;
scores outside 64 bits are an error; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import land, map_batches

BLOCK_ROWS = 4096
QUERY_ROWS = 256
QUERY_BLOCKS = 64
FIRST_DEPTH = 32
SCALE = 256


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, x: the quantised components, as little-endian 64-bit integers."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    one = clean.groupBy("vec_id").agg(F.min("v").alias("v"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [_integers(v) for v in batch.column("v").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(v) for v in x], pa.int32()),
                                           pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "dims", "x"])

    return map_batches(one, run, "vec_id long, dims int, x binary")


def _integers(v: list[float]) -> np.ndarray:
    x = np.floor(np.array(v, np.float64) * SCALE)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise OverflowError("a component does not fit 64 bits")
    return x.astype("<i8")


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """dims, size, ids, data: blocks of at most ``rows`` vectors of one length, in partition order."""

    def run(batches):  # noqa: ANN001, ANN202 - Arrow batches
        open_blocks: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for vec_id, dims, x in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dims", "x")), strict=True):
                block = open_blocks.setdefault(dims, [])
                block.append((vec_id, x))
                if len(block) == rows:
                    yield _packed(dims, open_blocks.pop(dims))
        for dims, block in open_blocks.items():
            yield _packed(dims, block)

    return vectors.select("vec_id", "dims", "x").mapInArrow(run, "dims int, size int, ids binary, data binary")


def _packed(dims: int, block: list[tuple[int, bytes]]) -> pa.RecordBatch:
    ids = np.array([i for i, _ in block], "<i8")
    return pa.RecordBatch.from_arrays(
        [pa.array([dims], pa.int32()), pa.array([len(block)], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
         pa.array([b"".join(x for _, x in block)], pa.binary())], ["dims", "size", "ids", "data"])


class Lists:
    """Candidate block with its sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # equal scores then rank by position
        self.ids, self.x = ids[order], x[order]
        self.up = np.argsort(self.x, axis=0, kind="stable")
        top = np.abs(self.x).max(initial=0).astype(float)
        self.top = top
        self.f = self.x.astype(np.float64)

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own, by threshold algorithm."""
        n, exact = self.ids.size, np.abs(q).sum(dtype=float) * self.top
        if exact >= 2.0**63:
            raise OverflowError("a score may not fit 64 bits")
        x, w = (self.f, q.astype(np.float64)) if exact < 2.0**53 else (self.x, q)
        used = np.flatnonzero(q)
        down = q[used] > 0
        met = np.zeros(n, bool)
        met[np.searchsorted(self.ids, own):np.searchsorted(self.ids, own, side="right")] = True
        rows = np.zeros(0, np.int64)
        scores = np.zeros(0, x.dtype)
        depth, seen = 0, min(FIRST_DEPTH, n)
        while True:
            at = np.where(down, n - 1 - np.arange(depth, seen)[:, None], np.arange(depth, seen)[:, None])
            here = self.up[at, used]  # sorted access: the next stretch of every list
            mask = np.zeros(n, bool)
            mask[here.ravel()] = True
            fresh = np.flatnonzero(mask & ~met)
            met[fresh] = True
            rows, scores = np.concatenate((rows, fresh)), np.concatenate((scores, x[fresh] @ w))  # random access
            keep = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[keep], scores[keep]
            depth = seen
            if depth >= n or not used.size:
                break
            bound = (x[here[-1], used] * w[used]).sum()
            if rows.size == k and bound < scores[-1]:
                break
            seen = min(n, 2 * depth)
        if not used.size:  # a zero query: every row scores 0, the smallest ids win
            rows = np.flatnonzero(~met)[:k]
            scores = np.zeros(rows.size, np.int64)
        return self.ids[rows], scores.astype(np.int64)


def _search(vectors: pa.Table, wanted: pa.Table, k: int) -> pa.Table:
    """Every query of ``wanted`` against every block of ``vectors`` of its length."""
    out: tuple[list, list, list] = ([], [], [])
    for dims, c_ids, c_data in zip(*(vectors.column(c).to_pylist() for c in ("dims", "ids", "data")), strict=True):
        ids = np.frombuffer(c_ids, "<i8")
        lists = Lists(ids, np.frombuffer(c_data, "<i8").reshape(ids.size, dims))
        for q_dims, q_ids, q_data in zip(*(wanted.column(c).to_pylist() for c in ("dims", "ids", "data")), strict=True):
            own = np.frombuffer(q_ids, "<i8")
            if q_dims != dims:
                continue
            for i, q in zip(own.tolist(), np.frombuffer(q_data, "<i8").reshape(own.size, dims), strict=True):
                best, scores = lists.best(i, q, k)
                for col, values in zip(out, (np.full(best.size, i), best, scores), strict=True):
                    col.append(values)
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for every row of ``queries``."""
    candidates = land(pack(quantised(vectors), BLOCK_ROWS), "vector-blocks")
    wanted = land(pack(quantised(queries), QUERY_ROWS), "query-blocks")
    buckets, shares = max(1, candidates.count()), max(1, -(-wanted.count() // QUERY_BLOCKS))
    left = candidates.withColumn("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets))).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    right = wanted.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares))).withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    found = left.groupBy("bucket", "share").cogroup(right.groupBy("bucket", "share")).applyInArrow(
        lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
