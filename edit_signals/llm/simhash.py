"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint carries its Hamming distances to ``PIVOTS`` reference fingerprints,
computed once. Two fingerprints within k bits differ by at most k in every one of these
distances, so a pair whose largest coordinate difference exceeds k is discarded from the table
alone; the rest is verified bit by bit.

Pairs to look at come from blocks: of k + 2 stretches of the fingerprint two within k bits share
at least two, so the pair shares a block keyed by those two. A block with more than
``BLOCK_LIMIT`` members is split again the same way on the bits that are still free, and so on
until the free bits alone bound a block, so no block is ever an unbounded group and no link is
lost. Blocks give a spanning forest of their links, not all pairs.

Edge cases: null, empty and word-less texts have fingerprint zero and are linked like any other;
fewer words than a shingle make one shingle; equal fingerprints (repeated rows, ties) are one node;
a null doc_id is a row that sorts after every id, so it names a component only when alone; extra
columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, land, map_batches, text_bytes
from .components import components

PIVOTS = 16
BLOCK_LIMIT = 48
FREE_BITS = 8  # below so many free bits a block is not split further: at most 2**8 members
SEED = 42
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 14  # shingles whose bits are counted at once


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned SimHash: a bit is set if set in over half of the shingle hashes."""
    parts = text.translate(_UPPER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(length + 1) - length - 1
    n = max(1, len(parts) - words + 1)
    begin, end = start[:n].tolist(), (start + length)[-n:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at:at + _SLICE], end[at:at + _SLICE], strict=True)],
                     np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), run,
                       "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], np.uint64)


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Adds ``dist``: one byte per pivot, the Hamming distance to it."""
    refs = pivots()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        dist = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
        return pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("doc_id"),
                                           pa.array([r.tobytes() for r in dist], pa.binary())], ["fp", "doc_id", "dist"])

    return map_batches(nodes.select("fp", "doc_id"), run, "fp long, doc_id long, dist binary")


def masks(free: list[int], bits: int) -> list[list[int]]:
    """Bit positions held fixed by each block key: any 2 of ``bits + 2`` stretches of ``free``."""
    parts = [p.tolist() for p in np.array_split(np.array(free, int), bits + 2)]
    return [parts[a] + parts[b] for a, b in combinations(range(bits + 2), 2)]


def _signed(positions: list[int]) -> int:
    value = sum(1 << p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _levels(bits: int) -> list[list[list[tuple[int, ...]]]]:
    """For each level: for each parent path, the positions each of its keys holds fixed in total."""
    levels, parents = [], [()]
    while 64 - len(parents[0]) > FREE_BITS:
        level = [[tuple(fixed) + tuple(m) for m in masks([p for p in range(64) if p not in fixed], bits)]
                 for fixed in parents]
        levels.append(level)
        parents = [key for keys in level for key in keys]
    return levels


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b) fingerprint links that connect exactly what pairs within ``bits`` bits connect."""
    found: DataFrame | None = None
    rows = nodes.select("fp", "dist", F.lit(0).alias("path"))
    levels = _levels(bits)
    for depth, level in enumerate(levels):
        table = F.array(*[F.array(*[F.lit(_signed(list(m))).cast("long") for m in keys]) for keys in level])
        width = len(level[0])
        keyed = rows.select("fp", "dist", "path", F.posexplode(F.get(table, F.col("path"))).alias("k", "mask")).select(
            "fp", "dist", (F.col("path") * width + F.col("k")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = land(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
        shared = keyed.join(sizes, ["path", "key"])
        last = depth == len(levels) - 1
        small = shared if last else shared.where(F.col("n") <= BLOCK_LIMIT)
        part = land(_block_links(small, bits), "block-links")
        found = part if found is None else found.union(part)
        large = sizes.where(F.col("n") > BLOCK_LIMIT)
        if last or is_empty(large):
            break
        rows = land(shared.where(F.col("n") > BLOCK_LIMIT).select("fp", "dist", "path"), "large-blocks")
    return found.distinct()


def _block_links(rows: DataFrame, bits: int) -> DataFrame:
    blocks = rows.groupBy("path", "key").agg(F.collect_list(F.struct("fp", "dist")).alias("members"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        for members in batch.column("members").to_pylist():
            fp = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
            dist = np.frombuffer(b"".join(m["dist"] for m in members), np.uint8).reshape(len(members), -1).astype(np.int16)
            for x, y in _forest(fp, dist, bits):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_batches(blocks.select("members"), run, "a long, b long")


def _forest(fp: np.ndarray, dist: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (as signed longs) of a spanning forest of one block."""
    i, j = np.triu_indices(fp.size, 1)
    keep = np.abs(dist[i] - dist[j]).max(axis=1) <= bits  # the pivot table rules out the others
    i, j = i[keep], j[keep]
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= bits
    signed = fp.view(np.int64).tolist()
    root = list(range(fp.size))
    out = []
    for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
        p, q = x, y
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((signed[x], signed[y]))
    return out


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable."""
    rows = land(fingerprints(docs, words), "fingerprints")
    nodes = land(pivot_table(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))), "nodes")
    tree = components(links(nodes, bits))
    rooted = nodes.join(tree, nodes.fp == tree.node, "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = land(rooted, "rooted")
    lowest = land(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    names = land(named.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "names")
    return rows.join(names, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """Rows of ``docs`` whose doc_id names their component; rows sharing a doc_id are one document.

    A null doc_id is kept only where nothing with an id is linked to it.
    """
    found = near_duplicates(docs, words, bits)
    kept = land(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "kept")
    # a shuffle join at every size: what stays grows with the documents, so it is not to be broadcast
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
