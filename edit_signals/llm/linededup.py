"""Line deduplication with levelled sorted runs of line hashes.

A run is a landed table of (key hash, documents holding it, its holder), hash-partitioned and
sorted by the hash. Each batch of documents is reduced to one row per line hash, merge-joined
with the runs (a hash no run knows is a line never seen before, and keeps its holder) and
added as a run of its own on level 0, the only table it lands. When a level holds ``FANOUT`` runs
they are merged into one run of the next level, so a hash is rewritten once a level. Batches go
from the largest doc_ids to the smallest, so the batch that brings a hash in names its largest
document.

A line's key is the line without ``[ \\t-\\r]`` at both ends and with A-Z in lower case; keys are
compared by 128 bits of hash. Keys shorter than ``min_chars`` code points are never dropped.

Edge cases: a null or empty text is one empty line and stays as it is; a line repeated within a
document counts that document once, and all its copies go or stay together; rows that share a
doc_id are documents of their own for the count, and all of them hold a line their id holds; a
null doc_id ranks below every id; extra columns are kept by ``drop_lines``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, map_batches, text_bytes

BATCHES = 4
FANOUT = 3
NO_ID = -(1 << 63)  # stands for a null doc_id: below every other
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short to count."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.translate(_UPPER))


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and the hash (h1, h2) of every distinct countable line of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids: list[int] = []
        hashes: list[bytes] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = {h for h in (line_hash(x, min_chars) for x in text.split(b"\n")) if h}
            ids += [doc_id] * len(found)
            hashes += found
        h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                                          ["doc_id", "h1", "h2"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text"))
    return map_batches(rows, run, "doc_id long, h1 long, h2 long")


class LineRuns:
    """Levelled runs; ``add`` returns the batch's lines no earlier batch had."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, lines: DataFrame) -> DataFrame:
        """``lines(doc_id, h1, h2)``, one row per document and line hash."""
        rows = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        for run in self.runs():  # a run that names the holder has been there: at most one of them does
            known = run.where("holder is not null").select("h1", "h2", F.lit(True).alias("known"))
            rows = rows.join(known.hint("merge"), ["h1", "h2"], "left").select(
                "h1", "h2", "n", F.when(F.col("known").isNull(), F.col("holder")).alias("holder"))
        run = self._push(0, self._sorted(rows))
        return run.where("holder is not null")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self) -> DataFrame:
        """All runs as one: a row per line hash, with its count and holder."""
        return self._merge(self.runs())

    def _push(self, level: int, run: DataFrame) -> DataFrame:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, self._sorted(merged))
        return run

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.union(run)
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        return land(rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "run")


def repeated_lines(lines: DataFrame, min_docs: int, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, holder) of line hashes found in at least ``min_docs`` documents."""
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1_000).alias("cuts")).first()[0]
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    runs = LineRuns()
    for high, low in zip(edges, edges[1:]):
        part = lines if high is None else lines.where(F.col("doc_id") <= high)
        runs.add(part if low is None else part.where(F.col("doc_id") > low))
    return runs.merged().where(F.col("n") >= min_docs).select("h1", "h2", "holder")


def _with_drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """``docs`` with ``_drops``: the hashes of the lines this document loses (null: none)."""
    lines = land(line_table(docs, min_chars), "lines")
    repeated = land(repeated_lines(lines, min_docs, batches), "repeated")
    lost = lines.join(repeated, ["h1", "h2"]).where("doc_id <> holder")
    drops = land(lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))
                 .withColumnRenamed("doc_id", "_drop_id"), "drops")
    here = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    # a shuffle join at every size: the list grows with the documents, so it is not to be broadcast
    return docs.join(drops.hint("merge"), here == drops["_drop_id"], "left").drop("_drop_id")


def _kept(text: bytes, drops: list[dict] | None, min_chars: int) -> tuple[list[bytes], int]:
    lines = text.split(b"\n")
    if not drops:
        return lines, len(lines)
    gone = set(map(bytes, np.array([(d["h1"], d["h2"]) for d in drops], np.int64).view("V16").ravel().tolist()))
    return [x for x in lines if line_hash(x, min_chars) not in gone], len(lines)


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_kept(t, d, min_chars) for t, d in
                zip(batch.column("text").to_pylist(), batch.column("_drops").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([n for _, n in rows], pa.int64()),
             pa.array([n - len(kept) for kept, n in rows], pa.int64()),
             pa.array([hashlib.sha256(b"\n".join(kept)).hexdigest() for kept, _ in rows])],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _with_drops(thin, min_chars, min_docs, batches).select("doc_id", text_bytes().alias("text"), "_drops")
    return map_batches(rows, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` (a null text stays null)."""

    @F.pandas_udf("string")
    def rewrite(text, drops):  # noqa: ANN001 - pandas series
        import pandas as pd
        return pd.Series([t if t is None or d is None else b"\n".join(
            _kept(t.encode(), list(d), min_chars)[0]).decode() for t, d in zip(text, drops, strict=True)], dtype=object)

    # the documents' own columns travel in a struct, where no name of theirs can clash
    thin = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    rows = _with_drops(thin, min_chars, min_docs, batches)
    text = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(rewrite("text", "_drops"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
