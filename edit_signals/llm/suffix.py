"""Suffix-array deduplication by bucket-pointer refinement, over a sparse set of suffixes.

A byte goes if a ``span``-byte string covering it also starts anywhere else. Only these strings
need sorting, and only as far as "equal or not", so the suffix array is kept sparse: the window of
a string is represented by the suffix at its smallest ``q``-gram hash (the leftmost of equals),
which depends on the window's bytes alone, so equal strings have the same suffix at the same place.

* Initial buckets: suffixes by the hash of their first q bytes. A suffix alone in its bucket
  represents no repeated string.
* First refinement: a suffix's windows lie between ``lo`` and ``hi``; its bucket is refined by the
  identifier of all bytes these windows cover. Suffixes together in a refined bucket repeat all
  their windows; no further work is done for them (interior of copies).
* Recursion on buckets that fell apart (edges of copies): one suffix of every refined bucket takes
  part. Its windows are split into blocks of offsets; a block's *core* (the bytes all its windows
  share) and *whole* (the bytes any covers) are looked up in the bucket. Whole shared: all windows
  repeat. Core not shared: none does. Otherwise the block's windows are compared one by one.

Results of a refined bucket are reused for all its members. Identifiers are 128-bit hashes of
the bytes. Nothing is compared pair by pair, so a bucket of any size costs a count per member.

Edge cases: null and empty texts and texts shorter than ``span`` lose nothing; repeated rows lose
all their text; strings within one document count, overlapping ones too; extra columns, whatever their
names, are kept by ``drop_repeats`` but for those named like its results; a null doc_id is a row like any other. Kept bytes need not be whole
characters, so ``drop_repeats`` returns them as binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, map_batches, text_bytes

Q = 100
BLOCK = 32  # windows compared together before they are compared one by one
SLICE_BYTES = 1 << 20  # bytes handled in one array; longer texts go in overlapping sections
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_BASE = np.uint64(xxhash.xxh64_intdigest(b"base", 7) | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of the q bytes at each place, modulo 2**64, mixed."""
    n = data.size
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power)))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - q, _INVERSE, np.uint64))))
    h = (total[q:] - total[:n - q + 1]) * back
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by running minima of blocks from both sides."""
    n = values.size
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def suffixes(data: bytes, size: np.ndarray, span: int, q: int) -> tuple[np.ndarray, ...]:
    """For texts of the given sizes laid end to end: (text, suffix, first and last window, gram hash).

    Places count from the start of ``data``.
    """
    raw = np.frombuffer(data, np.uint8)
    if raw.size < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    h = gram_hashes(raw, q)
    bits = np.uint64(int(raw.size).bit_length())
    place = np.arange(h.size, dtype=np.uint64)
    owner = (window_minima((h >> bits << bits) | place, span - q + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(size.size), size)[:owner.size]
    inside = np.flatnonzero(np.arange(span, owner.size + span) <= np.cumsum(size)[text])
    owner, text = owner[inside], text[inside]
    opens = np.concatenate((np.ones(min(1, inside.size), bool), (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(opens)
    last = np.append(first[1:], inside.size)[:first.size] - 1
    return text[first], owner[first], inside[first], inside[last], h[owner[first]].view(np.int64)


def _digest_columns(parts: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit digests as two longs."""
    both = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def suffix_table(texts: DataFrame, span: int, q: int) -> DataFrame:
    """doc (row identity), at, lo, hi (places in the text), gram, w1 and w2 (hash of what lo..hi covers)."""

    def sections(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[int], list[bytes]]]:
        docs, bases, parts, size = [], [], [], 0
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for base in range(0, len(text) - span + 1, SLICE_BYTES):
                part = text[base:base + SLICE_BYTES + span - 1]
                docs.append(doc)
                bases.append(base)
                parts.append(part)
                size += len(part)
                if size >= SLICE_BYTES:
                    yield docs, bases, parts
                    docs, bases, parts, size = [], [], [], 0
        if docs:
            yield docs, bases, parts

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        out = []
        for docs, bases, parts in sections(batch):
            data, size = b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
            text, at, lo, hi, gram = suffixes(data, size, span, q)
            digest = xxhash.xxh3_128_digest
            w1, w2 = _digest_columns([digest(data[a:b], seed) for a, b, seed in
                                      zip(lo.tolist(), (hi + span).tolist(), (at - lo).tolist(), strict=True)])
            base = (np.array(bases) - (np.cumsum(size) - size))[text]
            ids = pa.array(docs, pa.binary()).take(pa.array(text))
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(at + base), pa.array(lo + base), pa.array(hi + base),
                                                   pa.array(gram), w1, w2], ["doc", "at", "lo", "hi", "gram", "w1", "w2"]))
        return pa.Table.from_batches(out) if out else None

    return map_batches(texts, run, "doc binary, at long, lo long, hi long, gram long, w1 long, w2 long")


def refine(rows: DataFrame, bucket: str, ident: list[str]) -> tuple[DataFrame, DataFrame]:
    """One refinement of buckets by the identifier (w1, w2).

    Returns the rows that share their refined bucket, and one row (``ident``) of every refined
    bucket of the buckets that fell apart.
    """
    apart = (F.min("w1") != F.max("w1")) | (F.min("w2") != F.max("w2"))
    buckets = land(rows.groupBy(bucket).agg(F.count("*").alias("n"), apart.alias("apart")).where("n > 1")
                   .select(bucket, "apart"), "buckets")
    shared = land(rows.join(buckets, bucket), "shared")
    refined = land(shared.groupBy(bucket, "w1", "w2", "apart").agg(
        F.count("*").alias("n"), F.min(F.struct(*ident)).alias("one")), "refined")
    copies = shared.join(refined.where("n > 1").select(bucket, "w1", "w2"), [bucket, "w1", "w2"])
    return copies.select(*ident), refined.where("apart").select("one.*")


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_bytes`` (its text) and ``_doc`` (row identity: id and text)."""
    rows = docs.withColumn("_bytes", text_bytes())
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":")).cast("binary")
    return rows.withColumn("_doc", F.unhex(F.md5(F.concat(name, F.col("_bytes")))))


def repeated_spans(docs: DataFrame, span: int = 400, q: int = Q) -> DataFrame:
    """(doc, spans): the byte ranges to remove, for every row identity that loses any."""
    texts = _identified(docs).select(F.col("_doc").alias("doc"), F.col("_bytes").alias("text"))
    table = land(suffix_table(texts, span, q), "suffixes")
    copies, members = refine(table, "gram", ["doc", "at", "lo", "hi"])
    context = land(_contexts(texts, members, span), "contexts")
    same, parts = refine(land(_block_rows(context, span), "blocks"), "core", ["doc", "first", "last", "at", "lo"])
    windows = land(_window_rows(context, parts, span), "windows")
    twice = land(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    cuts = (copies.select("doc", F.col("lo").alias("a"), (F.col("hi") + span).alias("b"))
            .union(same.select("doc", "first", F.col("last") + span))
            .union(windows.join(twice, ["w1", "w2"]).select("doc", "first", F.col("first") + span)))
    return cuts.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _contexts(texts: DataFrame, members: DataFrame, span: int) -> DataFrame:
    """doc, at, lo, hi and the bytes the windows lo..hi cover, of every member suffix."""
    wanted = land(members.groupBy("doc").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("wanted")), "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(doc, r["at"], r["lo"], r["hi"], text[r["lo"]:r["hi"] + span]) for doc, text, wanted in
                zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted")), strict=True) for r in wanted]
        return _batch(rows, {"doc": pa.binary(), "at": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "bytes": pa.binary()})

    found = map_batches(texts.join(wanted, "doc"), run, "doc binary, at long, lo long, hi long, bytes binary")
    return found.dropDuplicates(["doc", "at", "lo"])  # repeated rows have the same identity


def _block_rows(context: DataFrame, span: int) -> DataFrame:
    """Blocks of windows of each suffix.

    A window's offset is how far before the suffix it starts; block b has offsets 32b to 32b+31, of
    which a suffix has the windows ``first`` to ``last``. ``core`` hashes the bytes that every
    window of the block covers, w1 and w2 those that any window the suffix has there covers.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, whole, core = [], [], []
        for doc, at, lo, hi, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "at", "lo", "hi", "bytes")), strict=True):
            for block in range((at - hi) // BLOCK, (at - lo) // BLOCK + 1):
                inner = at - block * BLOCK  # the last window the block could have
                first, last = max(lo, inner - BLOCK + 1), min(hi, inner)
                core.append(xxhash.xxh3_64_intdigest(data[inner - lo:inner - BLOCK + 1 + span - lo], block))
                whole.append(xxhash.xxh3_128_digest(data[first - lo:last + span - lo], at - first))
                rows.append((doc, at, lo, first, last))
        w1, w2 = _digest_columns(whole)
        known = _batch(rows, {"doc": pa.binary(), "at": pa.int64(), "lo": pa.int64(), "first": pa.int64(), "last": pa.int64()})
        key = pa.array(np.array(core, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*known.columns, key, w1, w2], [*known.schema.names, "core", "w1", "w2"])

    return map_batches(context.select("doc", "at", "lo", "hi", "bytes"), run,
                       "doc binary, at long, lo long, first long, last long, core long, w1 long, w2 long")


def _window_rows(context: DataFrame, parts: DataFrame, span: int) -> DataFrame:
    """doc, first, w1, w2 of every single window of the blocks in ``parts``."""
    wanted = land(parts.groupBy("doc", "at", "lo").agg(F.collect_list(F.struct("first", "last")).alias("wanted")), "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, whole = [], []
        for doc, lo, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "lo", "bytes", "wanted")), strict=True):
            for block in wanted:
                for at in range(block["first"], block["last"] + 1):
                    rows.append((doc, at))
                    whole.append(xxhash.xxh3_128_digest(data[at - lo:at - lo + span]))
        w1, w2 = _digest_columns(whole)
        known = _batch(rows, {"doc": pa.binary(), "first": pa.int64()})
        return pa.RecordBatch.from_arrays([*known.columns, w1, w2], ["doc", "first", "w1", "w2"])

    joined = context.join(wanted, ["doc", "at", "lo"]).select("doc", "lo", "bytes", "wanted")
    return map_batches(joined, run, "doc binary, first long, w1 long, w2 long")


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of ``text`` and the number of maximal runs removed."""
    kept, runs, end, begin = [], 0, 0, 0
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if not runs or a > end:
            kept.append(text[begin:a])
            runs += 1
            end = b
        end = max(end, b)
        begin = end
    kept.append(text[begin:])
    return b"".join(kept), runs


RESULTS = ("kept", "n_bytes", "n_spans")


def drop_repeats(docs: DataFrame, span: int = 400, q: int = Q) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that stay), ``n_bytes`` and ``n_spans``; columns of ``docs`` with these
    names give way to them."""
    spans = land(repeated_spans(docs, span, q), "spans").withColumnRenamed("doc", "_span_doc")
    # the documents' own columns travel in a struct, where no name of theirs can clash
    rows = _identified(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    rows = rows.join(spans, rows["_doc"] == spans["_span_doc"], "left")

    @F.pandas_udf("kept binary, n_spans long")
    def apply(text, spans):  # noqa: ANN001 - pandas series
        import pandas as pd
        return pd.DataFrame([cut(t, s if s is None else list(s)) for t, s in zip(text, spans, strict=True)],
                            columns=["kept", "n_spans"])

    out = rows.withColumn("_cut", apply("_bytes", "spans"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return out.select(*own, "_cut.kept", F.octet_length("_bytes").cast("long").alias("n_bytes"), "_cut.n_spans")


def repeat_report(docs: DataFrame, span: int = 400, q: int = Q) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and whether it ``repeats`` (loses any byte)."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    removed = F.col("n_bytes") - F.octet_length("kept")
    return drop_repeats(thin, span, q).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (removed > 0).alias("repeats"))
