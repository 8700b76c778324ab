"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch of pre-tokens is one flat symbol array with a sequence number per symbol. Each step looks
up the rank of every adjacent pair, takes the lowest rank of every sequence, and merges that pair
everywhere in all sequences at once. A merge only creates pairs of higher rank (a pair's parts
exist before the pair in the merge list), so merging every occurrence of the lowest pair together
gives what one-at-a-time merging gives. Sequences without a mergeable pair leave the arrays; the
symbols they have left are their tokens.

Edge cases: null and empty texts have 0 tokens; special strings inside a text are one token each;
repeated rows are counted each on its own; extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CACHE_ENTRIES, chunk_words, is_plain, library, plain_chunks, split_specials
from .common import map_batches

NO_PAIR = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Merges:
    """Merge ranks of one vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at = keys[order], order.astype(np.int32)

    def ranks(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Rank of the pair (i, i+1) within one sequence, NO_PAIR where there is none."""
        out = np.full(sym.size, NO_PAIR, np.int32)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        key = sym[inside] * self.size + sym[inside + 1]
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        known = self.keys[at] == key
        out[inside[known]] = self.rank_at[at[known]]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of every (non-empty) pre-token."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, last = self.inner[raw], np.cumsum(length) - 1
        sym[last] = self.final[raw[last]]
        seq = np.repeat(np.arange(len(words)), length)
        while sym.size:
            rank = self.ranks(sym, seq)
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(first, sym.size))
            low = np.minimum.reduceat(rank, first)
            done = low == NO_PAIR
            out[seq[first[done]]] = size[done]
            hit = np.flatnonzero((rank == np.repeat(low, size)) & (rank != NO_PAIR))
            if hit.size:  # in a run of overlapping pairs every second one merges, from the left
                opens = np.concatenate(([True], np.diff(hit) != 1))
                start = hit[opens][np.cumsum(opens) - 1]
                hit = hit[(hit - start) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = np.repeat(~done, size)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


_seen: dict[str, dict[str, int]] = {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the library counts them, special strings included."""
    table = merges(path)
    seen = _seen.setdefault(path, {})
    if len(seen) > CACHE_ENTRIES:
        seen.clear()
    chunked: list[list[str] | None] = []
    odd: list[tuple[int, int, list[bytes]]] = []
    for i, text in enumerate(texts):
        if is_plain(text):
            chunks = plain_chunks(text)
            chunked.append(chunks)
        else:
            chunked.append(None)
            odd.append((i, *_odd_words(text, path, table)))
    fresh = list(set(chain.from_iterable(c for c in chunked if c)).difference(seen))
    words: dict[bytes, int] = {}
    parts = [[words.setdefault(w.encode(), len(words)) for w in chunk_words(c)] for c in fresh]
    odd_parts = [[words.setdefault(w, len(words)) for w in ws] for _, _, ws in odd]
    n = table.counts(list(words)).tolist()
    seen.update(zip(fresh, (sum(n[k] for k in p) for p in parts), strict=True))
    out = [0 if c is None else sum(map(seen.__getitem__, c)) for c in chunked]
    for (i, specials, _), p in zip(odd, odd_parts, strict=True):
        out[i] = specials + sum(n[k] for k in p)
    return out


def _odd_words(text: str, path: str, table: Merges) -> tuple[int, list[bytes]]:
    """Special strings, and pre-tokens by the library's own normaliser and splitter."""
    lib = library(path)
    stretches, specials = split_specials(text)
    words = [w for s in stretches for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(s))]
    return specials, [bytes(table.byte_of[c] for c in w) for w in words if w]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        n = count_tokens(texts, path)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
             pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
