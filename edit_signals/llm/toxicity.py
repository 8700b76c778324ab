"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
short windows (a word, in pieces of at most ``WINDOW`` bytes, behind a lead-in both dictionaries
know, so that a block is always compressed); a window's gain is its compressed length under the
ordinary dictionary less that under the toxic one. A text's score comes from how many of its windows
gain at least 2, 3, ... bytes, all windows and those that the toxic dictionary explains whole (their
compressed length is the least there is). The thresholds and weights are calibrated on labelled documents that
the dictionaries were not trained on, and the score is placed so that 0.7 is the calibrated cut.

Dictionary content: the toxic one has the words over-represented in toxic text by log-likelihood
ratio of the *distinct neighbours* they follow (a copied passage brings the same neighbours again and
counts once), the ordinary one the commonest words of ordinary text. Both are raw-content
dictionaries: zstandard's own sampling of whole windows, tried first, spends them on syllables that
both classes share.

Windows that share no ``GRAM``-byte string with the toxic dictionary are not compressed: zstandard's
shortest match is that long here, so they cannot gain.

Labelled rows are a bounded, documented sample: the ``SAMPLE_DOCS`` labelled documents of each class
with the smallest hash; in the calibration a sampled document counts as often as its class has
labelled documents for each one sampled, so the cut does not depend on the sample's size. Scoring reads every whole text.

Edge cases: null, empty and word-less texts score like a text without gains; without labels of both
classes every score is 0; a document labelled more than once is toxic if any label says so; null
labels and ids are not learned from; repeated rows are scored each; extra columns are ignored by
``score_documents``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CACHE_ENTRIES
from .common import held_out, land, map_batches

SAMPLE_DOCS = 6_000  # of each class
CALIBRATE_1_IN = 4  # share of the sample kept from the dictionaries for calibration
DICTIONARY_BYTES = 4096
ORDINARY_BYTES = 2048
MIN_RATIO = 4.0  # how much likelier a dictionary word is in toxic text
MIN_LLR = 12.0
CANDIDATES = 4_000  # words of the statistics fetched to build a dictionary
LEVEL = 19
GRAM = 4
WINDOW = 48
GAINS = (2, 3, 4, 5, 6, 7)  # bytes; counted separately
SLACK = 1  # bytes a window explained whole may be longer than the shortest one
CUT = 0.7
LEAD = bytes([*range(1, 9), 11, 12, *range(14, 28)])
_WORD = re.compile(r"[^\W\d_]+")
_SHIFT = 40  # bits for one count in a packed sum


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None  # of the features, then the constant
    cut: float = 0.0


class Scorer:
    """The dictionaries opened for compression, and the gains already known."""

    def __init__(self, model: Model):
        self.ordinary, self.toxic = self._open(model.ordinary), self._open(model.toxic)
        text = model.toxic
        self.grams = {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}
        self.words: dict[str, int] = {}
        # the length of a window that is one word of the toxic dictionary: nothing shorter occurs
        self.least = min((found[1] for w in text[len(LEAD):].split() if (found := self.lengths(w))), default=0)

    @staticmethod
    def _open(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=len(LEAD) + WINDOW + 2, dict_size=len(content), min_match=GRAM,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def lengths(self, window: bytes) -> tuple[int, int] | None:
        """Compressed length under the ordinary and the toxic dictionary; None if they cannot differ."""
        padded = b" %b " % window
        if not any(padded[i:i + GRAM] in self.grams for i in range(len(padded) - GRAM + 1)):
            return None
        return len(self.ordinary.compress(LEAD + padded)), len(self.toxic.compress(LEAD + padded))

    def packed(self, chunk: str) -> int:
        """Number of windows of a chunk, and above it how many meet each threshold: a gain of each of
        GAINS, then the same of windows the toxic dictionary explains whole."""
        total = 0
        for word in _WORD.findall(chunk):
            raw = word.encode()
            for at in range(0, len(raw), WINDOW):
                total += 1
                found = self.lengths(raw[at:at + WINDOW])
                if found:
                    gain, explained = found[0] - found[1], found[1] <= self.least + SLACK
                    total += sum(1 << _SHIFT * (k + 1) for k, g in enumerate(GAINS) if gain >= g)
                    if explained:
                        total += sum(1 << _SHIFT * (k + 1) for k, g in enumerate(GAINS, len(GAINS)) if gain >= g)
        return total

    def counts(self, text: str) -> list[int]:
        """Windows of a text, then those that meet each threshold."""
        chunks = text.lower().split()
        known = self.words
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for c in set(chunks).difference(known):
            known[c] = self.packed(c)
        total = sum(map(known.__getitem__, chunks))
        return [total >> _SHIFT * k & (1 << _SHIFT) - 1 for k in range(2 * len(GAINS) + 1)]


def features(counts: np.ndarray) -> np.ndarray:
    """Counts and rates of gaining windows, on logarithmic scales; all 0 for a text without gains."""
    n, hits = np.maximum(counts[:, :1], 1), counts[:, 1:]
    return np.hstack([np.log1p(hits), np.log1p(100.0 * hits / n)])


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = model.toxic + b"\0" + model.ordinary
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, toxic of the bounded labelled sample outside the evaluation fold, one row a
    document, and how many labelled documents one of the sample stands for in each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = land(known, "labels")
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS) for t in (0, 1)]
    ids = F.broadcast(land(parts[0].union(parts[1]), "label-sample"))  # at most 2 * SAMPLE_DOCS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("_id"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands_for = {t: max(1.0, counts.get(t, 0) / SAMPLE_DOCS) for t in (0, 1)}
    one = rows.where(F.col("text").isNotNull()).groupBy("doc_id", "toxic").agg(  # repeated rows do not grow the sample
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return land(one.select("doc_id", "text", "toxic"), "labelled"), stands_for


def _calibration() -> F.Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(CALIBRATE_1_IN)) == 0


def word_statistics(labelled: DataFrame) -> DataFrame:
    """word, toxic, ordinary: the number of distinct words it follows in each class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs: dict[tuple[str, str, int], None] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = _WORD.findall(text.lower())
            pairs.update(dict.fromkeys((a, b, toxic) for a, b in zip([""] + words, words)))
        cols = list(zip(*pairs, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                           pa.array(cols[2], pa.int32())], ["before", "word", "toxic"])

    pairs = map_batches(labelled.select("text", "toxic"), run, "before string, word string, toxic int").select(
        "word", "toxic", F.xxhash64("before").alias("before")).distinct()
    return pairs.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))


def _dictionary(words: list[str], size: int) -> bytes:
    """The first words that fit, the first one last (nearest to what is compressed)."""
    out = b" "
    for word in words:
        raw = word.encode()[:WINDOW]
        if len(out) + len(raw) + 1 > size:
            break
        out = b" %b%b" % (raw, out)
    return LEAD + out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    labelled, stands_for = sample(docs, labels)
    stats = land(word_statistics(labelled.where(~_calibration())), "words")
    a, b = stats.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not a or not b:
        return Model(LEAD, LEAD, None)
    x, y = F.col("toxic").cast("double"), F.col("ordinary").cast("double")
    rate = (x + y) / F.lit(float(a + b))
    llr = x * F.log(x / F.lit(float(a)) / rate) + F.when(y > 0, y * F.log(y / F.lit(float(b)) / rate)).otherwise(0.0)
    strong = stats.where((x >= 2) & (x / F.lit(float(a)) > F.lit(MIN_RATIO) * y / F.lit(float(b)))).select("word", llr.alias("llr"))
    toxic = strong.where(F.col("llr") > MIN_LLR).orderBy(F.desc("llr"), "word").limit(CANDIDATES).collect()
    usual = stats.where("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(CANDIDATES).collect()
    model = Model(_dictionary([r["word"] for r in toxic], DICTIONARY_BYTES),
                  _dictionary([r["word"] for r in usual], ORDINARY_BYTES), None)
    held = gains(labelled.where(_calibration()), model, ["toxic"]).orderBy("doc_id").collect()  # at most 2 * SAMPLE_DOCS
    counts = np.array([r["counts"] for r in held], float).reshape(len(held), -1)
    truth = np.array([r["toxic"] for r in held], float)
    if truth.min(initial=1) < truth.max(initial=0):
        model.weights, model.cut = calibrate(features(counts), truth, np.where(truth == 1, stands_for[1], stands_for[0]))
    return model


def calibrate(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, and the linear score with the best F1; row i counts ``times[i]`` times."""
    times = np.ones(len(y)) if times is None else times
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    z = x @ w
    order = np.argsort(-z, kind="stable")
    right = np.cumsum((times * y)[order])
    f1 = 2 * right / (np.cumsum(times[order]) + (times * y).sum())
    f1[:-1][np.diff(z[order]) == 0] = 0  # a cut lies between different scores
    best = int(f1.argmax())
    below = z[order][best + 1:best + 2]
    return w, float((z[order][best] + below[0]) / 2 if below.size else z[order][best])


def gains(docs: DataFrame, model: Model, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, the columns to carry, counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer(shared.value)
        counts = [scorer.counts(t or "") for t in batch.column("text").to_pylist()]
        names = ["doc_id", *carry]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts, pa.list_(pa.int64()))],
                                          [*names, "counts"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ["doc_id", *carry])
    return map_batches(docs.select("doc_id", *carry, "text"), run, f"{schema}, counts array<bigint>")


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.7)."""
    model = train(docs, labels) if model is None else model
    rows = gains(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    if model.weights is None:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    weights, cut = model.weights, model.cut

    @F.pandas_udf("double")
    def score(counts):  # noqa: ANN001, ANN202 - pandas series
        import pandas as pd
        x = features(np.array(counts.tolist(), float).reshape(len(counts), -1))
        z = np.hstack([x, np.ones((len(x), 1))]) @ weights - cut + np.log(CUT / (1 - CUT))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    scored = rows.select("doc_id", held_out().alias("held_out"), score("counts").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
