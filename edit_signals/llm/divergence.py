"""How far the sources of a language diverge: count-level bitmaps of terms.

A group is a (lang, source) pair; with ``p = 1 + floor(scale * (count + 1) / (N + V))`` of every term a
language keeps, a group is compared with every other source of its language (sum of
``floor((p - q)^2 / q)`` over all terms) and, term by term, with its whole language.

Method. All terms of a group with the same count have the same ``p``. So the terms a language keeps are
dealt into chunks and numbered in them, and per (group, chunk, count) the set of term numbers is one
bitmap. For two groups, AND and popcount of a bitmap of the one with a bitmap of the other give the
number of terms in that joint cell; it is multiplied by ``f`` of the two counts, once per cell and not per
term. Terms a group lacks are the complement of its bitmaps, one more level with count zero.

Scale.

* Counting: every task folds bounded lots of words, by sorting their codes, so only (group, term) sums are
  shuffled. A hot group or word is folded before it moves. They are dealt by (lang, term), where the
  sums of a group and those of its language are both at hand, so no join brings them together.
* Chunks take terms of like frequency: many rare terms share few counts (wide bitmaps), frequent ones have
  many counts each (narrow bitmaps), so the cells of a chunk stay near its number of terms.
* Pairs are worked on per (chunk, block of sources, block of sources): a task holds two blocks of at
  most ``BLOCK`` sources and one chunk, whatever the number of sources or terms.
* The table of groups is attached by a join Spark may broadcast after its rows were counted.

Arithmetic is exact: ``p`` in decimal(38,0), ``f`` and the sums in 64-bit integers (a scale of 10^9 keeps
them below 2^63).

Edge cases: null text, lang and source are read as ''. Every row is a document, repeated rows too.
A group without a term takes part (all its counts are zero); a language with one source has no pair; with no
kept term every pair has value 0. Ties rank by item in UTF-8 order. An empty table gives an empty result.
Other columns are not read. A very long text costs memory in proportion to its own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, text_bytes

# ASCII letters, lower-cased, and every other character but ASCII belong to a term.
_TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
# Words and texts a task gathers before it folds them and hands them on: bounds memory, not the result.
FOLD_ENTRIES = 3_000_000
# Terms found up to so often in a language are rare; terms per chunk of rare and of frequent terms.
RARE = 32
RARE_TERMS, FREQUENT_TERMS = 2048, 128
# Sources per block of the pair work.
BLOCK = 32
# The table of groups is broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def _folded(langs: pa.Array, sources: pa.Array, terms: pa.Array, of: np.ndarray) -> pa.RecordBatch:
    """(lang, source, term) with occurrences and texts of some documents; ``of`` is the document of every term,
    ascending. Every group also has one row with a null term, whose counts are zero."""
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    n_sources = max(1, len(source.dictionary))
    every, group = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)
    words = terms.dictionary_encode()
    # documents are renumbered by group, so one sort of (word, document) brings the runs of (word, group) together
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(by_group), np.int64)
    place[by_group] = np.arange(len(by_group))
    key = np.sort(words.indices.to_numpy().astype(np.int64) * max(1, len(place)) + place[of])
    word, group = key // max(1, len(place)), group[by_group][key % max(1, len(place))]
    new = np.ones(len(key), bool)
    new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(key))
    docs = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    group = every[np.concatenate([group[at], np.arange(len(every))])]
    term = pa.concat_arrays([words.dictionary.take(pa.array(word[at])), pa.nulls(len(every), pa.string())])
    none = np.zeros(len(every), np.int64)
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(group // n_sources)), source.dictionary.take(pa.array(group % n_sources)), term,
         pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))],
        names=["lang", "source", "term", "n", "docs"])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts, and the text (its place) of every term."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = pa.concat_arrays([texts]).buffers()
    if data is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, ends, pa.py_buffer(data.to_pybytes().translate(_TERM_BYTES))],
                                  offset=texts.offset)
    found = pc.ascii_split_whitespace(clean)
    terms, of = found.flatten(), pc.list_parent_indices(found).to_numpy()
    some = pc.greater(pc.binary_length(terms), 0)  # spaces at the ends leave empty pieces
    return terms.filter(some).cast(pa.string()), of[some.to_numpy(zero_copy_only=False)].astype(np.int64)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Per (lang, source, term): ``n`` occurrences and ``docs`` texts holding it. Every group has one more row,
    with a null term and counts of zero. Rows are dealt by (lang, term)."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    rows = docs.select(known(lang).alias("lang"), known(source).alias("source"), text_bytes(text).alias("text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, pa.Array, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                starts = np.cumsum([0] + [len(h[0]) for h in held])
                langs, sources, terms = (pa.concat_arrays([h[k] for h in held]) for k in range(3))
                whole = _folded(langs, sources, terms, np.concatenate([h[3] + s for h, s in zip(held, starts)]))
                held.clear()
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("lang"), batch.column("source"), *_words(batch.column("text"))))
                if sum(len(h[0]) + len(h[2]) for h in held) > FOLD_ENTRIES:
                    yield from emit()
        yield from emit()

    parts = rows.mapInArrow(fold, "lang string, source string, term string, n long, docs long")
    # the folds have little left to sum inside a task, so rows are dealt at once and summed where all of a term are
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _held_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """The counts of terms their language keeps, with the term's ``total`` there and ``first`` on one row of each, and the
    rows without a term."""
    of_term = Window.partitionBy("lang", "term")
    held = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("_docs"),
                         (F.col("term").isNotNull() & (F.col("source") == F.min("source").over(of_term))).alias("first"))
    return held.where(F.col("term").isNull() | (F.col("_docs") >= min_docs)).drop("_docs")


def _groups(held: DataFrame) -> DataFrame:
    """Per group: its number ``sid`` in its language, its occurrences of kept terms, and its language's terms, rare
    terms, occurrences and groups."""
    per = held.groupBy("lang", "source").agg(
        F.sum("n").alias("total_n"), F.count_if("first").alias("_terms"),
        F.count_if(F.col("first") & (F.col("total") <= RARE)).alias("_rare"))
    of_lang = Window.partitionBy("lang")
    return per.select("lang", "source", "total_n", *[F.sum(c).over(of_lang).alias(k) for c, k in (
        ("_terms", "n_terms"), ("_rare", "n_rare"), ("total_n", "lang_total"))],
        F.count(F.lit(1)).over(of_lang).alias("n_sources"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("sid"))


def _p(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """``1 + floor(scale * (count + 1) / (total + terms))``, exact."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(18,0)")
    return (1 + F.call_function("div", top, (total + terms).cast("decimal(20,0)"))).cast("bigint")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _attach(rows: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if small else table, keys)


def _with_chunks(rows: DataFrame) -> DataFrame:
    """``chunk`` of every kept term (by hash, among chunks of terms of like frequency), its number ``bit`` there and the chunk's ``size``."""
    rare = F.col("total") <= RARE
    chunks = F.ceil(F.when(rare, F.col("n_rare") / RARE_TERMS).otherwise((F.col("n_terms") - F.col("n_rare")) / FREQUENT_TERMS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks.cast("bigint")) * 2 + rare.cast("bigint"))
    chunk = Window.partitionBy("lang", "chunk")
    rows = rows.withColumn("bit", F.dense_rank().over(chunk.orderBy("term")) - 1)  # a term has a row per source
    return rows.withColumn("size", F.max("bit").over(chunk) + 1)


def _bitmaps(bits: np.ndarray, level: np.ndarray, levels: int, words: int) -> np.ndarray:
    """Bitmaps of the levels, ``words`` 64-bit words each."""
    out = np.zeros((levels, words), np.uint64)
    np.bitwise_or.at(out, (level, bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return out


def _levels(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, p, whether count zero, bitmap) of every level of a block. A row without a bit gives the
    ``p`` of count zero, whose bitmap is the complement of the source's others."""
    words = (size + 63) >> 6
    zero, some = rows[rows["bit"].isna()], rows[rows["bit"].notna()]
    (s_code, sids), (p_code, ps) = (pd.factorize(some[c].to_numpy(np.int64)) for c in ("sid", "p"))
    level, found = pd.factorize(s_code * max(1, len(ps)) + p_code)
    maps = _bitmaps(some["bit"].to_numpy(np.int64), level, len(found), words)
    sid, p = sids[found // max(1, len(ps))], ps[found % max(1, len(ps))]
    every = _bitmaps(np.arange(size), np.zeros(size, np.int64), 1, words)[0]
    zero_sid = zero["sid"].to_numpy(np.int64)
    order = np.argsort(zero_sid)
    seen = np.zeros((len(zero), words), np.uint64)
    np.bitwise_or.at(seen, order[np.searchsorted(zero_sid, sid, sorter=order)], maps)
    return (np.concatenate([sid, zero_sid]), np.concatenate([p, zero["p"].to_numpy(np.int64)]),
            np.vstack([maps, every & ~seen]))


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a chunk over two blocks of sources: cells by AND and popcount, times ``f``, both ways round."""
    size = int(rows["size"].iloc[0])
    a_sid, a_p, a_maps = _levels(rows[rows["side"] != 2], size)
    b_sid, b_p, b_maps = _levels(rows[rows["side"] != 1], size)
    a0, b0 = int(a_sid.min()), int(b_sid.min())
    shape = (int(a_sid.max()) - a0 + 1, int(b_sid.max()) - b0 + 1)
    there, back = np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape[0] * shape[1], np.int64)
    step = max(1, (1 << 22) // len(b_sid))
    for at in range(0, len(a_sid), step):
        joint = np.zeros((min(step, len(a_sid) - at), len(b_sid)), np.uint16)
        for w in range(a_maps.shape[1]):
            joint += np.bitwise_count(a_maps[at:at + step, w, None] & b_maps[None, :, w])
        i, j = np.nonzero(joint)
        n, i = joint[i, j].astype(np.int64), i + at
        cell = (a_sid[i] - a0) * shape[1] + (b_sid[j] - b0)
        square = (a_p[i] - b_p[j]) ** 2
        np.add.at(there, cell, n * (square // b_p[j]))
        np.add.at(back, cell, n * (square // a_p[i]))
    own = bool((rows["side"] == 0).any())  # a block with itself has each pair both ways in ``there``
    s, t = (x.ravel() for x in np.meshgrid(np.arange(shape[0]) + a0, np.arange(shape[1]) + b0, indexing="ij"))
    known = np.isin(s, a_sid) & np.isin(t, b_sid) & (s != t)
    s, t, there, back = s[known], t[known], there[known], back[known]
    if own:
        return pd.DataFrame({"sid": s, "other": t, "value": there})
    return pd.DataFrame({"sid": np.concatenate([s, t]), "other": np.concatenate([t, s]), "value": np.concatenate([there, back])})


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                      min_docs: int = 3, scale: int = 1_000_000_000, terms: int = 200) -> DataFrame:
    """The audit: part ``pair`` has every other source of a group's language, part ``term`` the ``terms``
    terms by which a group exceeds its language most. Columns lang, source, part, item, value, rank."""
    held = land(_held_terms(term_counts(docs, lang, source, text), min_docs), "divergence-held")
    groups = land(_groups(held), "divergence-groups")
    small = groups.count() <= BROADCAST_ROWS
    zero = _p(F.lit(0), F.col("total_n"), F.col("n_terms"), scale)
    p = _p(F.col("n"), F.col("total_n"), F.col("n_terms"), scale)
    q = _p(F.col("total"), F.col("lang_total"), F.col("n_terms"), scale)
    rows = _attach(held.where(F.col("term").isNotNull()), groups, ["lang", "source"], small)

    # part term: what the group has in excess of its language
    excess = rows.select("lang", "source", F.col("term").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q").select(
        "lang", "source", "item", _f(F.col("_p"), F.col("_q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    deal = F.pmod(F.xxhash64("item"), F.lit(16))  # a group's terms are cut down in parts first
    best = excess.withColumn("_part", deal).withColumn("_r", F.row_number().over(
        Window.partitionBy("lang", "source", "_part").orderBy(*order))).where(F.col("_r") <= terms)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(
        F.col("rank") <= terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # part pair: bitmaps per (source, count) and chunk, met block by block
    bits = rows.select("lang", "term", "total", "n_terms", "n_rare", "n_sources", "sid", p.alias("p"))
    bits = land(_with_chunks(bits).select("lang", "chunk", "size", "n_sources", "sid", "p", "bit"), "divergence-bits")
    absent = _attach(bits.select("lang", "chunk", "size").distinct(), groups, ["lang"], small).select(
        "lang", "chunk", "size", "n_sources", "sid", zero.alias("p"), F.lit(None).cast("int").alias("bit"))
    block = F.floor(F.col("sid") / BLOCK)
    blocks = F.floor((F.col("n_sources") - 1) / BLOCK)
    # a block meets itself (side 0) and every other: as the first (1) of the later ones, as the second (2) of the earlier ones
    meets = bits.unionByName(absent).withColumn("_b", block).withColumn(
        "_o", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks))).select(
        "lang", "chunk", F.least("_b", "_o").alias("first"), F.greatest("_b", "_o").alias("second"), "sid", "p", "bit", "size",
        F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2).alias("side"))

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sums = _pair_sums(rows)
        sums.insert(0, "lang", key[0])
        return sums

    sums = meets.groupBy("lang", "chunk", "first", "second").applyInPandas(work, "lang string, sid long, other long, value long")
    sums = sums.groupBy("lang", "sid", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "sid", "source")
    pairs = _attach(names, names.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang"], small).where(
        "sid <> other").join(sums, ["lang", "sid", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pairs.unionByName(best)
