"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from labelled text. A text is cut into phrases, each
the longest stretch that occurs in that labelled text (the automaton is followed until it has no
transition, which ends the phrase). Related text is parsed into few long phrases, foreign text into many short
ones. But phrases also grow with the labelled text they are looked up in, as the logarithm of its length: naming
a place in a reference of N characters takes log N bits, less a constant. So a language's phrases are weighted with that
(their sum is the cross entropy of the text against that reference), and the fewest normalised phrases win. A language
with little labelled text is neither favoured nor drowned; references of equal length are compared by plain counts.

The automata are transition tables, dense (state x symbol) for the commonest characters of the
sample and a sorted list of (state, symbol) keys for all its other ones, so that no sampled
character is merged with another. A batch of texts is parsed column by column: all texts are laid out as windows of ``WINDOW`` characters and advance one character
together, in every language. Each window starts a phrase of its own, alike for every language.

Labelled text is a bounded, documented sample: about ``SAMPLE_CHARS`` characters over all languages
in equal shares, taken as one stretch of ``STRETCH`` characters each of distinct texts chosen by hash (at
most ``2 * OVERSAMPLE`` times what is needed is fetched). Its size bounds the tables sent to the
executors. Classification reads whole texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with no labelled text
every text is ``und``; ties go to the language first in alphabetical order; repeated rows are
judged each on its own; null labels are not learned from; extra columns are ignored by
``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

UNKNOWN = "und"
SAMPLE_CHARS = 96_000
STRETCH = 400
OVERSAMPLE = 4  # stretches fetched for each one needed, as texts shorter than STRETCH give less
WINDOW = 256
SYMBOLS = 64
PAST_END = -1
# Characters of a reference for each place a phrase is looked up at, in the weight of a phrase: measured on pairs of
# languages with 300 and 4 labelled texts (97 to 100 % of the small one's texts right; 93 to 100 % with 1).
PLACE_CHARS = 8
PARSE_CHARS = 1 << 20  # characters parsed together; bounds a worker's arrays


@dataclass
class Automata:
    """One suffix automaton per language, as tables over a shared alphabet."""

    languages: list[str]
    alphabet: dict[str, int]  # symbol 0: white space, SYMBOLS - 1: any character not listed, from SYMBOLS on: rare ones
    tables: list[np.ndarray]  # dense, of the symbols below SYMBOLS
    rare: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # sorted keys and targets of the other symbols
    sizes: list[int] = field(default_factory=list)  # symbols of the labelled text of every language

    def weights(self) -> np.ndarray:
        """What a phrase of every language counts: log of its reference's length, relative to the longest one."""
        if not self.sizes:
            return np.ones(len(self.languages))
        bits = np.log2(np.maximum(np.array(self.sizes, float) / PLACE_CHARS, 2))
        return bits / bits.max()


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a symbol sequence; -1 where there is none."""
    return _dense(_transitions(symbols), width)


def _transitions(symbols: list[int]) -> list[dict[int, int]]:
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _dense(nxt: list[dict[int, int]], width: int) -> np.ndarray:
    table = np.full((len(nxt), width), -1, np.int32)
    for state, moves in enumerate(nxt):
        for c, to in moves.items():
            if c < width:
                table[state, c] = to
    return table


def _sparse(nxt: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and targets of the transitions on symbols from ``width`` on, by key."""
    moves = sorted((_key(state, c), to) for state, found in enumerate(nxt) for c, to in found.items() if c >= width)
    return np.array([k for k, _ in moves], np.int64), np.array([to for _, to in moves], np.int64)


def _key(state, symbol):  # noqa: ANN001, ANN202 - numbers or arrays
    return (state << 32) + symbol


def train(docs: DataFrame) -> Automata:
    """Automata of the labelled rows outside the evaluation fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    hashes = labelled.select("lang", F.xxhash64("text").alias("h"))  # copies have one hash and are drawn once
    rows = {r["lang"]: r for r in hashes.groupBy("lang").agg(F.countDistinct("h").alias("n"), F.min("h").alias("first")).collect()}
    if not rows:
        return Automata([], {}, [])
    share = max(STRETCH, SAMPLE_CHARS // len(rows))
    want = OVERSAMPLE * -(-share // STRETCH)  # stretches a language is expected to get
    rate = F.create_map(*[x for lang, r in rows.items() for x in (F.lit(lang), F.lit(min(1.0, want / r["n"])))])
    first = F.create_map(*[x for lang, r in rows.items() for x in (F.lit(lang), F.lit(r["first"]).cast("long"))])
    place = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1)
    picked = labelled.withColumn("h", F.xxhash64("text")).where(
        (F.pmod("h", F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)) | (F.col("h") == first[F.col("lang")]))  # no language is left out
    parts = picked.select("lang", "h", F.substr("text", (place + 1).cast("int"), F.lit(STRETCH)).alias("part")).distinct()
    sample: dict[str, str] = {}
    for r in parts.orderBy("h", "part", "lang").limit(2 * want * len(rows)).collect():
        got = sample.get(r["lang"], "")
        if len(got) < share:
            sample[r["lang"]] = f"{got}\n{r['part'].lower()}"[:share]
    counts: dict[str, int] = {}
    for text in sample.values():
        for ch in text:
            if not ch.isspace():
                counts[ch] = counts.get(ch, 0) + 1
    ranked = sorted(counts, key=lambda ch: (-counts[ch], ch))
    alphabet = {ch: k + 1 for k, ch in enumerate(sorted(ranked[:SYMBOLS - 2]))}
    alphabet |= {ch: k + SYMBOLS for k, ch in enumerate(sorted(ranked[SYMBOLS - 2:]))}
    model = Automata(sorted(sample), alphabet, [])
    for lang in model.languages:
        symbols = _symbols(sample[lang], alphabet).tolist()
        moves = _transitions(symbols)
        model.sizes.append(len(sample[lang]))
        model.tables.append(_dense(moves, SYMBOLS))
        model.rare.append(_sparse(moves, SYMBOLS))
    return model


def _symbols(text: str, alphabet: dict[str, int]) -> np.ndarray:
    """Symbol numbers of a text; runs of white space are one symbol 0."""
    codes = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32)
    table = _code_table(alphabet)
    return table[np.minimum(codes, table.size - 1)]


_tables: dict[int, tuple[dict[str, int], np.ndarray]] = {}


def _code_table(alphabet: dict[str, int]) -> np.ndarray:
    known = _tables.get(id(alphabet))
    if known is None or known[0] is not alphabet:
        top = max([32, *map(ord, alphabet)])
        table = np.full(top + 2, SYMBOLS - 1, np.int32)  # the last entry stands for every code above
        table[32] = 0
        for ch, k in alphabet.items():
            table[ord(ch)] = k
        _tables.clear()
        known = _tables[id(alphabet)] = (alphabet, table)
    return known[1]


def phrases(texts: list[np.ndarray], model: Automata) -> np.ndarray:
    """Number of phrases of every text (rows) in every language (columns)."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    pieces, owner = [], []
    for k, s in enumerate(texts):
        n = -(-s.size // WINDOW)
        padded = np.full(n * WINDOW, PAST_END, np.int32)
        padded[:s.size] = s
        pieces.append(padded)
        owner.append(np.full(n, k))
    if not pieces:
        return out
    grid = np.concatenate(pieces).reshape(-1, WINDOW)
    of = np.concatenate(owner)
    for at in range(0, of.size, PARSE_CHARS // WINDOW):
        part, text = grid[at:at + PARSE_CHARS // WINDOW], of[at:at + PARSE_CHARS // WINDOW]
        columns = np.ascontiguousarray(part.T)
        listed = [np.flatnonzero(c >= SYMBOLS) for c in columns]
        for lang, table in enumerate(model.tables):
            rare = model.rare[lang] if model.rare else (np.zeros(0, np.int64),) * 2
            np.add.at(out[:, lang], text, _parse(columns, listed, table, rare))
    return out


def _parse(columns: np.ndarray, listed: list[np.ndarray], table: np.ndarray, rare: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Phrases of every window; columns[i] has the i-th symbol of all windows, listed[i] where it is a rare one."""
    flat, start = table.ravel(), table[0]
    state = np.zeros(columns.shape[1], np.int64)
    count = np.zeros(columns.shape[1], np.int64)
    for c, at in zip(columns, listed, strict=True):
        inside = c != PAST_END
        c0 = np.clip(c, 0, SYMBOLS - 1).astype(np.int64)
        to, first = flat[state * SYMBOLS + c0], start[c0]
        if at.size:
            to[at], first[at] = _look_up(rare, state[at], c[at]), _look_up(rare, 0, c[at])
        count += inside & ((to < 0) | (state == 0))  # a phrase opens here
        state = np.where(to >= 0, to, np.maximum(first, 0))  # a symbol the language lacks is a phrase alone
    return count


def _look_up(rare: tuple[np.ndarray, np.ndarray], state, symbols: np.ndarray) -> np.ndarray:  # noqa: ANN001 - number or array
    keys, targets = rare
    if not keys.size:
        return np.full(symbols.size, -1)
    wanted = _key(state, symbols.astype(np.int64))
    place = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(keys[place] == wanted, targets[place], -1)


def with_language(docs: DataFrame, model: Automata | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, how clearly the language wins)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(text):  # noqa: ANN001, ANN202 - pandas series
        import pandas as pd
        return pd.DataFrame(_judge(text.tolist(), shared.value), columns=["lang_pred", "score"])

    return docs.withColumn("_lang", judge("text")).select(*docs.columns, "_lang.lang_pred", "_lang.score")


def _judge(texts: list[str | None], model: Automata) -> list[tuple[str, float]]:
    out = [(UNKNOWN, 0.0)] * len(texts)
    group: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if t and model.languages and any(map(str.isalpha, t)):
            group.append(k)
            size += len(t)
        if group and (size >= PARSE_CHARS or k == len(texts) - 1):
            counts = phrases([_symbols(texts[i], model.alphabet) for i in group], model) * model.weights()
            for i, n in zip(group, counts, strict=True):
                best = int(n.argmin())
                out[i] = model.languages[best], _score(n, best)
            group, size = [], 0
    return out


def _score(n: np.ndarray, best: int) -> float:
    """The winner's share if a language's weight halves with every normalised phrase beyond the winner's."""
    return float(1 / np.exp2(-np.minimum(n - n[best], 1000.0)).sum())


def identify(docs: DataFrame, model: Automata | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(thin) if model is None else model
    return with_language(thin.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Automata | None = None) -> DataFrame:
    """Rows whose language could be told, as they came."""
    model = train(docs) if model is None else model
    found = with_language(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")
