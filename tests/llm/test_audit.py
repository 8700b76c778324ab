"""Whitening, source divergence and quality rules against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from edit_signals.llm import divergence, quality, whitening

# -- whitening ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component long, x string, n int"


def vectors_frame(spark, rows):
    """Rows of (vec_id, vector) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], VECTORS)


def test_spectral_components_match_the_library():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 40):
        for values in (rng.random(d), np.ones(d), np.where(np.arange(d) < 2, 5.0, 0.0), np.logspace(0, -10, d)):
            q, _ = np.linalg.qr(rng.standard_normal((d, d)))
            matrix = q @ np.diag(values) @ q.T
            got, axes = whitening.spectral_components(matrix)
            assert np.allclose(got, np.sort(values)[::-1], atol=1e-12)
            assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12)
            assert np.allclose(matrix @ axes, axes * got, atol=1e-12)


def test_qdwh_is_the_polar_factor():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    u, _, vt = np.linalg.svd(a)
    assert np.allclose(whitening.qdwh(a), u @ vt, atol=1e-12)


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(5)
    d = 6
    base = (rng.standard_normal((80, d)) * np.array([3, 2, 1.5, 1, 0.5, 0.2])).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(200 + k, base[3]) for k in range(50)] + [(7, base[7]), (None, base[9])]
    bad = [None, [None] * d, [1.0] * (d - 1) + [float("nan")], [float("inf")] * d, [1.0, 2.0], []]
    rows += [(300 + k, v) for k, v in enumerate(bad)]
    got = whitening.whiten(vectors_frame(spark, rows)).toPandas()
    good = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in good], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    assert len(got) == 4 * len(good) and (got["n"] == n).all() and (got["identity_error"] < 1e-10).all()
    want = Counter((i, int(v)) for (i, _), v in zip(good, ((n * x - sums) ** 2).sum(axis=1)))
    first = got[got["component"] == 1]
    assert Counter((None if np.isnan(i) else int(i), v) for i, v in zip(first["vec_id"], first["deviation"])) == want
    by_id = got[got["vec_id"] < 80].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    for c in range(1, 5):
        e, axis = values[-c], axes[:, -c]
        w = centred_projection(x[:80], sums / n, axis, e)
        assert np.allclose(np.abs(by_id[c].to_numpy()), np.abs(w), atol=1e-9)
        assert np.allclose(got[got["component"] == c]["explained"], e / values.sum(), rtol=1e-9)


def centred_projection(x, mean, axis, value):
    return (x - mean) @ axis / np.sqrt(value)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_frame(spark, [])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(1, None), (2, [None])])).count() == 0
    # one distinct vector: nothing varies
    rows = whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in rows) == [
        (i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    # fewer vectors than dimensions: components without variance have no scale
    rows = whitening.whiten(vectors_frame(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])])).collect()
    assert [r.whitened is None for r in sorted(rows, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 2
    # values beyond 64 bits are clamped, deviations beyond them null
    rows = whitening.whiten(vectors_frame(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert {r.vec_id: r.deviation for r in rows} == {1: None, 2: None, 3: 1}


def test_packed_vectors_round_trip():
    for x in ([0, -1, 5], [40_000, -1], [1 << 40, -(1 << 63)], [(1 << 63) - 1], []):
        assert whitening._unpack(whitening._pack(np.array(x, np.int64))).tolist() == x


# -- source divergence ------------------------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, source string, term string, sid long"


def brute_divergence(rows, min_docs, scale, top):
    folded = [(str(lang or ""), str(source or ""), [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                                                    for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
              for _, text, lang, source in rows]
    out = []
    for lang in {g[0] for g in folded}:
        mine = [g for g in folded if g[0] == lang]
        held = Counter(t for _, _, ts in mine for t in set(ts))
        kept = {t for t, n in held.items() if n >= min_docs}
        total = Counter(t for _, _, ts in mine for t in ts if t in kept)
        counts = {s: Counter(t for _, s2, ts in mine if s2 == s for t in ts if t in kept) for s in {g[1] for g in mine}}

        def p(c, t):
            return 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p(c, t), p(total, t))) for t in kept if c[t] and p(c, t) > p(total, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return sorted(out)


def divergence_rows(seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150)] + ["Éa", "éa", "ß", "日本", "It", "IT"]
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "s3", "ä", None])
        size = rng.choice([0, 1, 5, 60])
        rows.append((i, " ".join(rng.choice(words[: rng.choice([4, 40, 156])]) + rng.choice(["", ".", "1x", "-"]) for _ in range(size)),
                     lang, source))
    return rows + [(500, None, "en", "empty"), (501, "", "xx", None), (502, "12 ..", "xx", "t"), rows[0], rows[0]]


@pytest.mark.parametrize("block", [32, 2])
def test_divergence_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "RARE_TERMS", 70)
    monkeypatch.setattr(divergence, "FREQUENT_TERMS", 9)
    rows = divergence_rows(block)
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], TEXTS).repartition(3)
    got = divergence.source_divergence(docs, min_docs=3, scale=1_000_000_000, terms=20)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 3, 1_000_000_000, 20)


def test_divergence_folds_in_parts(spark, monkeypatch):
    """Whatever a task hands on early is summed again."""
    monkeypatch.setattr(divergence, "FOLD_ENTRIES", 1)
    rows = divergence_rows(9)
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], TEXTS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    en = [r for r in rows if r[2] == "en" and r[3] == "s0"]
    want = Counter(t for r in en for t in re.findall(r"w[a-z]+", r[1]))
    assert {t: n for (g, s, t), (n, _) in got.items() if (g, s) == ("en", "s0") and t and t.startswith("w")} == dict(want)


def test_divergence_held_terms_are_dealt_once(spark):
    """Counts, totals of the language and the kept terms by brute force, with one shuffle by (lang, term) and no join."""
    rows = divergence_rows(4) + [(600, " A\tb\u00a0 _É ", "en", "odd"), (601, None, None, "none")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], TEXTS).repartition(3)
    held = divergence._held_terms(divergence.term_counts(docs), 3)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    n, found = Counter(), {}
    for place, (_, text, lang, source) in enumerate(rows):
        for word in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
            term = re.sub("[A-Z]", lambda m: m.group().lower(), word)
            n[lang or "", source or "", term] += 1
            found.setdefault((lang or "", term), set()).add(place)
    want = {(lang, s, t): (k, sum(v for (a, _, b), v in n.items() if (a, b) == (lang, t)))
            for (lang, s, t), k in n.items() if len(found[lang, t]) >= 3}
    got = held.collect()
    assert {(r.lang, r.source, r.term): (r.n, r.total) for r in got if r.term is not None} == want
    assert Counter((r.lang, r.term) for r in got if r["first"]) == Counter({(lang, t) for lang, _, t in want})
    assert sorted((r.lang, r.source) for r in got if r.term is None) == sorted({(r[2] or "", r[3] or "") for r in rows})


def test_divergence_edges(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert divergence.source_divergence(empty).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", "t", 1), (2, None, "en", "u", "t", 1)], TEXTS)
    assert sorted(map(tuple, divergence.source_divergence(one).collect())) == [
        ("en", "s", "pair", "u", 0, 1), ("en", "u", "pair", "s", 0, 1)]
    long = "word " * 400_000 + "Other"
    docs = spark.createDataFrame([(k, long, "en", f"s{k % 2}", "t", 1) for k in range(4)], TEXTS)
    got = divergence.source_divergence(docs)
    assert {(r.source, r.item, r.value) for r in got.where("part = 'pair'").collect()} == {("s0", "s1", 0), ("s1", "s0", 0)}


# -- quality rules -----------------------------------------------------------------------------

DOCS = "doc_id long, text string, kept string, n_words int, lang string"


def quality_frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", 7, "x") for i, t in texts], DOCS)


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def quality_texts(seed=2):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a", "é ü b", "x " * 9, "x y " * 6, "|#*$%&<>", "日本語。 " * 3]
    for _ in range(60):
        words = [rng.choice(["aa", "b", "ça", "d.", "x|", "日"]) for _ in range(rng.choice([8, 12, 50, 300]))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b", "  \n"]) for w in words))
    return list(enumerate(texts)) + [(3, "a"), (None, texts[12])]


def test_quality_base_brute_force(spark):
    texts = quality_texts()
    got = quality.assess(quality_frame(spark, texts)).collect()
    key = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert key == Counter((i, *brute_base(t)) for i, t in texts)
    assert not any(r.kept and r.base_failed for r in got)


def test_repeated_windows_with_equal_hashes(monkeypatch):
    """Windows that share a hash but not their words are told apart."""
    rng = np.random.default_rng(1)
    codes, text = rng.integers(0, 4, 4000), np.repeat([0, 1], 2000)
    brute = [brute_base(" ".join(map(str, codes[text == k])))[4] for k in (0, 1)]
    assert quality.repeated_words(codes, text, 2).tolist() == brute
    real = quality._window_hash
    monkeypatch.setattr(quality, "_window_hash", lambda *a: real(*a) % np.uint64(5))
    assert quality.repeated_words(codes, text, 2).tolist() == brute


PROSE = "The river rose in the night, and by morning the lower road was under water. Nobody had slept much.\n" \
        "They moved the cattle first. Then came the long work of carrying everything else up the hill.\n"


def test_quality_lines():
    bad = [b"Home | About | Contact", b"Ortionst | erheerre | ndingti. |", b"We use cookies to improve this site.", b"Thsh",
           b"wht### is%%% the&&& ndtion***.", b"THE!! EDTION!! OF!! IT!!", "Start › Forum › Hilfe.".encode(), b"Licensed under CC BY-NC 4.0.",
           b"word " * 40]
    good = [b"They moved the cattle first.", "«Oui», dit-il.".encode(), "どうぞ。".encode(), b"Is it, or is it not?", b"He said: \"No.\"",
            b"It rose fast. It rose in the night, and nobody had slept much when the", b"A copyrighted poem is not mentioned here."]
    assert [quality.line_fails(x) for x in bad] == [True] * len(bad)
    assert [quality.line_fails(x) for x in good] == [False] * len(good)


def test_quality_verdict_and_clean(spark):
    nav = "Home | About | Contact | Login\n"
    texts = [(1, PROSE + nav), (2, nav * 3 + "Home | Work | Play | More\n" + "A short sentence of prose here."), (3, PROSE + "\n\n" + PROSE),
             (4, None), (5, ""), (6, PROSE), (6, PROSE)]
    docs = quality_frame(spark, texts)
    assert sorted((r.doc_id, r.kept) for r in quality.assess(docs).collect()) == [
        (1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (6, True)]
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, PROSE, "k", 7, "x")] + [(6, PROSE, "k", 7, "x")] * 2
    empty = spark.createDataFrame([], DOCS)
    assert quality.assess(empty).count() == 0 and quality.clean(empty).count() == 0


def test_quality_long_text(spark):
    text = "".join(f"Sentence number {k} of a long text ends here.\n" for k in range(120_000))
    r = quality.assess(quality_frame(spark, [(1, text)])).first()
    assert (r.n_words, r.n_dup_lines, r.kept) == (9 * 120_000, 0, False)  # the end of the sentence repeats
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(text)
