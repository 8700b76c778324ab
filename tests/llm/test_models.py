"""Classification, search, archives, decontamination and the pipeline against brute force."""

from __future__ import annotations

import gzip
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edit_signals.llm import decontam, langid, queries, topk, toxicity, warc
from edit_signals.llm.common import table
from tests.llm.test_dedup import DOCS, VOCAB, brute_components, brute_fingerprint, brute_lines, corpus, docs_frame

SF = "/root/testdata/sf0.01"


# -- language ------------------------------------------------------------------------------

def test_suffix_automaton_has_all_substrings():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(60)]
    t = langid.suffix_automaton(s, 4)
    have = {tuple(s[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(3000):
        w = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7)))
        state = 0
        for c in w:
            state = t[state, c] if state >= 0 else -1
        assert (state >= 0) == (w in have)


def test_phrases_match_greedy_parse():
    rng = random.Random(2)
    refs = ["abcab cabba acca", "xyzzy yxxyz zzyx"]
    alphabet = {c: k + 1 for k, c in enumerate("abcxy")}
    symbols = [langid._symbols(r, alphabet) for r in refs]
    model = langid.Automata(["a", "x"], alphabet, [langid.suffix_automaton(s.tolist(), langid.SYMBOLS) for s in symbols])
    texts = ["".join(rng.choice("abcxyz q") for _ in range(rng.randrange(1, 700))) for _ in range(40)] + ["a"]
    got = langid.phrases([langid._symbols(t, alphabet) for t in texts], model)
    for t, row in zip(texts, got):
        s = langid._symbols(t, alphabet).tolist()
        for lang, ref in enumerate(symbols):
            ref = ref.tolist()
            inside = {tuple(ref[a:b]) for a in range(len(ref)) for b in range(a + 1, len(ref) + 1)}
            n = 0
            for w in range(0, len(s), langid.WINDOW):
                part, at = s[w:w + langid.WINDOW], 0
                while at < len(part):
                    end = at + 1
                    while end < len(part) and tuple(part[at:end + 1]) in inside:
                        end += 1
                    n, at = n + 1, end
            assert row[lang] == n


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = queries.op6_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got} == {True}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(k, "the cat and the dog " * 3, "en", 1, "k") for k in range(30)]
    rows += [(100 + k, "der hund und die katze " * 3, "de", 1, "k") for k in range(30)]
    odd = [(900, None, "en", 1, "k"), (901, "", "en", 1, "k"), (902, "12 34 !?", "en", 1, "k"), (None, "the dog", None, 1, "k"),
           (903, "und " * 50_000, None, 1, "k"), (903, "the the", "en", 1, "k"), (904, "日本", None, 1, "k")]
    frame = spark.createDataFrame(rows + odd, DOCS)
    got = defaultdict(list)
    for r in langid.identify(frame).collect():
        got[r.doc_id].append(r.lang_pred)
    assert [got[k] for k in (900, 901, 902, None)] == [["und"], ["und"], ["und"], ["en"]]
    assert sorted(got[903]) == ["de", "en"]
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) + 4
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []
    blind = langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blind} == {"und"}


def test_language_sample_counts_copies_once(spark):
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(100))
    rows = [(k, "abcde fghij " * 40, "fr", 1, "k") for k in range(20_000)]
    rows += [(50_000 + k, text("klmno"), "fr", 1, "k") for k in range(300)] + [(60_000 + k, text("pqrst"), "de", 1, "k") for k in range(300)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    sizes = [len(t) for t in model.tables]
    assert model.languages == ["de", "fr"] and min(sizes) > 0.8 * max(sizes)


def test_language_of_many_scripts(spark):
    rng = random.Random(9)
    letters = {"ar": range(0x627, 0x64B), "el": range(0x3B1, 0x3CA), "en": range(97, 123), "he": range(0x5D0, 0x5EB), "hi": range(0x915, 0x93A),
               "ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xAE00), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x5000)}
    words = {lang: ["".join(chr(rng.choice(codes)) for _ in range(4)) for _ in range(300)] for lang, codes in letters.items()}
    rows = [(100 * k + n, " ".join(rng.choices(words[lang], k=60)), lang, 1, "k") for k, lang in enumerate(letters) for n in range(60)]
    frame = spark.createDataFrame(rows, DOCS)
    model = langid.train(frame)
    assert set("".join(w for found in words.values() for w in found)) >= set(model.alphabet) and len(set(model.alphabet.values())) > 500
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] and r.score > 0.99 for r in langid.identify(frame, model).collect())


# -- toxicity ------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = queries.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    y = np.array([r.toxic for r in got])
    s = np.array([r.score for r in got])
    rank = np.argsort(np.argsort(s, kind="stable"))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    pred = np.array([r.predicted for r in got])
    print("auc", auc, "precision", y[pred == 1].mean(), "recall", pred[y == 1].mean())
    assert auc > 0.85 and ((s >= 0.7) == (pred == 1)).all() and s.min() >= 0 and s.max() <= 1


def test_toxicity_edge_cases(spark):
    rng = random.Random(3)
    calm = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}ord" for k in range(200)]
    bad = ["horrible", "disgustful", "abominable"]
    rows, marks = [], []
    for k in range(400):
        words = [rng.choice(calm) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(5):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(k % 4 == 0), "x"))
    odd = [(900, None), (901, ""), (902, "!!"), (None, "horrible horrible"), (903, "horrible " * 3000), (903, "calm"), (904, "x" * 9000)]
    labels = spark.createDataFrame(marks + [(0, 1, 0, "x"), (None, 1, 1, "x"), (5, 1, None, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    got = toxicity.score_documents(docs_frame(spark, rows + odd), labels).collect()
    score = defaultdict(list)
    for r in got:
        score[r.doc_id].append(r.predicted)
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert score[900] == score[901] == score[902] == score[904] == [0] and sorted(score[903]) == [0, 1] and score[None] == [1]
    none = toxicity.score_documents(docs_frame(spark, rows[:3]), labels.where("toxic = 0")).collect()
    assert [r.score for r in none] == [0.0] * 3
    assert toxicity.score_documents(docs_frame(spark, []), labels).collect() == []


def test_toxicity_cut_keeps_the_class_mix():
    """A sample capped per class, weighted to the true mix, gives the cut of all rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 18_000), rng.normal(1.5, 1, 2_000)])[:, None]
    y = np.repeat([0.0, 1.0], [18_000, 2_000])
    some = np.r_[rng.choice(18_000, 2_000, replace=False), 18_000:20_000]

    def share_right(found):
        w, cut = found
        return y[x[:, 0] * w[0] + w[1] >= cut].mean()

    whole = share_right(toxicity.calibrate(x, y))
    assert abs(share_right(toxicity.calibrate(x[some], y[some], np.where(y[some] == 1, 1, 9))) - whole) < 0.06
    assert share_right(toxicity.calibrate(x[some], y[some])) < whole - 0.1


def test_toxicity_sample_counts_the_classes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 20)
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1_000)], "doc_id long, toxic int")
    labelled, stands_for = toxicity.sample(docs_frame(spark, [(k, "text") for k in range(1_000)]), labels)
    outside = [k for k in range(1_000) if zlib.crc32(str(k).encode()) % 3 != 1]
    n = sum(k % 10 == 0 for k in outside)
    assert labelled.count() == 40
    again, _ = toxicity.sample(docs_frame(spark, [(k, f"text {c}") for k in range(1_000) for c in range(3)]), labels)
    assert again.count() == 40 and stands_for == {0: (len(outside) - n) / 20, 1: n / 20}


# -- top-k ---------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 1)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)).round(1)
    x[20:40] = x[20]
    x[50] = 0
    rows = [(k, v.tolist(), 1, "q") for k, v in enumerate(x)]
    rows += [(200, None, 1, "q"), (201, [1.0, None] * 3, 1, "q"), (202, [float("nan")] * 6, 1, "q"), (203, [float("inf")] * 6, 1, "q"),
             (204, [1.0, 2.0], 1, "q"), (205, [], 1, "q"), (250, [3.0, 1.0], 1, "q"), (300, [], 1, "q"), (None, [1.0] * 6, 1, "q"), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")
    got = topk.top_k(frame, frame.where("vec_id % 50 = 0"), k=5).collect()
    clean = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, *_ in rows
             if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = set()
    for q, v in clean.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in clean.items() if i != q and w.size == v.size)[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).collect() == []


# -- archives ------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, owner long"


def brute_archive(rows, min_bytes):
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", warc.NO_ID), warc.NO_ID if i is None else i)
    out = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        revisit = len(b) >= min_bytes and (warc.NO_ID if i is None else i) < last[t or ""]
        out[i, len(b), warc.payload_digest(b), "revisit" if revisit else "response", last[t or ""] if revisit else None] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 30])
def test_archive_round_trip(spark, tmp_path, min_bytes):
    rng = random.Random(5)
    rows = [(k, f"http://x/{k}", rng.choice(["<p>é\r\n\r\nWARC/1.1\r\n</p>", "", "<a>" * 50, None])) for k in range(40)]
    rows += [(50 + k, None, "".join(rng.choice("aé\r\n") for _ in range(rng.randrange(1, 9000)))) for k in range(20)]
    rows += [(90, "u", "Z" * 300_000), (91, "u\r\nX: y", "Z" * 300_000), (None, "u", "only"), (None, "u", ""), rows[45], rows[45], (95, "v", "q"), (95, "v", "r" * 999)]
    frame = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)
    got = warc.archive_report(frame, min_bytes, segment_bytes=1000)
    assert Counter(map(tuple, got.collect())) == brute_archive(rows, min_bytes)
    warc.write_archive(frame, f"{tmp_path}/w", min_bytes, segment_bytes=1000)
    records = warc.read_records(spark, f"{tmp_path}/w")
    assert records.where("type = 'continuation'").count() > 300
    whole = {r.page_id: bytes(r.payload) for r in warc.reassemble(records).where("type = 'response'").collect()}
    assert whole[91] == b"Z" * 300_000 and all(whole[i] == t.encode() for i, _, t in rows if i is not None and 50 <= i < 70)
    lost = records.where("segment is null or not (page_id is null and segment = 3)")
    with pytest.raises(Exception, match="segments do not make the record"):
        warc.reassemble(lost).count()
    ids = records.select("id").collect()
    assert len(ids) == len(set(ids)) and records.where("type = 'revisit'").count() > 0
    files = sorted((tmp_path / "w").glob("part-*"))
    heads = [f for name in files for f, _ in warc.parse_records(gzip.decompress(name.read_bytes()))]
    assert all((f.get("warc-profile") == warc.PROFILE) == (f["warc-type"] == "revisit") for f in heads)
    assert sum(len(list(warc.parse_records(gzip.decompress(f.read_bytes())))) for f in files) == records.count()


def test_archive_empty(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGES)).collect() == []
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# -- decontamination -----------------------------------------------------------------------

def brute_words(text):
    """Words of a text, slots behind their marker; and which of them open a sentence."""
    import regex
    t = regex.sub(r"(?<=\p{Nd}),(?=\p{Nd}{3}(?!\p{Nd}))", "", text)
    t = regex.sub(r"(?<=\p{Nd})\.(?=\p{Nd})", "\x04", t)
    t = regex.sub(r"(?<=\p{Nd})\s?((?i:" + decontam.UNITS + r"))(?![\p{L}\p{N}])", " \x03\\1", t)
    plain = [w for w in regex.split(decontam._SEPARATOR, t.replace("\x03", "").lower()) if w]
    t = regex.sub(r"(?<![\p{L}\p{N}\x04])(\p{Nd}[\p{Nd}\x04]*)(?!\p{L})", "\x01\\1", t)
    t = regex.sub(r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}[\p{L}\p{M}]*)", "\x02\\1", t)
    t = regex.sub(r"(?<![\p{L}\p{M}\p{N}\x02\x03])(\p{Lu}\p{Ll}[\p{L}\p{M}]*)", "\x02\\1\x05", t)
    words = regex.split(decontam._SEPARATOR, t.lower())
    return [w.rstrip("\x05") for w in words], [w.endswith("\x05") for w in words], plain


def brute_judged(slots, starts):
    """(consistent windows, changed slots) of one alignment; slots: place -> (item's, document's, opener)."""
    def clash(p, names):
        return any((p[0] == q[0]) != (p[1] == q[1]) for q in names)
    names = {(a, b) for a, b, _ in slots.values() if a[0] == "\x02"}
    inner = {(a, b) for a, b, o in slots.values() if a[0] == "\x02" and not o}
    suspect = any(clash(p, inner) for p in inner)
    stands = {}
    for a in {a for a, _, _ in slots.values() if a[0] != "\x02"}:
        n = Counter(b for x, b, _ in slots.values() if x == a)
        stands[a] = max((b == a, k, b) for b, k in n.items())[2]
    bad = {at for at, (a, b, _) in slots.items()
           if (suspect and a != b) or (clash((a, b), names) if a[0] == "\x02" else stands[a] != b)}
    good = [s for s in starts if not bad & set(range(s, s + 8))]
    return len(good), len({slots[k][:2] for s in good for k in range(s, s + 8) if k in slots and slots[k][0] != slots[k][1]})


def brute_leaks(rows, items):
    """The leaks; those that only a whole copy shows have None for their figures."""
    kind = lambda w: w[0] if w[:1] in ("\x01", "\x02", "\x03") else w
    out, prepared = {}, []
    for item, text in items:
        w, opens, plain = brute_words(text or "")
        read = [list(map(kind, w)), [x[1:] if o else kind(x) for x, o in zip(w, opens)]]
        windows = {(k, tuple(r[k:k + 8])) for r in read for k in range(len(w) - 7) if sum(x > "\x05" for x in r[k:k + 8]) >= 5}
        prepared.append((item, w, opens, plain, windows,
                         sum(sum(x > "\x05" for x in read[0][k:k + 8]) >= 5 for k in range(len(w) - 7))))
    for doc, text in rows:
        d, _, doc_plain = brute_words(text or "")
        where = defaultdict(list)
        for k in range(len(d) - 7):
            where[tuple(map(kind, d[k:k + 8]))].append(k)
        for item, w, opens, plain, windows, n in prepared:
            found, need = defaultdict(set), min(6, max(1, -(-n * 3 // 10)))
            for s, t in windows:
                for k in where.get(t, ()):
                    found[k - s].add(s)
            for shift, starts in found.items():
                slots = {k: (w[k], d[k + shift], opens[k]) for s in starts for k in range(s, s + 8)
                         if kind(w[k]) in ("\x01", "\x02", "\x03") and kind(d[k + shift]) in ("\x01", "\x02", "\x03")}
                good, changed = brute_judged(slots, starts)
                old = out.get((doc, item))
                if good >= need and (old is None or (good, -changed) > (old[0], -old[2])):
                    out[doc, item] = (good, n, changed)
            if plain and any(doc_plain[k:k + len(plain)] == plain for k in range(len(doc_plain) - len(plain) + 1)):
                out.setdefault((doc, item), (None, None, None))
    return {(*k, *v) for k, v in out.items()}


def same_leaks(got, want):
    """The same pairs, and the same figures but for whole copies (which count all windows of the item)."""
    got, want = {tuple(r)[:2]: tuple(r)[2:] for r in got}, {w[:2]: w[2:] for w in want}
    assert set(got) == set(want)
    assert {k: v for k, v in got.items() if v != want[k] and want[k][0] is not None and not (v[0] == v[1] and v[2] == 0)} == {}
    return True


ITEMS = [(1, "A train leaves Boston at 60 km per hour and meets Alice after 5 hours. How far is Boston from the place where they met?"),
         (2, "Which of these ordinary words does not belong to the same family as all of the others here"),
         (3, None), (4, "too short"), (None, "if you mix red and blue paint in equal parts what colour will you have")]


def test_leaks(spark):
    rng = random.Random(6)
    fill = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(30))
    asked = ITEMS[0][1]
    rows = [(1, f"{fill()} {asked} {fill()}"), (2, asked.replace("Boston", "Lyon").replace("60 km", "75 miles").replace("5", "7")),
            (3, asked.replace("Boston", "Lyon", 1).replace("60", "75")), (4, fill()), (5, None), (6, ""), (7, ITEMS[1][1].upper()),
            (8, (ITEMS[4][1] + " " + fill() + " ") * 30), (None, ITEMS[1][1]), (9, asked), (9, ITEMS[1][1]), (10, "12 " * 500),
            (11, " ".join(ITEMS[1][1].split()[:12]))]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS + [ITEMS[1]]], "item_id long, text string, doc_id string")
    frame = docs_frame(spark, rows)
    want = brute_leaks(rows, ITEMS)
    assert {(1, 1), (2, 1), (7, 2), (8, None), (None, 2), (9, 1), (9, 2), (11, 2)} <= {w[:2] for w in want}
    assert not {w[0] for w in want} & {3, 4, 5, 6, 10}
    got = decontam.leaks(frame, items).collect()
    assert same_leaks(got, want) and len(got) == len(want)
    kept = decontam.drop_leaks(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 10]
    assert decontam.leaks(frame.limit(0), items).collect() == decontam.leaks(frame, items.limit(0)).collect() == []


def test_leaks_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "x")]
    assert same_leaks(decontam.leaks(docs_frame(spark, rows), items).collect(), brute_leaks(rows, ITEMS))


def leaked(spark, items, rows):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontam.leaks(docs_frame(spark, rows), frame).collect()}


def test_leaks_with_an_edited_or_repeated_number(spark):
    items = ["on the first day 12 people came to see the old house and then 12 people came back to it again in the evening",
             "she put 5 apples and 3 pears into the basket and then walked all the way home along the river with her dog",
             "my uncle Boris met your aunt Clara near the bridge and then my uncle Boris went home while she walked on to the harbour with her two small dogs"]
    rows = [(0, items[0].replace("then 12", "then 13")), (1, items[1].replace("5 apples and 3", "7 apples and 7")),
            (2, items[2].replace("uncle Boris went", "uncle Peter went")), (3, items[0].replace("12", "14"))]
    got = leaked(spark, items, rows)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 0)}
    assert got[0, 0][2] == got[2, 2][2] == 0 and got[1, 1][2] == 2 and got[3, 0][2] == 1
    assert got[0, 0][0] < got[0, 0][1] and got[1, 1][0] == got[1, 1][1]


def test_leaks_with_other_opening_names_and_grouped_numbers(spark):
    items = ["Tom buys 12 apples at the market. Tom gives 3 apples to a friend of the family. Tom eats some. How many are left?",
             "A shop sold 900 cups of tea on the first day and 1,200 cups on the second day, 12.5 more than a year ago. How much is that?"]
    rows = [(0, items[0].replace("Tom", "Anna").replace("12", "1,500")), (1, "It was so.\n\"" + items[1].replace("900", "1,900").replace("1,200", "800").replace("12.5", "7")),
            (2, items[0].lower()), (3, "Anna buys the house at the corner. Bob gives talks to a friend. Cyd eats some. How many are there?"),
            (4, items[0].replace("Tom gives", "Anna gives").replace("Tom eats", "Bob eats").replace("12", "4")), (5, "12.5 and 1,200 " * 200)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = decontam.leaks(docs_frame(spark, rows), frame).collect()
    assert same_leaks(got, brute_leaks(rows, list(enumerate(items))))
    found = {(r.doc_id, r.item_id): r for r in got}
    assert {(0, 0), (1, 1), (2, 0)} <= set(found) and not {3, 5} & {d for d, _ in found}
    assert found[0, 0].n_windows == found[0, 0].item_windows and found[0, 0].n_changed == 2 and found[1, 1].n_changed == 3


def test_leaks_random_edits(spark):
    """Questions with random names and numbers, some slots changed against the rest, around other text."""
    rng = random.Random(9)
    names, plain = ["Tom", "Anna", "Bob", "Zoe"], "buys gives apples pears market friend house road walks home and the to of".split()
    def text(k):
        words = [rng.choice(names) if rng.random() < 0.15 else str(rng.choice([3, 12, "1,500", "2.5"])) if rng.random() < 0.12 else rng.choice(plain) for _ in range(k)]
        return " ".join(w + (". " if rng.random() < 0.1 else "") for w in words)
    items = [(k, text(rng.choice([5, 14, 30]))) for k in range(25)]
    rows = []
    for k in range(120):
        t = rng.choice(items)[1]
        for a in names + ["12", "3", "1,500"]:
            if rng.random() < 0.4:
                t = t.replace(a, rng.choice(names) if a in names else "77", rng.choice([1, -1]))
        rows.append((k, f"{text(6)} {t} {text(6)}" if k % 3 else t))
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    assert 40 < len(want) and same_leaks(decontam.leaks(docs_frame(spark, rows), frame).collect(), want)


def test_leaks_in_a_long_text(spark):
    asked = "Which planet is closest to the sun?"
    frame = spark.createDataFrame([(1, asked), (2, ITEMS[1][1])], "item_id long, text string")
    fill = "lorem ipsum dolor sit 12 amet " * 150_000
    got = decontam.leaks(docs_frame(spark, [(1, fill + asked + " " + fill + ITEMS[1][1])]), frame).collect()
    assert {r.item_id for r in got} == {1, 2}


def test_leaks_of_short_items(spark):
    items = ["Which planet is closest to the sun?", "What is the largest river in all Europe?", "Add 3 kg, 5 kg, 7 kg, 9 kg, 11 kg, 13 kg, 15 kg and 17kg",
             '"Paris" or Rome?', "", "?!", None]
    rows = [(0, f"so I asked him {items[0]} and he knew"), (1, f"we asked this {items[1]} and so on"), (2, f"Task one: {items[2]}; done"), (3, "paris or rome"),
            (4, "Which planet is closest to the moon?"), (5, items[2].replace("9", "8")), (6, "?!"), (7, "paris or romeo"), (None, items[0])]
    got = leaked(spark, items, rows)
    assert {k: v[2] for k, v in got.items()} == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (None, 0): 0}


def test_leaks_of_the_tables(spark):
    docs, items = (table(spark, SF, t).collect() for t in ("documents", "benchmark"))
    want = brute_leaks([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert same_leaks(queries.op9_decontam(spark, SF).collect(), want)
    exact = {d.doc_id for d in docs for i in items if i.text in (d.text or "")}
    assert exact and exact <= {w[0] for w in want}


# -- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Every stage against brute force on the stage's own input."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    items = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").collect()]
    names, cols = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "99 !", "en", "s", 4), (10**6 + 2, "", None, "s", 0)], docs.schema)
    rows = {r.doc_id: r for r in docs.union(odd).collect()}
    out = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.land(stage(spark, out, "/root/testdata/sf0.001"), name)
        assert out.columns == cols
        got = {r.doc_id: r for r in out.collect()}
        pairs = [(i, r.text) for i, r in rows.items()]
        if name == "language":
            assert set(got) == {i for i, t in pairs if t and any(map(str.isalpha, t))}
        elif name == "lines":
            import hashlib
            want = {r[0]: r for r in brute_lines(pairs)}
            assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in got.items()} == {i: w[3] for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            fps = [brute_fingerprint(t) for _, t in pairs]
            roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
            low = {}
            for (i, _), q in zip(pairs, roots):
                low[q] = min(low.get(q, i), i)
            assert set(got) == set(low.values())
        else:
            assert set(got) == set(rows) - {w[0] for w in brute_leaks(pairs, items)}
        rows = got
    packed = corpus_pipeline.pack(spark, out, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert got and max(used.values()) <= 2048
    assert VOCAB.endswith("word_bpe_49k.json") and re.match(r"op\d+_", next(iter(queries.queries()))) and corpus()
