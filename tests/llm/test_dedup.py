"""Line, near-duplicate, substring operators and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from edit_signals.llm import linededup, packing, simhash, suffix, tokens

VOCAB = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, n long, key string"


def docs_frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", 7, "k") for i, t in rows], DOCS)


def words(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([3, 40, 120, 400])) for _ in range(25)]
    shared = [words(rng, 90) for _ in range(3)]
    out = [None, "", " ", "a", "a" * 3000, "ab" * 700, "\n\n", "é" * 900]
    out += base + base[:6] + [base[7]] * 4
    out += [base[k] + "\n" + shared[k % 3] + "\n" + words(rng, 50) for k in range(12)]
    for k in range(8):  # near copies
        w = base[k].split()
        w[rng.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    line = "The same line of more than forty characters, again."
    out += [f"{words(rng, 20)}\n {line.upper() if k % 2 else line}\t\nx\n{line}" for k in range(7)]
    return list(enumerate(out)) + [(3, "a"), (None, base[0]), (None, None), (40, out[40])]


# -- packing -------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    rng = random.Random(1)
    rows = corpus() + [(100 + k, words(rng, rng.choice([5, 30, 200, 900, 5000]), 5000)) for k in range(60)]
    rows.append((300, "café <|endoftext|> x\x1cy İ ΑΣ '  " + "!" * 50))
    got = packing.pack_documents(docs_frame(spark, rows), VOCAB).collect()
    lib = Tokenizer.from_file(VOCAB)
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4").tobytes()
            want[i, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1


def test_best_two_fit_beats_greedy():
    # greedy: 6 + 3 leaves 1; the two 2s fill the gap better than the 3
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan.sequences == 2
    in_first = {int(n) for n, s in zip(plan.length, plan.sequence) if s == 0}
    assert in_first == {6, 2}
    rng = random.Random(2)
    lengths = Counter(rng.randrange(1, 2049) for _ in range(20_000))
    plan = packing.best_two_fit(lengths, 2048)
    used = Counter()
    for n, k in lengths.items():
        at = np.flatnonzero(plan.length == n)
        for r in range(k):
            s = at[np.searchsorted(plan.rank[at], r, side="right") - 1]
            used[int(plan.sequence[s] + (r - plan.rank[s]) // plan.repeat[s])] += n
    assert max(used.values()) <= 2048 and len(used) == plan.sequences
    assert plan.sequences <= 1.01 * sum(n * k for n, k in lengths.items()) / 2048


def test_packing_empty(spark):
    assert packing.pack_documents(docs_frame(spark, []), VOCAB).collect() == []


# -- token counts --------------------------------------------------------------------------

ODD = ["", " ", "a", "Ab cd", "don't WE'LL x'Sy", "naïve Ünïcode ﬁ ℌ", "é a̧", "日本語 テスト 한국어", "😀😀 ok", "x\x00y\x1cz",
       "a b c\u0085d", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "12345 ½ ²", "aaaaaaaaaaaaaaaaaaaaaa", "=" * 300,
       "İstanbul ΑΣ ǅ", "​﻿", "l'été d'où _a_b", "the" * 400, "\t\r\n\x0b\x0c", "ß ẞ ſ", "…—’ “x”"]


def test_token_counts_match_library(spark):
    rng = random.Random(3)
    alphabet = "abc ABC'\té!?<|>19_ñ́ Σσ中\n"
    rows = [(k, t) for k, t in enumerate([None, *ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
                                                     for _ in range(400))])]
    got = {r.doc_id: r for r in tokens.token_counts(docs_frame(spark, rows), VOCAB, limit=8).collect()}
    lib = Tokenizer.from_file(VOCAB)
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 8), repr(t)
    assert packing.encode_texts(ODD, VOCAB) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]


# -- SimHash -------------------------------------------------------------------------------

def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = low.split()
    if not w:
        return 0
    shingles = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, linked):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(keys)):
        for y in range(x):
            if linked(keys[x], keys[y]):
                root[find(x)] = find(y)
    return [find(x) for x in range(len(keys))]


def test_near_duplicates(spark):
    rows = corpus()
    rows += [(900 + k, t) for k, t in enumerate(["\x1c x", "one two", "one  two", "ONE two\vthree É", "one two three é"])]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    low = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in roots}
    want = Counter((i, f"{f:016x}", low[r]) for (i, _), f, r in zip(rows, fps, roots))
    got = simhash.near_duplicates(docs_frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs_frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == {low[r] for r in roots}
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [3, 48])
def test_links_of_crowded_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BLOCK_LIMIT", limit)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1, *centres}
    for c in centres[:3]:
        for _ in range(60):
            f = c
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, doc_id long")
    tree = simhash.components(simhash.links(simhash.pivot_table(nodes), 2)).collect()
    root = {r.node: r.root for r in tree}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    groups, found = defaultdict(set), defaultdict(set)
    for s, w in zip(signed, want):
        groups[w].add(s)
        found[root.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    assert all(r == min(found[r]) for r in found)


# -- lines ---------------------------------------------------------------------------------

def brute_lines(rows, min_chars=40, min_docs=5):
    space = " \t\n\x0b\x0c\r"

    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))

    lines = [(i, (t or "").split("\n")) for i, t in rows]
    count, holder = Counter(), {}
    for i, ls in lines:
        for k in {key(x) for x in ls if len(key(x)) >= min_chars}:
            count[k] += 1
            holder[k] = max(holder.get(k, -(1 << 63)), -(1 << 63) if i is None else i)
    out = []
    for i, ls in lines:
        kept = [x for x in ls if count[key(x)] < min_docs or holder[key(x)] == (-(1 << 63) if i is None else i)]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, batches):
    rows = corpus() + [(None, "The same line of more than forty characters, again."), (7, "é" * 39 + "\n" + "é" * 40)]
    rows += [(500 + k, "é" * 39 + "\n" + "É" * 40 + "\r\n") for k in range(5)]
    frame = docs_frame(spark, rows)
    got = linededup.line_report(frame, batches=batches).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows)
    text = Counter((r.doc_id, r.text) for r in linededup.drop_lines(frame, batches=batches).collect())
    for (i, t), n in text.items():
        assert t is None or n >= 1
    digest = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), n in text.items() for _ in range(n))
    assert digest == Counter((r.doc_id, r.kept_sha256) for r in got)
    assert linededup.line_report(docs_frame(spark, [])).collect() == []


def test_line_runs_levels(spark):
    runs = linededup.LineRuns(fanout=2)
    seen = set()
    for k in range(5):
        rows = [(d, h, 0) for d in range(3) for h in range(k * 2, k * 2 + 4)]
        fresh = runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
        new = {r.h1 for r in fresh.collect()}
        assert new == set(range(k * 2, k * 2 + 4)) - seen
        seen |= new
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n) for r in runs.merged().collect()} == {(h, 3 if h in (0, 1, 10, 11) else 6) for h in range(12)}


# -- substrings ----------------------------------------------------------------------------

def brute_repeats(rows, span):
    starts = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for k in range(len(b) - span + 1):
            starts[b[k:k + span]] += 1
    out = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if starts[b[k:k + span]] > 1:
                gone[k:k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("slice_bytes", [700, 1 << 20])
def test_repeated_substrings(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix, "SLICE_BYTES", slice_bytes)
    rng = random.Random(6)
    rows = corpus()
    passage = words(rng, 200)
    for k in range(25):  # overlapping stretches of one passage in different company
        a = rng.randrange(0, 500)
        rows.append((700 + k, words(rng, 40) + passage[a:a + rng.choice([399, 400, 401, 433, 600])] + words(rng, 30)))
    rows.append((800, passage + "x" + passage))
    got = suffix.repeat_report(docs_frame(spark, rows)).collect()
    assert all(r.repeats == (r.n_removed > 0) for r in got)
    assert Counter(tuple(r)[:5] for r in got) == brute_repeats(rows, 400)
    assert suffix.repeat_report(docs_frame(spark, [])).collect() == []
    frame = suffix.drop_repeats(docs_frame(spark, rows[:5]))
    assert frame.columns == ["doc_id", "text", "lang", "n", "key", "kept", "n_bytes", "n_spans"]
