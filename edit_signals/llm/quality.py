"""Quality rules, line first: bad lines leave, then texts that lost too much.

Every line (split at ``\\n``) that holds a word is judged alone:

* punctuation - it ends in no sentence mark and holds fewer than one for every ``PROSE_WORDS`` words,
  or it has more symbols than words, or ``!!`` / ``??`` behind more than a third of its words;
* navigation - separators (``|``, arrows, bullets) stand between its items: two or more, and one for
  every three words or more;
* boilerplate - a short line that holds a stock phrase (cookies, licences, log-in, sharing).

Failing lines are removed. A text is rejected if its base statistics fail (too few words, too many
words in repeated five-word windows) or if the removed lines held more than ``max_lost`` percent of
the characters of its words.

One pass over the rows with no shuffle: a batch of texts is split in Arrow batches of bounded
bytes, repeated windows are found for the whole batch by one sort of window hashes, and equal hashes are
compared word by word, so the counts are exact. Words are mapped to numbers piece by piece: a very
long text needs some 60 bytes for each of its words, not a list of them.

Edge cases: a null or empty text has no words and is rejected; a line without a word is neither
judged nor removed; repeated rows are judged one by one; an empty table gives an empty result; extra
columns, whatever their names, are untouched (:func:`clean`) or left out (:func:`assess`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
WINDOW = 5
# Line rules.
PROSE_WORDS = 30
BOILERPLATE_WORDS = 25

# Patterns of the line rules, shared with the SQL statement of the query (both engines' syntax).
SPACE = r"[\x20\x09-\x0D]"
CLOSERS = "[\"'”’»)\\]]*"
ENDS = "[.!?:;…。！？]" + CLOSERS + "$"
INNER = "[.!?…。！？]" + CLOSERS + SPACE
SHOUTS = "[!?][!?]+"
SEPARATOR = "[|»›>•·/]+"
BOILERPLATE = ("(^|[^a-z])(cookies?|javascript|terms of (use|service)|privacy policy|all rights reserved|lorem ipsum|sign (in|up)|"
               "log ?in|subscribe|click here|read more|share (this|on)|powered by|copyright|licensed under|license, version|"
               "skip to (main )?content|back to top|newsletter|follow us)($|[^a-z])")

_ENDS, _INNER, _SHOUTS = re.compile(ENDS), re.compile(INNER), re.compile(SHOUTS)
_SEPARATOR, _BOILERPLATE = re.compile(SEPARATOR), re.compile(BOILERPLATE)
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes that begin no character
_PIECE = 1 << 20

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "kept boolean, n_failed_lines long, lost_chars long")


def _characters(raw: bytes) -> int:
    """Characters of the words of a UTF-8 text."""
    return len(raw.translate(None, _SPACES + _CONTINUATION))


def line_fails(line: bytes) -> bool:
    """Whether a line that holds a word breaks a rule."""
    words = line.split()
    n = len(words)
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if symbols > n:
        return True
    text = b" ".join(words).decode("utf-8", "replace")
    if not _ENDS.search(text) and PROSE_WORDS * len(_INNER.findall(text)) < n:
        return True
    if 3 * len(_SHOUTS.findall(text)) > n:
        return True
    if symbols or not text.isascii() or "/" in text:
        separators = sum(1 for w in text.split(" ") if _SEPARATOR.fullmatch(w))
        if separators >= 2 and 3 * separators >= n:
            return True
    return n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower().decode("utf-8", "replace")) is not None


def _word_codes(raw: bytes, codes: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a text, piece by piece; a piece ends where white space begins."""
    out, at = [], 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            cuts = [k for k in (raw.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0]
            end = min(cuts, default=len(raw))
        words = raw[at:end].split()
        out.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _window_hash(codes: np.ndarray, text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    h = text[starts].astype(np.uint64)
    for k in range(window):
        h = (h ^ codes[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def repeated_words(codes: np.ndarray, text: np.ndarray, n_texts: int, window: int = WINDOW) -> np.ndarray:
    """Per text, its words in ``window``-word windows found twice or more in it.

    ``codes`` numbers the words of all texts one after the other, ``text`` says whose they are."""
    starts = len(codes) - window + 1
    if starts < 2:
        return np.zeros(n_texts, np.int64)
    inside = np.flatnonzero(text[:starts] == text[window - 1:])
    h = _window_hash(codes, text, inside, window)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    left, right = inside[order[:-1][same]], inside[order[1:][same]]
    equal = text[left] == text[right]
    for k in range(window):
        equal &= codes[left + k] == codes[right + k]
    hit = np.zeros(len(codes) + 1, np.int64)
    if equal.all():
        found = np.union1d(left, right)
    else:  # two windows share a hash: group those rows by their words instead
        rows = np.union1d(left, right)
        keys = np.column_stack([text[rows], *[codes[rows + k] for k in range(window)]])
        _, at, n = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
        found = rows[n[at.ravel()] > 1]
    hit[found] += 1
    np.subtract.at(hit, found + window, 1)
    covered = np.cumsum(hit[:-1]) > 0
    return np.bincount(text[covered], minlength=n_texts).astype(np.int64)


def _judge(texts: list[bytes], max_lost: int, repeat_percent: int, min_words: int) -> Iterator[tuple]:
    """(statistics, lines that stay) of every text of a batch."""
    codes: dict[bytes, int] = {}
    per_text = [_word_codes(t, codes) for t in texts]
    counts = np.array([len(c) for c in per_text], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    repeats = repeated_words(np.concatenate(per_text), owner, len(texts))
    for raw, n, repeat in zip(texts, counts.tolist(), repeats.tolist()):
        lines = raw.split(b"\n")
        worded = [x for x in lines if x.strip()]
        bad = {x for x in set(worded) if line_fails(x)}
        lost = sum(_characters(x) for x in worded if x in bad)
        chars = _characters(raw)
        failed = n < min_words or 100 * repeat > repeat_percent * n
        kept = not failed and 100 * lost <= max_lost * chars
        stats = (n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(worded) - len(set(worded)), repeat, failed,
                 kept, sum(x in bad for x in worded), lost)
        yield stats, [x for x in lines if x not in bad] if bad else lines


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: int = MAX_LOST_PERCENT,
           repeat_percent: int = MAX_REPEAT_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: ``doc_id``, the base statistics, ``base_failed``, ``kept``, the failing lines and the
    characters lost with them."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {STATS}"
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = [s for s, _ in _judge(batch.column("text").to_pylist(), max_lost, repeat_percent, min_words)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*stats))], ["doc_id", *names])

    return map_batches(rows, run, schema)


def clean(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST_PERCENT,
          repeat_percent: int = MAX_REPEAT_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that are kept, all their columns, without their failing lines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
        judged = list(_judge(texts, max_lost, repeat_percent, min_words))
        new = pa.array([b"\n".join(lines).decode() for _, lines in judged], batch.schema.field(at).type)
        columns = [new if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([s[6] for s, _ in judged]))

    return map_batches(docs, run, docs.schema)
