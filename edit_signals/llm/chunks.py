"""White-space chunks of texts, for the word-level BPE vocabulary.

No pre-token of that vocabulary crosses white space, so the tokens of a text are those of its
white-space chunks one after the other. Chunks repeat, so work per chunk is kept in a bounded
cache of the worker. Only texts made of characters whose normal form, case and class are stable
(``PLAIN``) go this way; any other text is given to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

# Entries a worker keeps before it starts anew; bounds memory, not the result.
CACHE_ENTRIES = 250_000

# Characters outside this set send a text to the library: control characters, odd white space,
# dotted capital I, combining marks, and scripts beyond extended Latin.
_ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]")
# Pre-token pattern of the vocabulary file (fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("|".join(map(re.escape, SPECIALS)))


def is_plain(text: str) -> bool:
    return _ODD.search(text) is None and ("<|" not in text or _SPECIAL.search(text) is None)


def split_specials(text: str) -> tuple[list[str], int]:
    """Stretches between special strings, and how many special strings there are."""
    parts = _SPECIAL.split(text)
    return [p for p in parts if p], len(parts) - 1


def plain_chunks(text: str) -> list[str]:
    return text.lower().split()


def chunk_words(chunk: str) -> list[str]:
    """Pre-tokens of a chunk; most chunks are one run of letters, or one and a last character that is none."""
    if chunk.isalpha():
        return [chunk]
    return [chunk[:-1], chunk[-1]] if chunk[:-1].isalpha() else PRE_TOKEN.findall(chunk)


@lru_cache(maxsize=4)
def library(path: str):
    """The vocabulary file opened once per worker, single-threaded."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class WordEncoder:
    """The library's model on pre-tokens that are normalised and split already."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        library(path)
        self.lib = Tokenizer.from_file(path)
        self.lib.normalizer = normalizers.Sequence([])
        self.lib.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of every pre-token, little-endian unsigned 32-bit, from one call for all of them."""
        import numpy as np
        if not words:
            return []
        ids = np.array(self.lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        edges = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        if len(edges) != len(words) + 1:
            raise ValueError("a pre-token was split again")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
