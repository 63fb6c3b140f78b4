"""Exact, cached encoding of whole texts by a word-level BPE of the tokenizers library.

The vocabulary lower-cases, drops white space and never merges across it, so a text's ids are the
ids of its white-space-separated chunks one after the other. Arrow splits a block of texts and numbers
its distinct chunks; each of these is looked up once by its raw characters. On a miss its pre-tokens
are looked up, and only pre-tokens that are new go to the library, many to a call. Texts in which
chunks might not stand alone go to the library whole.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries after which a cache of chunks starts anew (that of pre-tokens has three quarters of them); they bound the
#: memory of a worker. Where workers also serve other operators, fewer leave these more room.
ENTRIES, FEW_ENTRIES = 1 << 19, 1 << 17
#: Pre-tokens to a call of the library.
CALL = 256
#: The pre-token pattern of the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The split cuts at these, the pattern above does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, entries: int = ENTRIES) -> WordEncoder:
    """The encoder of this Python worker, with what it has cached in earlier tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].entries = entries
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str, entries: int = ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(PRE_TOKEN)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_tokens(self, tokens: list[str]) -> None:
        """Each pre-token ends with the first of its pieces that is marked as a word's end."""
        calls = [tokens[i : i + CALL] for i in range(0, len(tokens), CALL)]
        coded = self.library.encode_batch_fast([" ".join(call) for call in calls], add_special_tokens=False)
        for call, result in zip(calls, coded):
            ids = np.array(result.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(call):
                for token in call:
                    self.tokens[token] = self.whole(token)
                continue
            raw, at = ids.tobytes(), 0
            for token, stop in zip(call, (stops * 4).tolist()):
                self.tokens[token] = raw[at:stop]
                at = stop

    def _parts(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The pre-tokens of a chunk. A word of common letters, with one mark after it or none, needs
        no pattern. A capital sigma is lower-cased for itself: str.lower() looks at its neighbours."""
        low = chunk.lower() if "\u03a3" not in chunk else "".join(c.lower() for c in chunk)
        if low.isalpha() and max(low) < "\u0250":
            return (low,)
        if low[-1] in ".,!?;:" and low[:-1].isalpha() and max(low) < "\u0250":
            return (low[:-1], low[-1])
        return self.pattern.findall(low)

    def _learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        parts = [self._parts(x) for x in new]
        if len(self.tokens) > self.entries * 3 // 4:
            self.tokens.clear()
        known = self.tokens
        missing = {t for t in chain.from_iterable(parts) if t not in known}
        if missing:
            self._learn_tokens(list(missing))
        for x, tokens in zip(new, parts):
            self.chunks[x] = known[tokens[0]] if len(tokens) == 1 else b"".join([known[t] for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [not any(o in x for o in _ODD) and (x.isascii() or unicodedata.is_normalized("NFC", x)) for x in texts]
        split = pc.utf8_split_whitespace(pa.array([x if ok else "" for x, ok in zip(texts, plain)], pa.large_string()))
        if len(self.chunks) > self.entries:
            self.chunks.clear()
        self.chunks[""] = b""  # what is before white space that a text begins with, or after its last
        numbered = split.values.dictionary_encode()
        found = looked_up(self.chunks, numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        joined = pa.array(found, pa.large_binary()).take(numbered.indices)
        _, offsets, data = joined.buffers()
        cuts = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(texts) + 1)
        data = memoryview(data or b"")
        return [bytes(data[a:b]) if ok else self.whole(x) for x, ok, a, b in zip(texts, plain, cuts, cuts[1:])]


def looked_up(cache: dict[str, bytes], keys: list[str], learn) -> list[bytes]:
    """The cache's entry for each key; `learn` first adds those that it misses. One look at each key."""
    found = list(map(cache.get, keys))
    missing = [i for i, x in enumerate(found) if x is None]
    if missing:
        learn({keys[i] for i in missing})
        for i in missing:
            found[i] = cache[keys[i]]
    return found
