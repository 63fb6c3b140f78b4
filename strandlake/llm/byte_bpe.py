"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each token's bytes become printable characters, one for each byte; a piece scores its negative rank,
so sentencepiece merges in rank order, the leftmost first. Normalisation is the identity. Pre-tokens
of the split pattern are encoded each for itself, and decoding maps ids back to bytes.

A null or empty text has no ids. Rows are independent, so repeated rows get equal results, and a null doc_id is one like any
other. Texts of any length go in whole. An empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import text_of
from .token_packing import blocks
from .word_encoder import looked_up

#: Pre-tokens kept with their ids; bounds the memory of a worker.
CACHE_ENTRIES = 3 << 18

CODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (c for c in range(256) if c not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model (its protocol buffer) whose ids are the ranks; the unknown piece,
    which byte-mapped text never needs, comes last."""
    characters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(characters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _flag(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _flag(3, 2))
    out += _field(2, _flag(3, 2) + _flag(40, len(tokens)) + _flag(41, (1 << 64) - 1) + _flag(42, (1 << 64) - 1) + _flag(43, (1 << 64) - 1))
    out += _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return bytes(out)


_coders: dict[tuple[str, str], ByteCoder] = {}


def coder(path: str, pattern: str) -> ByteCoder:
    """The coder of this Python worker, with what it has cached in earlier tasks."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteCoder(path, pattern)
    return _coders[path, pattern]


class ByteCoder:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.pattern = regex.compile(pattern)
        self.mapped = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.cache: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        # A pre-token that is a token is that token, as in the rank file's own library.
        raw = [x.encode() for x in new]
        rest = [i for i, b in enumerate(raw) if b not in self.whole]
        coded = self.library.encode([raw[i].decode("latin-1").translate(self.mapped) for i in rest], num_threads=1)
        for x, b in zip(new, raw):
            if b in self.whole:
                self.cache[x] = struct.pack("<I", self.whole[b])
        for i, ids in zip(rest, coded):
            self.cache[new[i]] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(x) for x in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        found = looked_up(self.cache, list(chain.from_iterable(split)), lambda new: self._learn(list(new)))
        out, at = [], 0
        for s in split:
            out.append(b"".join(found[at : at + len(s)]))
            at += len(s)
        return out

    def decode(self, coded: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(coded, "<u4").tolist()))


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids of each whole text (null: empty) and the bytes they decode to; with `digests` only the
    SHA-256 of both. No shuffle: each row is its own."""

    def run(batches):
        code = coder(ranks, pattern)
        for ids, texts in blocks(batches, "doc_id", "text"):
            coded = code.encode(texts)
            counts, decoded = [len(x) // 4 for x in coded], [code.decode(x) for x in coded]
            if digests:
                coded, decoded = ([hashlib.sha256(x).digest() for x in y] for y in (coded, decoded))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, CODED)


def op7_byte_bpe(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    rows = encode_and_decode(docs, ranks, pattern, digests=True)
    return rows.select("doc_id", "n_tokens", F.lower(F.hex("ids")).alias("ids_sha256"), F.lower(F.hex("decoded")).alias("decoded_sha256"))
