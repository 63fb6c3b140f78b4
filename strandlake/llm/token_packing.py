"""Concatenate-and-cut packing of token ids into fixed windows.

Pass one encodes each document once, where Spark reads it, and stores its ids with the tokens before
it in its partition. Partition totals (a row for each partition) give each partition's global offset
by a prefix sum. Pass two adds the offset and cuts each document at multiples of the window: a
piece that begins inside a window continues what another document or partition began, so pieces are
the boundary records and no partition waits for another. Only the last window has padding.

A null or empty text has the end id alone. Repeated rows are packed each for itself; a null doc_id is one like any
other. Texts of any length go in whole. An empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import text_of, written
from .word_encoder import ENTRIES, encoder

#: Texts encoded at once; bounds what a task holds.
BATCH_TEXTS = 512
BATCH_CHARS = 2_000_000
#: The same where words are looked up: larger blocks hold fewer distinct ones in all.
ENCODE_TEXTS = 1024
ENCODE_CHARS = 3_000_000

ENCODED = "part int, place long, doc_id long, n_tokens long, before long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def blocks(batches, *columns, most_texts: int = BATCH_TEXTS, most_chars: int = BATCH_CHARS):
    """Columns of Arrow batches as lists, in blocks of bounded text (the last column)."""
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        begin = chars = 0
        for i, text in enumerate(lists[-1]):
            chars += len(text)
            if chars >= most_chars or i + 1 - begin >= most_texts:
                yield [x[begin : i + 1] for x in lists]
                begin, chars = i + 1, 0
        if begin < len(lists[-1]):
            yield [x[begin:] for x in lists]


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, entries: int = ENTRIES) -> DataFrame:
    """Ids of each whole text and the end id, with the partition and what is before it there. A null
    text is empty: it has the end id alone. Equal and repeated rows stay as rows of their own."""

    def run(batches):
        code, part, before, place = encoder(vocabulary, entries), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for ids, texts in blocks(batches, "doc_id", "text", most_texts=ENCODE_TEXTS, most_chars=ENCODE_CHARS):
            coded = [x + end for x in code.encode(texts)]
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            yield pa.record_batch([
                pa.array([part] * len(ids), pa.int32()), pa.array(np.arange(place, place + len(ids))), pa.array(ids, pa.int64()),
                pa.array(sizes), pa.array(starts), pa.array([np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in coded] if len(code.ends) <= 65536 else coded, pa.binary()),
            ], ["part", "place", "doc_id", "n_tokens", "before", "ids"])
            before, place = before + int(sizes.sum()), place + len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, ENCODED)


def pack(encoded: DataFrame, window: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Pieces of fixed windows over all ids one after the other. `encoded` must be a table that was
    written (encode_documents' rows): both passes then see the same partitions whatever is lost."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row for each partition of the first pass: small by construction.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = encoded.join(F.broadcast(offsets), "part").select("doc_id", "n_tokens", (F.col("base") + F.col("before")).alias("first"), "ids")

    def cut(batches):
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            docs, counts, firsts = (batch.column(i).to_pylist() for i in range(3))
            for doc, n, first, raw in zip(docs, counts, firsts, batch.column(3)):
                data = raw.as_buffer()
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[start : start + length].tobytes()
                    for k, v in zip(rows, (doc, start, length, zlib.crc32(piece), n, sequence, offset, piece if keep_ids else None)):
                        rows[k].append(v)
                    start += length
            if rows["doc_id"]:
                yield pa.record_batch([pa.array(rows[k], pa.binary() if k == "ids" else pa.int64()) for k in rows], list(rows))

    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: the pieces of each window joined in order (at most `window` ids to a group)."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("pieces"),
    )


def op10_packing(docs: DataFrame, vocabulary: str, entries: int = ENTRIES) -> DataFrame:
    """Pieces of all documents in windows of 2048; an id lies in exactly one piece. entries: bounds
    what a worker keeps of the words that it has encoded; it changes no result."""
    return pack(written(encode_documents(docs, vocabulary, entries=entries), "encoded"), keep_ids=False).drop("ids")
