"""Binary files of token ids: independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids, little-endian unsigned 32-bit, with zstandard's
own content checksum), a skippable frame with the documents' ids, and last a skippable frame with
the seek table: for each frame its compressed size, its decompressed size and the low 32 bits of
the XXH64 of its content, then a footer. Files cover rising ranges of doc_id. A reader fetches the
two tables at the file's end, then only the frames of the documents it wants.

A null or empty text has the end id alone. A null doc_id comes before all others; rows of one doc_id, equal ones too, are
documents of their own and go by their text. Texts of any length go in whole. An empty table gives files without frames
and no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_path, shuffle_width, text_of, written
from .token_packing import ENCODE_CHARS, ENCODE_TEXTS, blocks
from .word_encoder import encoder

# Magic numbers of zstandard's skippable frames and of its seekable format.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "part int, place long, doc_id long, before long, n_tokens long, ids binary"


def open_folder(uri: str):
    """The file system and path of a folder that is given as a path or a URI."""
    return pa.fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes a file's frames one by one and its tables at the end."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.code = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.ids, self.size = bytearray(), [], 0

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.code.compress(content)
        self.sink.write(frame)
        self.table += struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.size += len(frame)

    def close(self) -> int:
        index = np.array(self.ids, "<i8").tobytes()
        tail = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        tail += struct.pack("<II", SEEK_MAGIC, len(self.table) + 9) + bytes(self.table)
        tail += struct.pack("<IBI", len(self.ids), 0x80, FOOTER_MAGIC)
        self.sink.write(tail)
        return self.size + len(tail)


class FrameReader:
    """Reads the tables at a file's end, then any document's frame; checks each checksum."""

    def __init__(self, source):
        self.source, self.code = source, zstandard.ZstdDecompressor()
        source.seek(source.size() - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError("the file has no seek table")
        both = 8 + 8 * count + 8 + 12 * count + 9
        source.seek(source.size() - both)
        tail = source.read(both)
        self.ids = np.frombuffer(tail, "<i8", count, 8)
        table = np.frombuffer(tail, "<u4", 3 * count, 16 + 8 * count).reshape(count, 3)
        self.sizes, self.lengths, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.places = np.cumsum(self.sizes) - self.sizes

    def content(self, i: int) -> bytes:
        self.source.seek(int(self.places[i]))
        found = self.code.decompress(self.source.read(int(self.sizes[i])))
        if xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} has another checksum")
        return found


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Encodes whole texts (null: empty) and writes them in rising doc_id order (null ids first; rows
    of one id by text), a file for each partition. Returns the manifest: a row for each file. A file
    gets its name when it is whole, so a task that is run again only replaces it by the same bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        code, context = encoder(vocabulary), TaskContext.get()
        part = context.partitionId()
        fs, root = open_folder(folder)
        fs.create_dir(root)
        begun, name = f"{root}/.{part:06d}.{context.taskAttemptId()}", f"{root}/{part:06d}.ids.zst"
        end, tokens = np.array([end_id], "<u4").tobytes(), 0
        with fs.open_output_stream(begun) as sink:
            writer = FrameWriter(sink)
            for ids, texts in blocks(batches, "doc_id", "text", most_texts=ENCODE_TEXTS, most_chars=ENCODE_CHARS):
                for doc_id, coded in zip(ids, code.encode(texts)):
                    writer.add(doc_id, coded + end)
                    tokens += len(coded) // 4 + 1
            size = writer.close()
        fs.move(begun, name)
        if writer.ids:
            yield pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (name, pa.string()), (len(writer.ids), pa.int64()), (tokens, pa.int64()), (size, pa.int64()))], ["part", "path", "n_docs", "n_tokens", "n_bytes"])

    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents' ids from the files, in blocks; `wanted`: only these doc_ids are decompressed."""
    wanted = None if wanted is None else np.array(sorted(wanted), np.int64)

    def run(batches):
        fs, _ = open_folder(folder)
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    counts = reader.lengths // 4
                    before = np.cumsum(counts) - counts
                    which = np.arange(len(counts)) if wanted is None else np.flatnonzero(np.isin(reader.ids, wanted))
                    for i in range(0, len(which), 256):
                        some = which[i : i + 256]
                        yield pa.record_batch([
                            pa.array([part] * len(some), pa.int32()), pa.array(some), pa.array([None if x == NO_ID else int(x) for x in reader.ids[some]], pa.int64()),
                            pa.array(before[some]), pa.array(counts[some]), pa.array([reader.content(j) for j in some.tolist()], pa.binary()),
                        ], ["part", "place", "doc_id", "before", "n_tokens", "ids"])

    # A file to a task: the files are as large as the partitions that wrote them.
    return manifest.select("part", "path").repartition(shuffle_width(manifest.sparkSession), "part").mapInArrow(run, ROWS)


def op6_token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes all documents' ids, reads them back and returns each document's place and checksum."""
    folder = fresh_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, vocabulary)
    # A row for each file: small by construction.
    firsts = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("first"))
    rows = read_token_files(manifest, folder)
    return rows.select("part", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")).join(F.broadcast(firsts), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
