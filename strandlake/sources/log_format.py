"""Import of a binary record log: frames are found and checked by one task for each file, rows go on as a table.

A frame (little endian): magic, version, flags, id, sequence, branch, time in microseconds, type, encoding, payload,
caused_by, linked_to, CRC-32 of the payload. Lengths are checked against what is left before they are used.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the format.
MAGIC = b"REC\0"
HEAD = struct.Struct("<4sBBQQQq")
ENCODINGS = {0: "json", 1: "message_pack", 2: "raw"}
SCHEMA = "path string, offset bigint, id bigint, sequence bigint, branch bigint, micros bigint, record_type string, encoding string, payload binary, caused_by array<bigint>, linked_to array<bigint>, ok boolean, size bigint"


class _Reader:
    def __init__(self, data, at):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise ValueError("the frame is cut off")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def number(self, kind: str):
        return struct.unpack(f"<{kind}", self.take(struct.calcsize(f"<{kind}")))[0]

    def ids(self) -> list[int]:
        n = self.number("H")
        return list(struct.unpack(f"<{n}Q", self.take(8 * n)))


def frames(data, start: int = 0):
    """(offset, fields, ok) of each frame; a frame that can't be read ends them with fields None."""
    at = start
    while at < len(data):
        r = _Reader(data, at)
        try:
            magic, version, _, rid, sequence, branch, micros = HEAD.unpack(r.take(HEAD.size))
            if magic != MAGIC or version != 1:
                raise ValueError("no frame begins here")
            kind = r.take(r.number("H")).decode()
            encoding = ENCODINGS.get(r.number("B"), "raw")
            payload = r.take(r.number("I"))
            caused, linked, crc = r.ids(), r.ids(), r.number("I")
        except (ValueError, UnicodeDecodeError):
            yield at, None, False
            return
        yield at, (rid, sequence, branch, micros, kind, encoding, payload, caused, linked), zlib.crc32(payload) == crc
        at = r.at


def frame(rid: int, sequence: int, branch: int, micros: int, kind: str, encoding: str, payload: bytes, caused=(), linked=()) -> bytes:
    codes = {v: k for k, v in ENCODINGS.items()}
    name = kind.encode()
    out = HEAD.pack(MAGIC, 1, 0, rid, sequence, branch, micros) + struct.pack("<H", len(name)) + name + struct.pack("<BI", codes[encoding], len(payload)) + payload
    for ids in (caused, linked):
        out += struct.pack(f"<H{len(ids)}Q", len(ids), *ids)
    return out + struct.pack("<I", zlib.crc32(payload))


def little(value: Column, size: int) -> Column:
    """A number's lowest `size` bytes, the least first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.array_join(F.array(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]), ""))


def frame_of(rid: Column, sequence: Column, branch: Column, micros: Column, kind: Column, encoding: Column, payload: Column, caused: Column, linked: Column, crc: Column | None = None) -> Column:
    """A record's frame by DataFrame functions alone: what writes logs in bulk."""
    codes = {v: k for k, v in ENCODINGS.items()}
    code = F.lit(codes["raw"])
    for name, number in codes.items():
        code = F.when(encoding == name, number).otherwise(code)
    ids = lambda a: F.concat(little(F.size(a), 2), F.unhex(F.array_join(F.transform(a, lambda x: F.hex(little(x, 8))), "")))
    head = F.concat(F.lit(MAGIC + bytes([1, 0])), *[little(x, 8) for x in (rid, sequence, branch, micros)])
    return F.concat(head, little(F.octet_length(kind), 2), kind.cast("binary"), little(code, 1), little(F.octet_length(payload), 4), payload, ids(caused), ids(linked), little(F.crc32(payload) if crc is None else crc, 4))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All frames of the log files at a path (see parsed_logs)."""
    return parsed_logs(spark.read.format("binaryFile").load(path)).drop("size")


def parsed_logs(files: DataFrame) -> DataFrame:
    """All frames of logs (path, content), and each log's size; a frame that fails has ok false (and null fields if it
    can't be read)."""
    files = files.select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, rows = memoryview(content.as_buffer()), []
                for at, fields, ok in frames(data):
                    rows.append((name, at, *(fields or (None,) * 9), ok, len(data)))
                    if len(rows) >= 4096:
                        yield block(rows)
                        rows = []
                yield block(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
    names = [x.strip().split()[0] for x in SCHEMA.split(", ")]

    def block(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    return files.mapInArrow(run, SCHEMA)
