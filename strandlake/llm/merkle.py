"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces.

A paragraph is a line with its line end; a section ends before a blank line's successor and after a
paragraph whose own digest says so, so that an edit moves no section end but those beside it. Digests
go up by SHA-256: equal roots mean equal texts. Below paragraphs lie pieces of at most 48 bytes with a
32-bit mark each, which locate an edit inside a paragraph and measure likeness.

A fingerprint is text: `root:section;section;...`, a section being `digest=paragraph,paragraph,...`
and a paragraph `digest.pieces` (base64 of a mark and a length, five bytes for each piece).

A null text is empty, as an empty one it has a root without sections. Null doc_ids come last, rows of one doc_id go by
their text, equal ones are each other's next. Texts of any length count whole. An empty table gives no rows; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bucket_of, cut_points, shuffle_width, text_of

PIECE = re.compile(rb"[^.!?]{1,48}[.!?]{0,48}\s{0,48}|[.!?]{1,48}\s{0,48}")
LINE = re.compile(rb"[^\n]*\n|[^\n]+")
#: Of 256 values of a paragraph digest's first byte, those that end a section.
ENDS = 32
#: Buckets of doc_id to a partition, so that hashing buckets to partitions stays even.
BUCKETS = 4
LOWEST = -(1 << 63)


class Tree:
    """The tree of a text: root digest, sections (digest, number of paragraphs), paragraphs (digest,
    marks, lengths)."""

    def __init__(self, text: str):
        raw, self.paragraphs, self.sections = text.encode(), [], []
        digests: list[bytes] = []

        def close():
            self.sections.append((hashlib.sha256(b"section" + b"".join(digests)).digest(), len(digests)))
            digests.clear()

        blank = False
        for line in LINE.findall(raw):
            if blank and digests and line.strip():
                close()
            blank = not line.strip()
            pieces = PIECE.findall(line)
            digest = hashlib.sha256(line).digest()
            digests.append(digest)
            self.paragraphs.append((digest, list(map(zlib.crc32, pieces)), list(map(len, pieces))))
            if digest[0] < ENDS:
                close()
        if digests:
            close()
        self.root = hashlib.sha256(b"text" + b"".join(d for d, _ in self.sections)).hexdigest()

    def __str__(self) -> str:
        out, at = [], 0
        for digest, n in self.sections:
            inner = []
            for d, marks, lengths in self.paragraphs[at : at + n]:
                packed = b"".join(map(struct.Struct("<IB").pack, marks, lengths))
                inner.append(f"{d[:8].hex()}.{base64.b64encode(packed).decode()}")
            out.append(f"{digest[:8].hex()}={','.join(inner)}")
            at += n
        return f"{self.root}:{';'.join(out)}"

    def bag(self) -> Counter:
        return Counter(x for _, marks, lengths in self.paragraphs for x in zip(marks, lengths))


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[tuple[int, int]]]]]]]:
    root, _, rest = fingerprint.partition(":")
    sections = []
    for section in filter(None, rest.split(";")):
        digest, _, inner = section.partition("=")
        paragraphs = []
        for paragraph in inner.split(","):
            d, _, packed = paragraph.partition(".")
            paragraphs.append((d, list(struct.iter_unpack("<IB", base64.b64decode(packed)))))
        sections.append((digest, paragraphs))
    return root, sections


def shared_bytes(a: Counter, b: Counter) -> float:
    """Twice the bytes of the pieces that both have, as a share of the bytes of both."""
    both = sum(length * n for (_, length), n in a.items()) + sum(length * n for (_, length), n in b.items())
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return 2 * sum(x[1] * min(n, large[x]) for x, n in small.items() if x in large) / both if both else 1.0


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 1 for equal roots, and for those alone."""
    (root, x), (other, y) = parse(a), parse(b)
    if root == other:
        return 1.0
    bags = [Counter(p for _, paragraphs in sections for _, pieces in paragraphs for p in pieces) for sections in (x, y)]
    return min(shared_bytes(*bags), 1 - 2**-40)


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Paragraphs (section, place) of the first fingerprint that the second doesn't have in an equal
    section or as an equal paragraph: only differing branches are gone into."""
    (root, x), (other, y) = parse(a), parse(b)
    if root == other:
        return []
    same = {digest for digest, _ in y}
    had = {d for _, paragraphs in y for d, _ in paragraphs}
    return [(i, k) for i, (digest, paragraphs) in enumerate(x) if digest not in same for k, (d, _) in enumerate(paragraphs) if d not in had]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each whole text; null counts as empty. No shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([str(Tree(t)) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _near(a: Tree, a_bag: Counter, b: Tree, b_bag: Counter) -> float:
    return 1.0 if a.root == b.root else min(shared_bytes(a_bag, b_bag), 1 - 2**-40)


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (bucket, marker, place, doc_id, text), dealt and sorted so that each row's successor by
    descending doc_id (null ids last, rows of one id by text) is the next row of its bucket; the last
    row of a bucket is followed by a marker, a copy of the first row of the next bucket. The text is
    shuffled once, with one more row for each bucket."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("place", F.coalesce("doc_id", F.lit(LOWEST)))
    points = cut_points(keyed, "place", BUCKETS * width)
    rows = keyed.withColumn("bucket", bucket_of(F.col("place"), points)).withColumn("marker", F.lit(0))
    # One row for each bucket: as many as cut points.
    firsts = sorted((r.bucket, r.first) for r in rows.groupBy("bucket").agg(F.max("place").alias("first")).collect())
    follows = [(bucket, firsts[i - 1][1]) for i, (bucket, _) in enumerate(firsts)]
    followed = spark.createDataFrame(follows, "target int, first long")
    markers = keyed.join(F.broadcast(followed), F.col("place") == F.col("first")).select("doc_id", "text", "place", F.col("target").alias("bucket"), F.lit(1).alias("marker"))
    dealt = rows.unionByName(markers).repartition(width, "bucket")
    return dealt.sortWithinPartitions("bucket", "marker", F.desc("place"), "text").select("bucket", "marker", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints each text and its edited text: the last third replaced by the next document's start."""

    def run(batches):
        held = None  # the row before: bucket, doc_id, text, tree, bag
        rows = {k.split()[0]: [] for k in RESULT.split(", ")}

        def emit(text, tree, bag):
            _, doc_id, own, own_tree, own_bag = held
            cut = len(own) // 3
            edited = own[: len(own) - cut] + text[:cut]
            edited_tree = Tree(edited)
            values = (doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), str(own_tree), str(edited_tree), _near(own_tree, own_bag, edited_tree, edited_tree.bag()), _near(own_tree, own_bag, tree, bag))
            for k, v in zip(rows, values):
                rows[k].append(v)

        def block():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            out = pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))
            for v in rows.values():
                v.clear()
            return out

        for batch in batches:
            for bucket, marker, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if marker and held is None:
                    continue
                tree = Tree(text)
                bag = tree.bag()
                if held is not None:
                    emit(text, tree, bag)
                held = None if marker else (bucket, doc_id, text, tree, bag)
                if len(rows["doc_id"]) >= 256:
                    yield block()
        if rows["doc_id"]:
            yield block()

    return with_successors(docs).mapInArrow(run, RESULT)
