"""Exact removal of repeated byte strings, with a suffix array built column by column.

The least length is 100 bytes. Of each 100-byte string the 32-byte piece with the least hash is its anchor, so
equal strings have equal anchors in the same place. Anchors are found in each text where it is read.

1. An anchor's surroundings are all bytes of the 100-byte strings that can hold it: 68 before, 100 from it on, less
   where the text ends. Where equal surroundings (by hash) come earlier, in the same task or after a shuffle by
   anchor, all those strings are repeats, and the whole stretch goes.
2. Where an anchor has several different surroundings, one of each is cut out as a segment of 168 columns. The
   segments of a partition are the documents of a column-wise construction: columns come from the last to the first,
   each round inserts one symbol for each segment, which makes the next suffix order from the last one (a stable
   sort by the column of the Burrows-Wheeler transform) with its common prefixes (range minima of the last).
   Segments stream in the order of their anchors, and whole anchors make up a block of about 200,000. Runs of
   suffixes with a common prefix of 100 are equal strings, byte by byte; all but the earliest of a run are repeats.
3. The stretches of a document are merged and cut out.

Equal strings stand at equal columns, for the anchor does. So the construction needs 168 rounds of sorting one
column; over whole documents it would need as many rounds as the longest has bytes.

A row's key is (doc_id, hash of its text): rows equal in both get equal results and are no repeats of each other, texts
that differ under one doc_id are documents of their own, in the order of that hash. A null doc_id comes before all
others; a null or empty text has no bytes. A text of any length is worked on whole. An empty table gives no rows; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, expanded, keyed, shuffle_width, written, zipped
from .shingles import SYMBOLS, U, mix, powers, sliding
from .token_packing import blocks

LENGTH, ANCHOR = 100, 32
BEFORE = LENGTH - ANCHOR
COLUMNS = BEFORE + LENGTH
PAD = 256
#: Anchors that a task combines at once.
COMBINE = 1_000_000
#: Segments that a block of whole anchors has about.
SEGMENTS = 200_000


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the anchors of all texts: text, place, anchor hash, hash of the surroundings, begin and end of these."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(SYMBOLS[raw] * up[:n], out=sums[1:])
    grams = mix((sums[ANCHOR:] - sums[: n - ANCHOR + 1]) * down[: n - ANCHOR + 1])
    least = sliding(grams, BEFORE + 1)
    # A string that runs into the next text counts for no anchor.
    whole = np.zeros(len(least) + 1, np.int32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= LENGTH:
            whole[a] += 1
            whole[b - LENGTH + 1] -= 1
    least = np.where(np.cumsum(whole[:-1]) > 0, least, U(0))
    padded = np.concatenate([np.zeros(BEFORE, U), least, np.zeros(BEFORE, U)])
    at = np.flatnonzero((sliding(padded, BEFORE + 1, np.maximum) == grams) & (grams > 0))
    text = np.searchsorted(offsets, at, "right") - 1
    begin, end = np.maximum(at - BEFORE, offsets[text]), np.minimum(at + LENGTH, offsets[text + 1])
    digest = hashlib.blake2b
    around = np.frombuffer(b"".join([digest(joined[b:e], digest_size=8).digest() for b, e in zip(begin.tolist(), end.tolist())]), np.int64)
    # Where the anchor lies in them counts too.
    around = mix(around.view(U) + (at - begin).astype(U)).view(np.int64)
    origin = offsets[text]
    return text, at - origin, grams[at].view(np.int64), around, begin - origin, end - origin


def merged(keys: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Overlapping or touching stretches with equal keys as one."""
    if not len(begin):
        return keys, begin, end
    order = np.lexsort((end, begin, *keys[::-1]))
    keys, begin, end = [k[order] for k in keys], begin[order], end[order]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    group = np.cumsum(new)
    # Running maximum of the ends under one key: keys are lifted apart.
    lift = (group - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    first = new | np.concatenate([[True], begin[1:] > reach[:-1]])
    starts = np.flatnonzero(first)
    return [k[starts] for k in keys], begin[starts], np.maximum.reduceat(end, starts)


FOUND = "kind int, anchor long, around long, doc_id long, text_hash long, place long, begin long, end long"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]
ANCHORED, STRETCH, SEGMENT = 0, 1, 2


def _rows(kind: int, anchor, around, doc, text, place, begin, end):
    for i in range(0, len(doc), 50_000):
        cut = [np.asarray(x[i : i + 50_000], np.int64) for x in (anchor, around, doc, text, place, begin, end)]
        yield pa.record_batch([pa.array(np.full(len(cut[0]), kind, np.int32)), *map(pa.array, cut)], _NAMES)


def _stretches(doc, text, begin, end):
    (doc, text), begin, end = merged([doc, text], begin, end)
    none = np.zeros(len(doc), np.int64)
    return _rows(STRETCH, none, none, doc, text, none, begin, end)


def _split(anchor, around, doc, text, place, begin, end):
    """Sorted by surroundings, then document and place: which rows are the first of theirs, and which repeat an
    earlier row whose strings fill a stretch."""
    order = np.lexsort((place, text, doc, around, anchor))
    rows = [x[order] for x in (anchor, around, doc, text, place, begin, end)]
    new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, int)
    later = ~new & np.any([rows[i] != rows[i][head] for i in (2, 3, 4)], axis=0)
    return rows, new, later


def whole_keys(batches, columns: range, least: int):
    """Rows of sorted batches as arrays, in blocks of `least` rows or more that end where the first column changes."""
    held, count = [], 0
    for batch in batches:
        own = [batch.column(i).to_numpy() for i in columns]
        if not len(own[0]):
            continue
        if count >= least and own[0][0] != held[-1][0][-1]:
            yield [np.concatenate(x) for x in zip(*held)]
            held, count = [], 0
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if cut and count + cut >= least:
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in own])]
            held, count, own = [], 0, [x[cut:] for x in own]
        held.append(own)
        count += len(own[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def find_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of all texts (keyed rows); those that a task has seen before with equal surroundings are stretches at once."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            rows, new, later = _split(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            yield from _rows(ANCHORED, *(x[new] for x in rows))
            yield from _stretches(*(rows[i][later] for i in (2, 3, 5, 6)))

        count = 0
        for ids, hashes, texts in blocks(batches, "doc_id", "text_hash", "text"):
            text, place, anchor, around, begin, end = anchors([t.encode() for t in texts])
            held.append((anchor, around, np.array(ids, np.int64)[text], np.array(hashes, np.int64)[text], place, begin, end))
            count += len(text)
            if count >= COMBINE:
                yield from flush()
                count = 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, FOUND)


def compare_surroundings(found: DataFrame) -> DataFrame:
    """After the shuffle by anchor: stretches for equal surroundings, segments for anchors with several."""

    def run(batches):
        rest = []

        def anchored():
            for batch in batches:
                other = batch.column(0).to_numpy() != ANCHORED
                if other.any():
                    rest.append(batch.filter(pa.array(other)))
                yield batch.filter(pa.array(~other)) if other.any() else batch

        for rows in whole_keys(anchored(), range(1, 8), 100_000):
            yield from rest
            rest.clear()
            first, new, later = _split(*rows)
            yield from _stretches(*(first[i][later] for i in (2, 3, 5, 6)))
            heads = [x[new] for x in first]
            edge = np.concatenate([[True], heads[0][1:] != heads[0][:-1]])
            sizes = np.diff(np.append(np.flatnonzero(edge), len(edge)))
            several = np.repeat(sizes > 1, sizes)
            yield from _rows(SEGMENT, *(x[several] for x in heads))
        yield from rest

    spread = F.when(F.col("kind") == ANCHORED, F.col("anchor")).otherwise(F.col("doc_id").bitwiseXOR(F.col("text_hash")))
    dealt = found.withColumn("spread", spread).repartition(shuffle_width(found.sparkSession), "spread").drop("spread")
    return dealt.sortWithinPartitions("kind", "anchor").mapInArrow(run, FOUND)


def cut_segments(places: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of each segment. A document's places (no more than it has bytes) meet its text once."""
    held = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "place", "begin", "end")).alias("places"))
    kinds = "anchor long, doc_id long, text_hash long, place long, begin long, end long, bytes binary"

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, text, frame, held in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = expanded(frame).encode()
                for p in held:
                    for x, v in zip(out, (p["anchor"], doc, text, p["place"], p["begin"], p["end"], raw[p["begin"] : p["end"]])):
                        x.append(v)
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.binary())], [k.split()[0] for k in kinds.split(", ")])

    # Repeated rows give a segment twice; it is no repeat of itself.
    return held.join(texts, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places").mapInArrow(run, kinds)


def insert_columns(columns, n: int, length: int, last_start: int):
    """Column-wise construction over n equally long strings. `columns(c)` gives the symbols of column c; columns
    come from the last to the first. Yields (start, order, common prefixes) of the suffixes from each column up
    to `last_start`, in rising suffix order."""
    order, common = np.arange(n), np.zeros(n, np.int64)
    for c in range(length - 1, -1, -1):
        symbols = columns(c)[order]
        by = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[by]
        fresh = np.zeros(n, np.int64)
        same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        if len(same):
            # Between two suffixes that get the same symbol the common prefix is the least on the way.
            ends = np.empty(2 * len(same), np.int64)
            ends[::2], ends[1::2] = by[same - 1] + 1, by[same] + 1
            fresh[same] = 1 + np.minimum.reduceat(np.append(common, 0), ends)[::2]
        order, common = order[by], fresh
        if c <= last_start:
            yield c, order, common


def repeated_strings(segments: DataFrame) -> DataFrame:
    """Stretches of the segments' strings that come earlier."""

    def run(batches):
        names = ["anchor", "doc_id", "text_hash", "place", "begin", "end"]
        held: list = []

        def segments_of():
            for batch in batches:
                held.append(batch.column(6))
                yield batch

        at = 0
        for rows in whole_keys(segments_of(), range(len(names)), SEGMENTS):
            doc, text, place, begin, end = rows[1:]
            n = len(doc)
            # Columns one after the other, a segment's bytes standing so that its anchor begins at column BEFORE.
            columns = np.full((COLUMNS, n), PAD, np.uint16)
            raw = pa.chunked_array(held).slice(at, n).to_pylist()
            whole = np.frombuffer(b"".join(raw), np.uint8)
            sizes, left = end - begin, BEFORE - (place - begin)
            inside = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns[inside + np.repeat(left, sizes), np.repeat(np.arange(n), sizes)] = whole
            at += n
            while held and len(held[0]) <= at:
                at -= len(held.pop(0))
            by_place = np.lexsort((place, text, doc))
            rank = np.empty(n, np.int64)
            rank[by_place] = np.arange(n)
            low, high = np.full(n, COLUMNS), np.full(n, -1)
            first_start, last_start = left, BEFORE + (end - place) - LENGTH
            for start, order, common in insert_columns(lambda c: columns[c], n, COLUMNS, BEFORE):
                edge = common < LENGTH
                edge[0] = True
                runs = np.flatnonzero(edge)
                ranks = rank[order]
                earliest = np.repeat(np.minimum.reduceat(ranks, runs), np.diff(np.append(runs, n)))
                head = by_place[earliest]
                other = np.any([x[order] != x[head] for x in (doc, text, place)], axis=0)
                hit = order[other & (start >= first_start[order]) & (start <= last_start[order])]
                low[hit] = np.minimum(low[hit], start)
                high[hit] = np.maximum(high[hit], start)
            found = high >= 0
            origin = (place - BEFORE)[found]
            # All strings of a segment hold its anchor, so those between the first and the last repeat cover one stretch.
            yield from _stretches(doc[found], text[found], origin + low[found], origin + high[found] + LENGTH)

    dealt = segments.repartition(shuffle_width(segments.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, FOUND)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """Each row's remaining bytes, with its figures."""
    rows = keyed(docs)
    texts = zipped(rows)
    found = written(compare_surroundings(find_anchors(rows)), "surroundings")
    repeats = repeated_strings(cut_segments(found.filter(F.col("kind") == SEGMENT), texts))
    stretches = found.filter(F.col("kind") == STRETCH).unionByName(repeats).select("doc_id", "text_hash", "begin", "end")
    held = stretches.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "end")).alias("stretches"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, frame, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = expanded(frame).encode()
                pairs = np.array([(x["begin"], x["end"]) for x in held or ()], np.int64).reshape(-1, 2)
                _, begin, end = merged([np.zeros(len(pairs), np.int64)], pairs[:, 0], pairs[:, 1])
                parts, at = [], 0
                for a, b in zip(begin.tolist(), end.tolist()):
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join(parts) + raw[at:]
                values = (None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None)
                for x, v in zip(out, values):
                    x.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return texts.join(held, ["doc_id", "text_hash"], "left").select("doc_id", "text", "stretches").mapInArrow(run, RESULT)


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, keep_bytes=False).drop("kept")
