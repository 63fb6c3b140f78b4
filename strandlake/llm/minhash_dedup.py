"""Near-duplicate documents: universal hash minima, bands, verification on full sets, components.

1. A document's set: its distinct five-word shingles. Documents with equal sets (by a 128-bit digest of the whole set)
   form a class; only its head (the smallest doc_id) goes on, so copies never meet pair by pair.
2. 80 minima of universal hashes (odd multiplier, shift) make 20 bands of 4. At a likeness of 0.85 a pair misses
   all bands 4 times in ten millions, at 0.8 3 times in 100,000.
3. In each bucket every head is paired with the bucket's smallest. Pairs whose signatures agree on 44 of the 80 minima
   at least are verified on their full sets; links give components. So a large group of near copies is one component
   after as many verified pairs as it has members.
4. What is left are buckets that hold several components. Their members that aren't in the bucket's largest component
   meet all members of other components there, in blocks: signatures first. Pairs that may be near enough join their
   members to families; then a family's whole sets meet in blocks, where all such pairs of different components are
   verified at once, in small numbers one by one, else as a product of incidence matrices.
5. Components of all links by large-star and small-star; a class's rows get the component of its head.

No pair that shares a bucket and whose signatures agree goes untried unless its documents are linked already. A bucket or
family of any size is split into blocks (`tiled`), so no task holds more than two blocks. A group of m documents that are
alike but not near enough costs m * m / 2 comparisons, dealt over the cluster by block.

Documents without words (null or empty text) have an empty set and are linked with nothing. A null doc_id is a document
like any other, but can't be named as a component's smallest: such rows are components of their own, kept. Repeated rows
get equal results; rows of one doc_id with different texts share a component. An empty table gives no rows. Texts of any
length go in whole. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import expanded, shuffle_width, text_hash, text_of, written, zipped
from .components import components
from .shingles import U, Words, mix
from .token_packing import blocks

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
#: A pair is verified if so many of its minima agree.
AGREE = 44
#: Documents, and shingles, that a block holds about.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_random = np.random.default_rng(20)
MULTIPLIERS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
ADDENDS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
SKETCH = "doc_id long, text_hash long, n_shingles long, digest binary, minima binary"


def minima_of(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[text, hash] minima of each text's shingles; texts without any have the largest number."""
    out = np.full((len(first) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for j in range(HASHES):
            hashed = ((numbers * MULTIPLIERS[j] + ADDENDS[j]) >> U(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(hashed, first[full])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """[text, band] 64-bit keys."""
    keys = np.zeros((len(minima), BANDS), U)
    for r in range(ROWS):
        keys = keys * U(0xD1B54A32D192ED03) + minima[:, r::ROWS].astype(U) + U(1)
    return mix(keys + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of each row (a null text: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_of().alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, a digest of the whole set, and the minima of each document."""

    def run(batches):
        for ids, hashes, texts in blocks(batches, "doc_id", "text_hash", "text"):
            sets = Words(texts).sets()
            sizes = np.array([len(s) for s in sets], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            numbers = np.concatenate(sets) if sets else np.zeros(0, U)
            minima = minima_of(numbers, first)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes), pa.array(digests, pa.binary()), pa.array([m.tobytes() for m in minima], pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "minima"])

    return named(docs).mapInArrow(run, SKETCH)


def bands(heads: DataFrame) -> DataFrame:
    """(key, doc_id) of each band of each head."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
                yield pa.record_batch([pa.array(band_keys(minima).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "doc_id"])

    return heads.select("doc_id", "minima").mapInArrow(run, "key long, doc_id long")


def shared_buckets(banded: DataFrame) -> DataFrame:
    """(key, doc_id, hub): the members of buckets with several, and the smallest of each bucket."""
    hubs = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").drop("last")
    return banded.join(hubs, "key")


def agreeing(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs whose signatures agree on enough minima."""
    one = lambda side: heads.select(F.col("doc_id").alias(side), F.col("minima").alias(f"m_{side}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))

    return joined.select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, text as a zstandard frame) of the heads with a wanted doc_id. Only these go on from the join."""
    ours = heads.join(wanted, "doc_id", "left_semi").select("doc_id", "text_hash")
    found = zipped(named(docs).filter(F.col("doc_id").isNotNull())).join(ours, ["doc_id", "text_hash"], "left_semi")
    return found.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text")


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids with 100 * shared >= percent * union on full sets. Pairs come sorted, so a text's
    set is made once for its run of pairs."""
    needed = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), heads)
    one = lambda side: needed.select(F.col("doc_id").alias(side), F.col("text").alias(f"t_{side}"))
    joined = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "t_a", "t_b")

    def run(batches):
        last, own = None, None
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for i in range(0, len(left), 32):
                others = Words([expanded(x) for x in batch.column(3)[i : i + 32].to_pylist()]).sets()
                for k, other in enumerate(others, i):
                    frame = batch.column(2)[k].as_py()
                    if frame != last:
                        last, own = frame, Words([expanded(frame)]).sets()[0]
                    ok.append(near(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other), percent))
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def near(shared, size, other, percent: int):
    return (shared > 0) & (100 * shared >= percent * (size + other - shared))


def tiled(rows: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
    """Deals out groups whose members of different components are to meet. `rows` (group, doc_id, component, ...; a
    table) of each group with several components come back with a tile and a side: each tile is a block of outsiders (not
    in the group's largest component; side 1) and a block of members (side 2), both about `most` heavy; 3 stands for both
    sides where one tile is enough. Every outsider meets every member in one tile."""
    sizes = rows.groupBy(group, "component").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    whole = sizes.groupBy(group).agg(F.max(F.struct("n", "component", "w")).alias("home"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("home.n < n")
    # Groups with the same members are one.
    single = whole.groupBy("n", "w", "x", "y").agg(F.min(group).alias("g"), F.min("home").alias("home"))
    parts = lambda w: F.greatest(F.ceil(w / most), F.lit(1)).cast("int")
    cut = single.select(F.col("g").alias(group), F.col("home.component").alias("home"), parts(F.col("w") - F.col("home.w")).alias("rows_"), parts(F.col("w")).alias("columns_"))
    joined = rows.join(cut, group)
    out = F.col("component") != F.col("home")
    row, column = (F.pmod(F.xxhash64("doc_id", F.lit(s)), F.col(c)).cast("int") for s, c in ((2, "rows_"), (3, "columns_")))
    tile = lambda r, c, side: F.struct(r.alias("row"), c.alias("column"), F.lit(side).alias("side"))
    numbers = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_member = F.transform(numbers("rows_"), lambda r: tile(r, column, 2))
    as_outsider = F.transform(numbers("columns_"), lambda c: tile(row, c, 1))
    alone = (F.col("rows_") == 1) & (F.col("columns_") == 1)
    zero = F.lit(0)
    tiles = F.when(alone & out, F.array(tile(zero, zero, 3))).when(out, F.concat(as_member, as_outsider)).otherwise(as_member)
    return joined.select(*rows.columns, F.explode(tiles).alias("t")).select(*rows.columns, "t.*")


def _labels(links: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Component labels of n items: `links` is [outsider, member] and true where they are linked; outsider i is
    member same[i] too, where that isn't -1. The label of each member, and of outsiders after them."""
    rows, columns = links.shape
    label = np.arange(columns + rows)
    both = np.flatnonzero(same >= 0)
    while True:
        before = label.copy()
        ours, theirs = label[columns:], label[:columns]
        for i in range(0, rows, 256):
            part = links[i : i + 256]
            ours[i : i + 256] = np.minimum(ours[i : i + 256], np.where(part, theirs, columns + rows).min(1, initial=columns + rows))
            np.minimum(theirs, np.where(part, ours[i : i + 256, None], columns + rows).min(0, initial=columns + rows), out=theirs)
        low = np.minimum(ours[both], theirs[same[both]])
        ours[both] = theirs[same[both]] = low
        if (before == label).all():
            return label


def candidates(left, right) -> np.ndarray:
    """[outsider, member]: of different components, and minima's low bytes agree often enough. Each side: doc_ids,
    components, low bytes."""
    found = np.zeros((len(left[0]), len(right[0])), bool)
    for i in range(len(left[0])):
        found[i] = (right[2] == left[2][i]).sum(1, dtype=np.int16) >= AGREE
    return found & (left[1][:, None] != right[1][None, :])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all left and all right sets: products of incidence matrices, some columns (numbers
    that both sides have) at a time."""
    numbers = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(np.unique(numbers[0]), np.unique(numbers[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for sets, held in zip((left, right), numbers):
        at = np.searchsorted(both, held)
        use = at < len(both)
        use[use] = both[at[use]] == held[use]
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[use]
        order = np.argsort(at[use], kind="stable")
        placed.append((at[use][order], row[order]))
    for c in range(0, len(both), width):
        dense = []
        for (column, row), n in zip(placed, out.shape):
            p, q = np.searchsorted(column, (c, c + width))
            block = np.zeros((n, min(width, len(both) - c)), np.float32)
            block[row[p:q], column[p:q] - c] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


def verified_links(wanted: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the wanted [outsider, member] pairs are near on their full sets."""
    links = np.zeros(wanted.shape, bool)
    rows, columns = np.nonzero(wanted)
    if len(rows) > 2 * sum(wanted.shape):
        use_row, use_column = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        x, y = [left[i] for i in use_row], [right[j] for j in use_column]
        shared = shared_counts(x, y).astype(np.int64)
        near_ = near(shared, np.array([len(s) for s in x])[:, None], np.array([len(s) for s in y])[None, :], percent)
        links[np.ix_(use_row, use_column)] = near_
        return links & wanted
    for i, j in zip(rows.tolist(), columns.tolist()):
        links[i, j] = near(len(np.intersect1d(left[i], right[j], assume_unique=True)), len(left[i]), len(right[j]), percent)
    return links


def meet(tiles: DataFrame, group: str, percent: int | None = None) -> DataFrame:
    """Edges (u, v) that connect what the pairs in the tiles connect: without `percent`, pairs that may be near
    enough; with it (tiles then have `numbers`, whole sets), pairs that are."""
    names = [group, "row", "column", "side", "doc_id", "component", "low", *(["numbers"] if percent else [])]

    def edges(held):
        side = np.array(held[0])
        ids, components_ = np.array(held[1], np.int64), np.array(held[2], np.int64)
        low = np.frombuffer(b"".join(held[3]), np.uint8).reshape(-1, HASHES)
        outside, inside = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        if not len(outside) or not len(inside):
            return None
        pick = lambda at: (ids[at], components_[at], low[at])
        links = candidates(pick(outside), pick(inside))
        if percent and links.any():
            sets = [np.frombuffer(x, U) for x in held[4]]
            links = verified_links(links, [sets[i] for i in outside.tolist()], [sets[i] for i in inside.tolist()], percent)
        if not links.any():
            return None
        place = np.full(len(side), -1)
        place[inside] = np.arange(len(inside))
        label = _labels(links, np.where(side[outside] == 3, place[outside], -1))
        every = np.concatenate([ids[inside], ids[outside]])
        moved = np.flatnonzero(every != every[label])
        return every[moved], every[label[moved]]

    def run(batches):
        key, held = None, [[] for _ in names[3:]]

        def close():
            found = edges(held)
            for x in held:
                x.clear()
            if found:
                yield pa.record_batch([pa.array(x) for x in found], ["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:3] != key:
                    if key is not None:
                        yield from close()
                    key = row[:3]
                for x, v in zip(held, row[3:]):
                    x.append(v)
        if key is not None:
            yield from close()

    where = [group, "row", "column"]
    dealt = tiles.select(*names).repartition(shuffle_width(tiles.sparkSession), *where).sortWithinPartitions(*where)
    return dealt.mapInArrow(run, "u long, v long")


def low_bytes(minima: np.ndarray) -> bytes:
    return minima.astype(np.uint8).tobytes()


def missing_links(shared: DataFrame, placed: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """Edges (u, v) between components that pairs other than those with a bucket's smallest member link; None if no
    pair can."""
    low = heads.select("doc_id", "low")
    member = placed.select(F.col("node").alias("doc_id"), "component")
    known = lambda rows: rows.join(member, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    at = written(known(shared.select("key", "doc_id")), "placed")
    may = written(meet(tiled(at, "key", F.lit(1), BLOCK).join(low, "doc_id"), "key").distinct(), "may")
    if may.isEmpty():
        return None
    family = components(may).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    texts = texts_of(docs, family.select("doc_id"), heads)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                sets = Words([expanded(x) for x in batch.column(1)[i : i + 32].to_pylist()]).sets()
                yield pa.record_batch([batch.column(0)[i : i + 32], pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "numbers"])

    sets = texts.mapInArrow(run, "doc_id long, numbers binary")
    rows = written(known(family.join(heads.select("doc_id", "n_shingles"), "doc_id")), "families")
    tiles = tiled(rows, "family", F.greatest(F.col("n_shingles") / BLOCK_SHINGLES, F.lit(1 / BLOCK)), 1)
    return meet(tiles.join(low, "doc_id").join(sets, "doc_id"), "family", percent)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs`."""
    sketch = written(sketches(docs), "sketches")
    full = sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())

    def narrowed(batches):
        for batch in batches:
            if batch.num_rows:
                minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES)
                yield batch.append_column("low", pa.array([low_bytes(m) for m in minima], pa.binary()))

    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima"))
    heads = classes.select("digest", "head.doc_id", "head.text_hash", "n_rows", "n_shingles", "minima")
    heads = written(heads.mapInArrow(narrowed, "digest binary, doc_id long, text_hash long, n_rows long, n_shingles long, minima binary, low binary"), "heads")
    shared = written(shared_buckets(bands(heads)), "buckets")
    pairs = shared.filter("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(verified(written(agreeing(pairs, heads), "pairs"), docs, heads, percent), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Rows of one doc_id with different texts: their heads are linked.
    several = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc_id")
    aliases = full.join(several, "doc_id", "left_semi").select("digest", F.col("doc_id").alias("u")).join(heads.select("digest", F.col("doc_id").alias("v")), "digest").select("u", "v").filter("u <> v")
    placed = components(links.unionByName(aliases))
    more = missing_links(shared, placed, heads, docs, percent)
    if more is not None:
        placed = components(placed.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    found = heads.join(placed, F.col("doc_id") == F.col("node"), "left").filter((F.col("n_rows") > 1) | F.col("component").isNotNull())
    found = found.select(F.col("digest").alias("d"), F.coalesce("component", "doc_id").alias("component"))
    named_of = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return sketch.select("doc_id", "n_shingles", "digest").join(found, F.col("digest") == F.col("d"), "left").select("doc_id", "n_shingles", named_of.alias("component_id"))


def op9_minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs`, unchanged, but for those in whose component a smaller doc_id is. Texts are near copies at a
    likeness of 0.8 or more."""
    gone = near_duplicates(docs, percent).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone_doc")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone_doc"), "left_anti")
