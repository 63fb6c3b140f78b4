"""Blobs by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed value: bytes that a blob's file has besides its content and type.
OVERHEAD = 19


def hashed(rows: DataFrame) -> DataFrame:
    """(hash, shard, content, content_type, size, crc32) of rows (content, content_type)."""
    content = F.col("content").cast("binary")
    return rows.select(F.sha2(content, 256).alias("hash"), content.alias("content"), "content_type", *[c for c in rows.columns if c not in ("content", "content_type")]).select(
        "*", F.substring("hash", 1, 2).alias("shard"), F.length("content").cast("bigint").alias("size"), F.crc32("content").alias("crc32"))


def stored(rows: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """New blobs: the first row of each hash by `order`, if it isn't stored. Contents don't go through the grouping:
    it finds each hash's first row, which is then joined back by its place."""
    found = hashed(rows)
    firsts = found.groupBy("hash").agg(F.min(order).alias(order))
    if existing is not None:
        firsts = firsts.join(existing.select("hash"), "hash", "left_anti")
    return found.join(firsts, ["hash", order], "left_semi").dropDuplicates(["hash"])


def verified(blobs: DataFrame) -> DataFrame:
    return blobs.select("hash", "content_type", "size", (F.crc32("content") == F.col("crc32")).alias("crc_ok"), (F.sha2("content", 256) == F.col("hash")).alias("hash_ok"))


def total_size(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.sum(F.col("size") + OVERHEAD + F.octet_length("content_type")).cast("bigint").alias("total_size"), F.count("*").alias("n_blobs"))


def get(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted hashes (hash) with their contents; null where a blob is missing or its content no longer has that hash."""
    held = wanted.join(blobs.select("hash", "content", "content_type"), "hash", "left")
    sound = F.sha2("content", 256) == F.col("hash")
    return held.select("hash", F.when(sound, F.col("content")).alias("content"), F.when(sound, F.col("content_type")).alias("content_type"))


def deleted(blobs: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blobs that stay, and the hashes with whether each was there."""
    there = blobs.select("hash").withColumn("was_there", F.lit(True))
    gone = hashes.distinct().join(there, "hash", "left").withColumn("was_there", F.coalesce("was_there", F.lit(False)))
    return blobs.join(hashes, "hash", "left_anti"), gone


def listed(blobs: DataFrame) -> DataFrame:
    return blobs.select("hash")
