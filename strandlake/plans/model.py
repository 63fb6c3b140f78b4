"""The relations of the engine as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ordering import positioned
from ..sources import log_format


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the records of branch 1, in order."""
    at = (F.col("event_id") + 1).alias
    return events(spark, sf_dir).select(at("id"), F.lit(1).cast("bigint").alias("branch"), at("sequence"), F.col("ts"), F.col("event_type").alias("record_type"), F.col("props").cast("binary").alias("payload"), F.col("user_id"))


def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with links: caused by the record of their user that is the same number of steps before as their id
    modulo seven, linked to the user's number of records before them. Both lie among earlier ids."""
    rows = records(spark, sf_dir)
    caused = F.when(F.col("id") > 7, F.array(F.col("id") - 1 - F.col("id") % 7)).otherwise(F.array().cast("array<bigint>"))
    linked = F.when(F.col("id") % 3 == 0, F.array(F.col("user_id") + 1, F.col("user_id") + 1)).otherwise(F.array(F.col("user_id") + 1))
    return rows.withColumn("caused_by", caused).withColumn("linked_to", linked)


def branched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records dealt to three branches, each with its own dense sequence."""
    rows = records(spark, sf_dir).drop("sequence").withColumn("branch", 1 + F.col("user_id") % 3)
    return positioned(rows, ["branch"], "id", "sequence")


def conversation_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log for each conversation."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id"), (F.col("turn") + 1).alias("sequence"), F.lit("Append").alias("op"), F.to_json(F.struct("role", "text")).alias("value"))


def slot_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot slot for each user: its last value."""
    return events(spark, sf_dir).select("user_id", (F.col("event_id") + 1).alias("sequence"), F.lit("Set").alias("op"), F.col("props").alias("value"))


def edited_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log for each user with edits (purchases) and redactions (errors)."""
    kind = F.col("event_type")
    number = F.col("event_id") + 1
    return events(spark, sf_dir).select(
        "user_id", number.alias("sequence"), F.when(kind == "purchase", "Edit").when(kind == "error", "Redact").otherwise("Append").alias("op"),
        number.cast("string").alias("value"), (number % 5).alias("idx"), (number % 5 + number % 3).alias("idx_end"))


def tree_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a path for each user and event type; errors remove their user's views, purchases are batches of two."""
    kind = F.col("event_type")
    path = lambda name: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), name)
    entry = F.struct(F.sha2("props", 256).alias("blob_hash"), F.length("props").cast("bigint").alias("size"), F.lit(420).alias("mode"))
    none = F.lit(None).cast("struct<blob_hash: string, size: bigint, mode: int>")
    batch = F.array(F.struct(F.lit("set").alias("op"), path(F.lit("order")).alias("path"), entry.alias("entry")), F.struct(F.lit("remove").alias("op"), path(F.lit("click")).alias("path"), none.alias("entry")))
    return events(spark, sf_dir).select(
        F.lit("files").alias("state_id"), (F.col("event_id") + 1).alias("sequence"),
        F.when(kind == "error", "TreeRemove").when(kind == "purchase", "TreeBatch").otherwise("TreeSet").alias("op"),
        F.when(kind == "error", path(F.lit("view"))).when(kind != "purchase", path(kind)).alias("path"),
        F.when(~kind.isin("error", "purchase"), entry).alias("entry"), F.when(kind == "purchase", batch).alias("ops"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each customer: a binary tree of forks, some deleted, some without inherited state."""
    key = F.col("c_custkey") + 1
    rows = table(spark, sf_dir, "customer").select(key.cast("bigint").alias("id"))
    parent = F.when(F.col("id") > 1, F.floor(F.col("id") / 2).cast("bigint"))
    return rows.select(
        "id", F.concat(F.lit("b"), F.col("id").cast("string")).alias("name"), parent.alias("parent"), (F.col("id") * 37 % 5000).alias("branch_point"),
        F.timestamp_seconds(F.col("id") * 3600).alias("created"), ((F.col("id") % 7 == 3) & (F.col("id") > 1)).alias("deleted"), parent.alias("state_parent"), (F.col("id") % 11 != 5).alias("inherits_state"))


def branch_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on the branches; a state for each event type. A branch's own lie after its branch point."""
    rows = events(spark, sf_dir).select((1 + F.col("user_id")).alias("branch"), (F.col("event_id") + 1).alias("sequence"), F.col("event_type").alias("state_id"), F.lit("Set").alias("op"), F.col("props").alias("value"))
    points = branches(spark, sf_dir).select(F.col("id").alias("branch"), "branch_point").hint("merge")
    return rows.join(points, "branch").filter(F.col("sequence") > F.when(F.col("branch") == 1, 0).otherwise(F.col("branch_point"))).drop("branch_point")


def branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches with their heads: the last own operation, else the branch point."""
    heads = branch_ops(spark, sf_dir).groupBy("branch").agg(F.max("sequence").alias("own")).hint("merge")
    rows = branches(spark, sf_dir)
    return rows.join(heads, rows["id"] == heads["branch"], "left").withColumn("head", F.greatest(F.coalesce("own", F.lit(0)), "branch_point")).drop("own", "branch")


def feed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch_ops as a feed has them."""
    return branch_ops(spark, sf_dir).withColumn("record_id", F.col("sequence")).withColumn("derived", F.lit(False))


def logs(spark: SparkSession, sf_dir: str, least: int = 1, damaged: int | None = None) -> DataFrame:
    """(path, log, content): binary record logs of the events, one for each fortieth of the users, with `least` records at
    least; `damaged`: the number of the record in each log whose payload isn't what its checksum says."""
    at = F.row_number().over(Window.partitionBy("log").orderBy("event_id"))
    rows = events(spark, sf_dir).withColumn("log", F.col("user_id") % 40).withColumn("i", at)
    frame = log_format.frame_of(
        F.col("event_id") + 1, F.col("event_id") + 1, 1 + F.col("user_id") % 5, F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_type"), F.lit("json"), F.col("props").cast("binary"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>"),
        F.crc32(F.col("props").cast("binary")) + F.when(F.col("i") == F.lit(damaged), 1).otherwise(0))
    framed = rows.select("log", "event_id", frame.alias("frame"))
    joined = framed.groupBy("log").agg(F.array_sort(F.collect_list(F.struct("event_id", F.hex("frame").alias("frame")))).alias("f"), F.count("*").alias("n"))
    return joined.filter(F.col("n") >= least).select(F.col("log").cast("string").alias("path"), "log", F.unhex(F.array_join(F.transform("f", lambda x: x["frame"]), "")).alias("content"))


def blob_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.lit("text/plain").alias("content_type"), F.col("doc_id").alias("place"))
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("content"), F.lit("text/html").alias("content_type"), (-1 - F.col("page_id")).alias("place"))
    return docs.unionByName(pages)
