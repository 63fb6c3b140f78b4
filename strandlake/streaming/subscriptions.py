"""Change feeds: filters, catch-up in batch, live events by Structured Streaming.

A feed has no gap and no repeat: the catch-up covers ids up to the last committed one, the stream those after it.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.algebra import WHOLE
from ..operators.records import elided_payload

PAYLOAD_BYTES = 4096
SNAPSHOT_BYTES = 10 << 20


@dataclass(frozen=True)
class Subscription:
    """The default filter matches nothing. An empty tuple of types or states means all of them."""

    from_sequence: int | None = None
    include_records: bool = False
    record_types: tuple[str, ...] = ()
    include_state_changes: bool = False
    state_ids: tuple[str, ...] = ()
    include_branch_events: bool = False
    branch: int | None = None
    buffer: int = 1000


def record_events(records: DataFrame, config: Subscription, most: int = PAYLOAD_BYTES) -> DataFrame:
    found = records if config.include_records else records.filter(F.lit(False))
    if config.record_types:
        found = found.filter(F.col("record_type").isin(*config.record_types))
    if config.branch is not None:
        found = found.filter(F.col("branch") == config.branch)
    if "kind" in found.columns:
        found = found.filter(F.col("kind") == "user")
    return found.select(F.lit("record").alias("type"), "id", "branch", "sequence", "record_type", F.length("payload").cast("bigint").alias("payload_size"), elided_payload(F.col("payload"), most).alias("payload"))


def state_events(ops: DataFrame, config: Subscription) -> DataFrame:
    found = ops if config.include_state_changes else ops.filter(F.lit(False))
    if config.state_ids:
        found = found.filter(F.col("state_id").isin(*config.state_ids))
    if config.branch is not None:
        found = found.filter(F.col("branch") == config.branch)
    return found.filter(~F.col("derived")).select(F.lit("state_delta").alias("type"), F.col("record_id").alias("id"), "branch", "sequence", "state_id", "op", "value")


def branch_events(branches: DataFrame, config: Subscription) -> DataFrame:
    """branch_created for each branch, with its parent's name, and branch_deleted for those deleted."""
    found = branches if config.include_branch_events else branches.filter(F.lit(False))
    if config.branch is not None:
        found = found.filter(F.col("id") == config.branch)
    parents = branches.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    made = found.join(parents, "parent", "left").select(F.lit("branch_created").alias("type"), F.col("id").alias("branch"), "name", "parent_name", F.col("created").alias("at"))
    gone = found.filter("deleted").select(F.lit("branch_deleted").alias("type"), F.col("id").alias("branch"), "name")
    return made.unionByName(gone, allowMissingColumns=True)


def state_snapshots(ops: DataFrame, config: Subscription, most: int = SNAPSHOT_BYTES) -> DataFrame:
    """The subscribed states (of whole values) as they were at `from_sequence`, or as they are where they came later. A
    value of more than `most` bytes is left out, and the row says so; logs go item by item: see states.truncated."""
    found = ops if config.include_state_changes and config.from_sequence is not None else ops.filter(F.lit(False))
    if config.state_ids:
        found = found.filter(F.col("state_id").isin(*config.state_ids))
    found = found.filter(F.col("op").isin(*WHOLE))
    then = F.col("sequence") <= F.lit(config.from_sequence)
    last = found.groupBy("state_id").agg(F.max_by(F.struct("value", "sequence"), F.when(then, F.col("sequence"))).alias("t"), F.max_by(F.struct("value", "sequence"), "sequence").alias("l"))
    shot = last.select(F.lit("state_snapshot").alias("type"), "state_id", F.coalesce("t", "l").alias("s")).select("type", "state_id", "s.*")
    large = F.octet_length("value") > most
    return shot.withColumn("truncated", large).withColumn("value", F.when(~large, F.col("value")))


def live(records: DataFrame, config: Subscription, ops: DataFrame | None = None, branches: DataFrame | None = None) -> DataFrame:
    """The events of new records, state operations (state_id, branch, sequence, record_id, op, value, derived) and
    branches that the subscription asks for."""
    found = record_events(records, config)
    for more in ([state_events(ops, config)] if ops is not None else []) + ([branch_events(branches, config)] if branches is not None else []):
        found = found.unionByName(more, allowMissingColumns=True)
    return found


def catch_up(records: DataFrame, config: Subscription, branch: int, ops: DataFrame | None = None) -> DataFrame:
    """What a subscriber gets first: with `from_sequence`, snapshots of the subscribed states (of `ops`: what the branch
    sees) and the branch's records from there on; then one row caught_up. Order by id, nulls last."""
    rows = record_events(records.filter(F.col("branch") == branch), config)
    rows = rows.filter(F.col("sequence") >= config.from_sequence) if config.from_sequence is not None else rows.filter(F.lit(False))
    if ops is not None:
        rows = rows.unionByName(state_snapshots(ops, config), allowMissingColumns=True)
    end = records.sparkSession.range(1).select(F.lit("caught_up").alias("type"))
    return rows.unionByName(end, allowMissingColumns=True)


def streamed(spark: SparkSession, sf_dir: str, config: Subscription) -> DataFrame:
    """The events table as a stream of files (each event a record, and a value that its type's state is set to) through
    the filter, run until all that is there now is processed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if not _is_file(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parque[t]")
    at = (F.col("event_id") + 1).alias
    records = rows.select(at("id"), F.lit(1).cast("bigint").alias("branch"), at("sequence"), F.col("event_type").alias("record_type"), F.col("props").cast("binary").alias("payload"))
    root = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="strandlake-")).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    ops = rows.select(at("record_id"), F.lit(1).cast("bigint").alias("branch"), at("sequence"), F.col("event_type").alias("state_id"), F.lit("Set").alias("op"), F.col("props").alias("value"), F.lit(False).alias("derived"))
    events = live(records, config, ops if config.include_state_changes else None)
    query = events.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/rows")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
