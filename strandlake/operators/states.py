"""Reads of named states: whole folds, and relational forms for chains that need none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import positioned, running_sum
from .algebra import WHOLE


def latest(ops: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """Last whole value of each chain (at a sequence, if one is given): a grouped maximum, combined before the shuffle."""
    found = ops.filter(F.col("op").isin(*WHOLE))
    if at is not None:
        found = found.filter(F.col("sequence") <= at)
    return found.groupBy(*keys).agg(F.max_by("value", "sequence").alias("value"), F.max("sequence").alias("sequence"))


def log_items(ops: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """(keys, pos, item, record sequence) of chains of Append and Edit alone: an append's position is its rank in the
    chain; of the edits of a position the last one counts. An edit that came before its position was there changes
    nothing."""
    if at is not None:
        ops = ops.filter(F.col("sequence") <= at)
    items = positioned(ops.filter(F.col("op") == "Append"), keys, "sequence", "_at").withColumn("pos", F.col("_at") - 1).select(*keys, "pos", F.col("value").alias("item"), "sequence")
    if "idx" not in ops.columns:
        return items
    edits = ops.filter(F.col("op") == "Edit").select(*keys, F.col("idx").alias("pos"), F.col("value").alias("_edited"), F.col("sequence").alias("_when"))
    late = F.col("_when") > F.col("sequence")
    joined = items.join(edits, [*keys, "pos"], "left")
    return joined.groupBy(*keys, "pos", "sequence").agg(F.coalesce(F.max_by(F.when(late, F.col("_edited")), F.when(late, F.col("_when"))), F.first("item")).alias("item")).select(*keys, "pos", "item", "sequence")


def lengths(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("length"))


def item_slice(items: DataFrame, offset: int, limit: int) -> DataFrame:
    return items.filter((F.col("pos") >= offset) & (F.col("pos") < offset + limit))


def item_tail(items: DataFrame, keys: list[str], n: int, sizes: DataFrame | None = None) -> DataFrame:
    """The last n items of each chain, by position: lengths are joined, so no chain is sorted in one group. sizes: keys
    and length, where they come cheaper than from the items."""
    return items.join(lengths(items, keys) if sizes is None else sizes, keys).filter(F.col("pos") >= F.col("length") - n).drop("length")


def search(items: DataFrame, text: str, field: str | None = None, limit: int | None = 100) -> DataFrame:
    """Items that hold the text, letters of any case, in their JSON or in one field's string form."""
    held = F.col("item") if field is None else F.get_json_object("item", f"$.{field}")
    found = items.filter(F.contains(F.lower(held), F.lower(F.lit(text)))).orderBy("pos")
    return found if limit is None else found.limit(limit)


def truncated(items: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The longest tail of each chain whose items' bytes fit, with where it begins and how long the chain is. Bytes are
    summed from the end by ranges of positions, then inside a range."""
    sized = running_sum(items.select(*keys, "pos", F.octet_length("item").alias("_size")), keys, "pos", "_size", "_bytes", backwards=True)
    return sized.groupBy(*keys).agg(
        F.count("*").alias("total_length"), F.count_if(F.col("_bytes") <= most).alias("n_kept"),
        F.coalesce(F.min(F.when(F.col("_bytes") <= most, F.col("pos"))), F.count("*")).alias("from_index")).withColumn("truncated", F.col("n_kept") < F.col("total_length"))


def chain_report(ops: DataFrame, keys: list[str]) -> DataFrame:
    return ops.groupBy(*keys).agg(F.count("*").alias("n_ops"), F.count_if(F.col("op") == "Append").alias("n_appends"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


def chain_stats(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Operations and bytes of each chain, and those before its newest full snapshot."""
    newest = ops.filter(F.col("op") == "Snapshot").groupBy(*keys).agg(F.max("sequence").alias("snapshot"))
    size = F.octet_length(F.coalesce("value", F.lit("")))
    old = F.col("sequence") < F.col("snapshot")
    return ops.join(newest, keys, "left").groupBy(*keys).agg(
        F.count("*").alias("total_ops"), F.sum(size).alias("total_bytes"), F.count_if(old).alias("ops_before"),
        F.coalesce(F.sum(F.when(old, size)), F.lit(0)).alias("bytes_before"), F.bool_or(F.col("snapshot").isNotNull()).alias("has_snapshot"))


def compaction_summary(stats: DataFrame) -> DataFrame:
    """Over all chains: what a compaction would save. A chain without a snapshot could lose all operations but one."""
    bare = ~F.col("has_snapshot")
    return stats.agg(
        F.count("*").alias("n_states"), F.sum("total_ops").alias("total_ops"),
        F.sum(F.when(bare, F.col("total_ops") - 1).otherwise(F.col("ops_before"))).alias("compactable_ops"),
        F.sum(F.when(bare, 0).otherwise(F.col("bytes_before"))).alias("compactable_bytes"), F.count_if(bare & (F.col("total_ops") > 1)).alias("n_needing"))


def delta_items(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Appends since each chain's last snapshot of either kind."""
    last = ops.filter(F.col("derived")).groupBy(*keys).agg(F.max("sequence").alias("_last"))
    return ops.join(last, keys, "left").filter((F.col("op") == "Append") & (F.col("sequence") > F.coalesce("_last", F.lit(0)))).select(*keys, "sequence", "value")


def snapshot_needed(strategy: str, d: int, f: int, ops: int, deltas: int = 0, items_at_full: int = 0, edited: bool = False) -> str | None:
    """The snapshot that a chain is due: 'full', 'delta' or None. Fulls are spaced by the state's size at the last one."""
    if strategy == "snapshot":
        return None
    if strategy == "struct":
        return "full" if ops >= 100 else None
    if strategy == "delta":
        return "full" if ops >= d else None
    spacing = max(min(d * f, (1 << 64) - 1), items_at_full)
    if deltas * d + ops >= spacing:
        return "full"
    if ops < d:
        return None
    return "full" if edited and strategy == "append_log" else "delta"


def registered(requests: DataFrame, order: str) -> DataFrame:
    """Requests (state_id, ...) with whether each registers its state: the first one does, the others find it there."""
    firsts = requests.groupBy("state_id").agg(F.min(order).alias(order)).withColumn("ok", F.lit(True))
    return requests.join(firsts, ["state_id", order], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def checked_ops(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Operations of append logs (without redactions) with whether each would be taken: an edit's index must lie below
    the chain's length at that time, that is, the append at that index comes before it."""
    places = positioned(ops.filter(F.col("op") == "Append"), keys, "sequence", "_at").select(*keys, (F.col("_at") - 1).alias("idx"), F.col("sequence").alias("_there"))
    edits = ops.filter(F.col("op") == "Edit").join(places, [*keys, "idx"], "left").withColumn("ok", F.coalesce(F.col("_there") < F.col("sequence"), F.lit(False)))
    return ops.filter(F.col("op") != "Edit").withColumn("ok", F.lit(True)).unionByName(edits.select(*ops.columns, "ok"))


def read_shapes(asked: DataFrame, slots: DataFrame, sizes: DataFrame) -> DataFrame:
    """What a read of each asked state_id finds: a value with its length, an empty one (registered, nothing written), or
    no state of that name."""
    known = slots.select("state_id").distinct().withColumn("_known", F.lit(True))
    joined = asked.join(known, "state_id", "left").join(sizes, "state_id", "left")
    shape = F.when(F.col("length").isNotNull(), "value").when(F.col("_known"), "empty").otherwise("unknown")
    return joined.select("state_id", shape.alias("shape"), F.coalesce("length", F.lit(0)).alias("length"))


def page_from_end(items: DataFrame, keys: list[str], sizes: DataFrame, page: int, size: int) -> DataFrame:
    """Page `page` (from 0) of each log, counted from its end; items in order. sizes: keys, length."""
    end = F.col("length") - page * size
    return items.join(sizes, keys).filter((F.col("pos") < end) & (F.col("pos") >= end - size)).drop("length")


def compacted(ops: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """A full snapshot for each chain after its last operation: what compacting all states writes. values: fold's rows."""
    last = ops.groupBy(*keys).agg((F.max("sequence") + 1).alias("sequence"))
    return values.join(last, keys).select(*keys, "sequence", F.lit("Snapshot").alias("op"), "value", F.lit(True).alias("derived"))


def compaction_stats(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Of each chain: its newest full and delta snapshots, deltas since the full one, and the figure that decides on the
    next full one: operations since the newest snapshot of either kind, and one for each such delta."""
    full, delta = F.col("op") == "Snapshot", F.col("op").isin("DeltaSnapshot", "TreeDeltaSnapshot")
    marks = ops.groupBy(*keys).agg(F.max(F.when(full, F.col("sequence"))).alias("last_full"), F.max(F.when(delta, F.col("sequence"))).alias("last_delta"))
    none = F.lit(0)
    since = lambda *c: F.greatest(*[F.coalesce(x, none) for x in c], none)
    after_full, after_both = F.col("sequence") > since("last_full"), F.col("sequence") > since("last_full", "last_delta")
    found = ops.join(marks, keys).groupBy(*keys).agg(
        F.max("last_full").alias("last_full"), F.max(F.when(F.col("last_delta") > since("last_full"), F.col("last_delta"))).alias("last_delta"),
        F.count_if(delta & after_full).alias("deltas_since_full"), F.count_if(~delta & ~full & after_both).alias("_ops"))
    return found.withColumn("ops_since_full", F.col("_ops") + F.col("deltas_since_full")).drop("_ops")


def poison_verdicts(ops: DataFrame, keys: list[str], read: DataFrame, replayed: DataFrame) -> DataFrame:
    """For each chain: clean, poisoned (what is read differs from a replay of the raw operations), healed (it would differ
    but for a later full snapshot) or open (an edit or redaction that no snapshot covers yet). read, replayed: values."""
    changes, delta, full = F.col("op").isin("Edit", "Redact"), F.col("op") == "DeltaSnapshot", F.col("op") == "Snapshot"
    at = lambda c: F.max(F.when(c, F.col("sequence")))
    marks = ops.groupBy(*keys).agg(at(changes).alias("_change"), at(delta).alias("_delta"), at(full).alias("_full"), F.min(F.when(changes, F.col("sequence"))).alias("_first"))
    both = read.withColumnRenamed("value", "_read").join(replayed.withColumnRenamed("value", "_raw"), keys, "full_outer").join(marks, keys)
    none = F.lit(0)
    covered = F.greatest(F.coalesce("_delta", none), F.coalesce("_full", none))
    verdict = F.when(~F.col("_read").eqNullSafe(F.col("_raw")), "poisoned").when((F.col("_full") > F.col("_delta")) & (F.col("_first") < F.col("_delta")), "healed").when(F.coalesce("_change", none) > covered, "open").otherwise("clean")
    return both.select(*keys, verdict.alias("verdict"))


def json_values(values: DataFrame, at: str, kind: str) -> DataFrame:
    """Whole values (column value) as JSON: `parsed` has what a path holds, `ok` tells whether the value is JSON at all."""
    v = F.try_parse_json("value")
    return values.select(*[c for c in values.columns if c != "value"], F.try_variant_get(v, at, kind).alias("parsed"), v.isNotNull().alias("ok"))
