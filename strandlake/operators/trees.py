"""Path trees: the last operation on each path counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidOperation


def valid_path(path: Column | str) -> Column:
    """Not empty, no leading slash, no NUL, and no component that is one dot or two."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    return (F.length(path) > 0) & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\0")) & ~F.arrays_overlap(parts, F.array(F.lit("."), F.lit("..")))


def check_path(path: str) -> None:
    if not path or path.startswith("/") or "\0" in path or {".", ".."} & set(path.split("/")):
        raise InvalidOperation(f"invalid tree path: {path!r}")


def steps(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sequence, place, op, path, entry): single operations, and those of batches in their order."""
    one = ops.filter(F.col("op").isin("TreeSet", "TreeRemove")).select(*keys, "sequence", F.lit(0).alias("place"), F.when(F.col("op") == "TreeSet", "set").otherwise("remove").alias("op"), "path", "entry")
    if "ops" not in ops.columns:
        return one
    many = ops.filter(F.col("op").isin("TreeBatch", "TreeDeltaSnapshot")).select(*keys, "sequence", F.posexplode("ops").alias("place", "o")).select(*keys, "sequence", "place", "o.op", "o.path", "o.entry")
    return one.unionByName(many)


def last_ops(ops: DataFrame, keys: list[str], at: int | None = None, since: int | None = None) -> DataFrame:
    """The last operation on each path of each chain."""
    found = steps(ops, keys)
    if at is not None:
        found = found.filter(F.col("sequence") <= at)
    if since is not None:
        found = found.filter(F.col("sequence") > since)
    return found.groupBy(*keys, "path").agg(F.max_by(F.struct("op", "entry"), F.struct("sequence", "place")).alias("o")).select(*keys, "path", "o.op", "o.entry")


def tree(ops: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """(keys, path, entry)."""
    return last_ops(ops, keys, at).filter(F.col("op") == "set").drop("op")


def listed(entries: DataFrame, prefix: str = "") -> DataFrame:
    return entries.filter(F.startswith("path", F.lit(prefix))).orderBy("path")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, change, old, new) of paths that differ between two trees."""
    by = [*keys, "path"]
    joined = old.withColumnRenamed("entry", "old").join(new.withColumnRenamed("entry", "new"), by, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select(*by, change.alias("change"), "old", "new")


def valid_ops(ops: DataFrame) -> DataFrame:
    """Tree operations with whether each would be taken: all paths that it names must be valid, a set needs its entry; one
    bad path leaves a whole batch out."""
    single = valid_path("path") & ((F.col("op") != "TreeSet") | F.col("entry").isNotNull())
    batch = F.forall("ops", lambda o: valid_path(o["path"]) & ((o["op"] != "set") | o["entry"].isNotNull()))
    return ops.withColumn("ok", F.coalesce(F.when(F.col("op").isin("TreeSet", "TreeRemove"), single).otherwise(batch), F.lit(False)))


def snapshots(ops: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """A row that sets each path of each tree as it is (at a sequence): with later operations after it, it stands for all
    before."""
    sequence = ops.filter(F.lit(True) if at is None else F.col("sequence") <= at).groupBy(*keys).agg(F.max("sequence").alias("sequence"))
    held = tree(ops, keys, at)
    rows = held.join(sequence, keys) if keys else held.join(F.broadcast(sequence), F.lit(True))
    return rows.select(*keys, "sequence", F.lit("TreeSet").alias("op"), "path", "entry")


def shaped_diff(changes: DataFrame) -> DataFrame:
    """diff's rows as they go over the wire: the change's name and both entries as JSON, absent ones null."""
    return changes.select(*[c for c in changes.columns if c not in ("change", "old", "new")], F.col("change").alias("change_type"), F.to_json("old").alias("old_entry"), F.to_json("new").alias("new_entry"))
