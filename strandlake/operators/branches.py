"""The branch table, lineage, and what each branch sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..errors import InvalidOperation
from ..shared import written

NO_CAP = (1 << 63) - 1

# Tables with a row for each branch look small on disk, by which Spark would broadcast them, but as hash tables they don't
# fit a small driver: their joins are hinted to sort and merge.

#: Rows of a table of jumps from which on it is not broadcast.
BROADCAST_ROWS = 100_000


def _jumps(branches: DataFrame) -> list[DataFrame]:
    """Tables (branch, ancestor, cap) of the state ancestors 1, 2, 4, ... steps away, as far as there are any; each is
    joined with itself into the next and written to the shared folder."""
    steps = branches.filter(F.col("state_parent").isNotNull() & F.col("inherits_state") & F.col("id").isNotNull())
    found, jump, most = [], steps.select(F.col("id").alias("branch"), F.col("state_parent").cast(branches.schema["id"].dataType).alias("ancestor"), F.col("branch_point").cast("bigint").alias("cap")), None
    while True:
        jump = written(jump, "jumps")
        n = jump.count()
        most = n if most is None else most
        if not n:
            return found
        if 1 << len(found) > most:
            # So many steps need more branches than there are.
            raise InvalidOperation("branches inherit their state in a circle")
        held = jump.select(F.col("branch").alias("_from"), F.col("ancestor").alias("_to"), F.col("cap").alias("_at"))
        found.append(held.hint("merge") if n > BROADCAST_ROWS else held)
        jump = jump.join(found[-1], F.col("ancestor") == F.col("_from")).select("branch", F.col("_to").alias("ancestor"), F.least("cap", "_at").alias("cap"))


def lineage(branches: DataFrame) -> DataFrame:
    """(branch, ancestor, cap, depth): a branch sees itself without a cap and each state ancestor up to the least
    branch point on the way. The parent at creation counts, so deleting or moving branches later changes nothing;
    a branch that inherits no state sees itself alone. Each depth is one sum of falling powers of two: from each branch,
    lines jump so far, or stay, with the longest jumps first. A circle is an error."""
    lines = branches.select(F.col("id").alias("branch"), F.col("id").alias("ancestor"), F.lit(NO_CAP).cast("bigint").alias("cap"), F.lit(0).alias("depth"))
    jumps = _jumps(branches)
    for k, jump in reversed(list(enumerate(jumps))):
        lists = jump.groupBy("_from").agg(F.collect_list(F.struct("_to", "_at")).alias("_jumps"))
        further = F.transform("_jumps", lambda j: F.struct(j["_to"].alias("ancestor"), F.least("cap", j["_at"]).alias("cap"), (F.col("depth") + (1 << k)).alias("depth")))
        stay = F.array(F.struct("ancestor", "cap", "depth"))
        joined = lines.join(lists, F.col("ancestor") == F.col("_from"), "left")
        lines = joined.select("branch", F.explode(F.when(F.col("_from").isNull(), stay).otherwise(F.concat(stay, further))).alias("l")).select("branch", "l.*")
    return lines


def lineage_of(branches: DataFrame, branch: int) -> DataFrame:
    """lineage's rows of one branch: few enough for a recursive query."""
    return branches.sparkSession.sql(f"""
        WITH RECURSIVE up(branch, ancestor, cap, depth) MAX RECURSION LEVEL 10000 AS (
          SELECT id, id, CAST({NO_CAP} AS BIGINT), 0 FROM {{table}} WHERE id = {int(branch)}
          UNION ALL
          SELECT u.branch, b.state_parent, least(u.cap, b.branch_point), u.depth + 1
          FROM up u JOIN {{table}} b ON u.ancestor = b.id WHERE b.state_parent IS NOT NULL AND b.inherits_state)
        SELECT * FROM up""", table=branches)


def visible(ops: DataFrame, lines: DataFrame, at: int | None = None) -> DataFrame:
    """Operations that each branch sees: columns of `ops`, whose branch becomes `source`, and `viewer`. An equi-join
    on the ancestor; the cap only filters."""
    cap = F.col("cap") if at is None else F.least(F.col("cap"), F.lit(at).cast("bigint"))
    seen = ops.withColumnRenamed("branch", "source").join(lines.select(F.col("branch").alias("viewer"), "ancestor", "cap").hint("merge"), F.col("source") == F.col("ancestor"))
    return seen.filter(F.col("sequence") <= cap).drop("ancestor", "cap")


def ancestry(branches: DataFrame) -> DataFrame:
    """(branch, ancestor, depth) from each live branch up to the root or to a deleted parent."""
    live = branches.filter(~F.col("deleted"))
    found = live.select("id", F.col("parent").alias("state_parent"), F.lit(NO_CAP).alias("branch_point"), F.lit(True).alias("inherits_state"))
    known = live.select(F.col("id").alias("ancestor")).hint("merge")
    return lineage(found).join(known, "ancestor", "left_semi").select("branch", "ancestor", "depth")


def children(branches: DataFrame) -> DataFrame:
    return branches.filter(~F.col("deleted") & F.col("parent").isNotNull()).select("parent", F.col("id").alias("child"))


def orphaned(branches: DataFrame) -> DataFrame:
    live = branches.filter(~F.col("deleted"))
    return live.filter(F.col("parent").isNotNull()).join(live.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "name")


def empty(branches: DataFrame) -> DataFrame:
    """Needs a column head."""
    return branches.filter(~F.col("deleted") & (F.col("id") != 1) & (F.col("head") == F.col("branch_point"))).select("id", "name")


def stale(branches: DataFrame, before) -> DataFrame:
    return branches.filter(~F.col("deleted") & (F.col("id") != 1) & (F.col("created") < before)).select("id", "name")


def can_delete(branches: DataFrame, current: int, force: bool = False) -> DataFrame:
    found = branches.filter(~F.col("deleted") & (F.col("id") != 1) & (F.col("id") != current))
    if not force:
        found = found.join(children(branches).select(F.col("parent").alias("id")), "id", "left_anti")
    return found.select("id", "name")


def gc_plan(branches: DataFrame, current: int, before=None, pattern: str | None = None, orphans: bool = True, empties: bool = True, force: bool = False) -> DataFrame:
    """Candidates (orphaned, empty, stale) whose name holds the pattern, each with whether it may go."""
    none = branches.filter(F.lit(False)).select("id", "name")
    parts = [orphaned(branches) if orphans else none, empty(branches) if empties else none, stale(branches, before) if before is not None else none]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    if pattern:
        found = found.filter(F.contains("name", F.lit(pattern)))
    allowed = can_delete(branches, current, force).select("id").withColumn("deleted", F.lit(True))
    return found.join(allowed, "id", "left").select("id", "name", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def reconcile_heads(branches: DataFrame, log_heads: DataFrame) -> DataFrame:
    """Heads from the log: the larger of the branch point and the branch's last sequence; branches that only the log
    knows are orphans."""
    joined = branches.select("id", "branch_point").join(log_heads, F.col("id") == F.col("branch"), "full_outer")
    return joined.select(F.coalesce("id", "branch").alias("id"), F.greatest(F.coalesce("branch_point", F.lit(0)), F.coalesce("max_sequence", F.lit(0))).alias("head"), F.col("id").isNull().alias("orphan"))


def listed(branches: DataFrame) -> DataFrame:
    """Live branches with their parent's name. Needs a column head."""
    names = branches.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return branches.filter(~F.col("deleted")).join(names, "parent", "left").select("id", "name", "head", "parent_name", "branch_point")


def fork(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """Forks asked for (name, parent, at; at null: the parent's head): their branch points, and whether they may be made,
    that is, the parent is there and reaches so far. heads: branches with a column head."""
    known = heads.filter(~F.col("deleted")).select(F.col("id").alias("parent"), "head").hint("merge")
    joined = requests.join(known, "parent", "left")
    point = F.coalesce("at", "head")
    return joined.select("name", "parent", point.alias("branch_point"), F.coalesce(point <= F.col("head"), F.lit(False)).alias("ok"))


def fork_lineage(lines: DataFrame, forks: DataFrame) -> DataFrame:
    """(branch, ancestor, cap) of new forks (branch, parent, branch_point, inherits_state): what the parent sees up to the
    branch point, and the fork's own operations."""
    seen = forks.filter("inherits_state").select(F.col("branch").alias("_new"), "parent", "branch_point").join(lines.withColumnRenamed("branch", "parent").hint("merge"), "parent")
    own = forks.select("branch", F.col("branch").alias("ancestor"), F.lit(NO_CAP).alias("cap"))
    return seen.select(F.col("_new").alias("branch"), "ancestor", F.least("cap", "branch_point").alias("cap")).unionByName(own)


def is_visible(heads: DataFrame, points: DataFrame) -> DataFrame:
    """Points (branch, sequence, ...) with whether the branch is live and reaches so far."""
    known = heads.filter(~F.col("deleted")).select(F.col("id").alias("branch"), F.col("head").alias("_head"))
    return points.join(known, "branch", "left").withColumn("visible", F.coalesce(F.col("sequence") <= F.col("_head"), F.lit(False))).drop("_head")


def reparented(branches: DataFrame, gone: DataFrame, to: int | None = None) -> DataFrame:
    """The table after the branches `gone` (id) are deleted and their live children hang on `to`. What a branch inherits
    (state_parent) stays as it was."""
    left = branches.join(gone.select("id", F.lit(True).alias("_gone")), "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    moved = gone.select(F.col("id").alias("parent"), F.lit(True).alias("_moved"))
    joined = left.join(moved, "parent", "left")
    away = F.coalesce("_moved", F.lit(False)) & ~F.col("deleted")
    return joined.withColumn("parent", F.when(away, F.lit(to).cast("bigint")).otherwise(F.col("parent"))).select(*branches.columns)


#: Sequences of a branch to a range, as a power of two: what one window over a range can hold.
RANGE_BITS = 14


def visible_latest(ops: DataFrame, lines: DataFrame, at: int | None = None) -> DataFrame:
    """(viewer, state_id, n_ops, value): of each state that a branch sees, the operations and the last value. Operations
    don't go to each branch that sees them: the lines' caps lie among them in the order of sequence, and each finds how
    many operations come before it and the last one: inside its range of the sequence first, then over the ranges before."""
    if at is not None:
        ops = ops.filter(F.col("sequence") <= at)
        lines = lines.withColumn("cap", F.least("cap", F.lit(at).cast("bigint")))
    key = ["source", "state_id"]
    own = ops.select(F.col("branch").alias("source"), "state_id", "sequence", F.struct("value", "sequence").alias("o"))
    # Caps before a state's first operation see none of it.
    begins = own.groupBy(*key).agg(F.min("sequence").alias("_first"))
    caps = lines.select(F.col("branch").alias("viewer"), F.col("ancestor").alias("source"), F.col("cap").alias("sequence")).join(begins.hint("merge"), "source").filter(F.col("sequence") >= F.col("_first")).drop("_first")
    rows = own.unionByName(caps, allowMissingColumns=True).withColumn("r", F.shiftright("sequence", RANGE_BITS))
    # A cap comes after the operation of its sequence.
    inside = Window.partitionBy(*key, "r").orderBy("sequence", F.col("viewer").asc_nulls_first())
    local = rows.select(
        "viewer", *key, "r", "sequence", F.count("o").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("k"),
        F.last("o", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("last"), F.lead(F.lit(1)).over(inside).isNull().alias("ends"))
    before = Window.partitionBy(*key).orderBy("r", "sequence", F.col("viewer").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    few = local.filter(F.col("viewer").isNotNull() | F.col("ends"))
    n = F.col("k") + F.coalesce(F.sum(F.when(F.col("ends"), F.col("k"))).over(before), F.lit(0))
    last = F.coalesce("last", F.last(F.when(F.col("ends"), F.col("last")), ignorenulls=True).over(before))
    seen = few.select("viewer", "state_id", n.alias("n"), last.alias("last")).filter(F.col("viewer").isNotNull() & (F.col("n") > 0))
    return seen.groupBy("viewer", "state_id").agg(F.sum("n").alias("n_ops"), F.max_by("last.value", "last.sequence").alias("value"))
