"""Registered queries of writes, forks, compaction and feeds, and their SQL counterparts; see catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra, blobs, branches as br, records as rec, states, trees
from ..sources import log_format
from ..streaming import subscriptions as subs
from . import model as m
from .catalog import BLOBS, BOPS, BR, HEADS, LINES, R, TREE, query, tree_at

# Records


@query("w1_append", """WITH old AS (SELECT 1 + user_id % 3 AS branch, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1),
x AS (SELECT event_id, 1 + user_id % 3 AS branch, row_number() OVER (ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS j FROM events WHERE user_id % 2 = 1)
SELECT event_id, x.branch, i + (SELECT count(*) FROM events WHERE user_id % 2 = 0) AS id, j + coalesce(n, 0) AS sequence FROM x LEFT JOIN old USING (branch)""")
def _(spark, d):
    rows = m.events(spark, d).select("event_id", (1 + F.col("user_id") % 3).alias("branch"), (F.col("user_id") % 2).alias("new"))
    old = rows.filter("new = 0")
    heads = old.groupBy("branch").agg(F.count("*").alias("max_sequence"))
    return rec.assigned(rows.filter("new = 1").drop("new"), "event_id", heads, old.count() + 1)


@query("w2_encodings", f"WITH {R} SELECT id, CASE WHEN id % 4 = 0 THEN 'raw' ELSE 'json' END AS encoding FROM r")
def _(spark, d):
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("<").cast("binary"), F.col("payload"))).otherwise(F.col("payload"))
    return m.records(spark, d).select("id", rec.encoding_of(raw).alias("encoding"))


@query("w5_identity", f"WITH {R} SELECT id, CASE WHEN id % 4 > 0 THEN CAST(id AS VARCHAR) END AS held_id, CASE WHEN id % 4 > 0 THEN sequence END AS held_sequence, CASE WHEN id % 4 > 0 THEN json_extract_string(props, '$.k') END AS k, id % 4 > 0 AS ok FROM r")
def _(spark, d):
    text = F.col("payload").cast("string")
    item = F.when(F.col("id") % 4 == 0, F.concat(F.lit("["), text, F.lit("]"))).when(F.col("id") % 4 == 1, F.concat(F.substring(text, 1, 1), F.lit('"id": 5, "sequence": "old", '), F.expr("substring(CAST(payload AS STRING), 2)"))).otherwise(text)
    held = m.records(spark, d).select("id", rec.with_identity(item, F.col("id"), F.col("sequence")).alias("v"))
    at = lambda name: F.get_json_object("v", f"$.{name}")
    return held.select("id", at("id").alias("held_id"), at("sequence").cast("bigint").alias("held_sequence"), at("k").alias("k"), F.col("v").isNotNull().alias("ok"))


@query("r18_op_payloads", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'Set' ELSE 'Append' END AS op, props || chr(233) AS value FROM events UNION ALL SELECT -1 - event_id, NULL, NULL FROM events WHERE event_type = 'view'")
def _(spark, d):
    value = F.concat("props", F.lit("é"))
    payload = F.when(F.col("event_type") == "click", rec.op_payload("Set", value)).otherwise(rec.op_payload("Append", value))
    rows = m.events(spark, d)
    both = rows.select("event_id", payload.alias("p")).unionByName(rows.filter("event_type = 'view'").select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("x"), "props").alias("p")))
    return both.select("event_id", rec.decoded_op(F.col("p")).alias("o")).select("event_id", "o.op", "o.value")


@query("s1_log_scan", "SELECT event_id + 1 AS id, event_id + 1 AS sequence, 1 + user_id % 5 AS branch, event_type AS record_type, props AS payload, len(CASE WHEN event_id % 3 = 0 THEN [1, 2] ELSE [] END) AS n_causes, true AS ok FROM events")
def _(spark, d):
    found = log_format.parsed_logs(m.logs(spark, d))
    return found.select("id", "sequence", "branch", "record_type", F.col("payload").cast("string").alias("payload"), F.size("caused_by").cast("bigint").alias("n_causes"), "ok")


LOGS = "l AS (SELECT user_id % 40 AS log, event_id, 53 + strlen(event_type) + strlen(props) + CASE WHEN event_id % 3 = 0 THEN 16 ELSE 0 END AS size, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id % 40) AS n FROM events)"


@query("s3_torn_tails", f"WITH {LOGS} SELECT log, count(*) FILTER (log % 2 = 0 OR i < n) AS valid_records, CASE WHEN log % 2 = 1 THEN CAST(sum(size) FILTER (i < n) AS BIGINT) END AS truncated_at, CASE WHEN log % 2 = 1 THEN CAST(sum(size) FILTER (i = n) - 3 AS BIGINT) ELSE 0 END AS dropped_bytes, false AS corrupt FROM l GROUP BY log HAVING count(*) > 1")
def _(spark, d):
    """Every other log has lost its last three bytes."""
    content = F.when(F.col("log") % 2 == 1, F.expr("substring(content, 1, length(content) - 3)")).otherwise(F.col("content"))
    found = rec.torn_tail(log_format.parsed_logs(m.logs(spark, d, 2).withColumn("content", content)))
    return found.select(F.col("path").cast("bigint").alias("log"), "valid_records", "truncated_at", "dropped_bytes", "corrupt")


@query("s4_corrupt_logs", f"WITH {LOGS} SELECT log, 1 AS valid_records, CAST(sum(size) FILTER (i = 1) AS BIGINT) AS truncated_at, true AS corrupt FROM l GROUP BY log HAVING count(*) > 2")
def _(spark, d):
    """The second record's payload is another than its checksum says, and good records follow."""
    found = rec.torn_tail(log_format.parsed_logs(m.logs(spark, d, 3, damaged=2)))
    return found.select(F.col("path").cast("bigint").alias("log"), "valid_records", "truncated_at", "corrupt")


# States


@query("a3_deltas", "SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN '[' || props || ']' ELSE props END, event_id) AS value FROM events GROUP BY user_id")
def _(spark, d):
    ops = m.slot_ops(spark, d).join(m.events(spark, d).select((F.col("event_id") + 1).alias("sequence"), "event_type"), "sequence")
    bought = F.col("event_type") == "purchase"
    return states.latest(ops.withColumn("op", F.when(bought, "Delta").otherwise("Set")).withColumn("value", F.when(bought, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))), ["user_id"]).drop("sequence")


@query("a7_delta_snapshots", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n, k) - 1 AS pos, CAST(n + k AS VARCHAR) AS item FROM (SELECT user_id, event_id + 1 AS n, unnest(CASE WHEN event_type = 'purchase' THEN [0, 1, 2] ELSE [0] END) AS k FROM events)")
def _(spark, d):
    n = F.col("event_id") + 1
    bought = F.col("event_type") == "purchase"
    value = F.when(bought, F.to_json(F.array(n, n + 1, n + 2))).otherwise(n.cast("string"))
    ops = m.events(spark, d).select("user_id", n.alias("sequence"), F.when(bought, "DeltaSnapshot").otherwise("Append").alias("op"), value.alias("value"))
    return algebra.fold_items(ops, ["user_id"])


@query("a11_tree_delta_snapshots", f"WITH {TREE}, {tree_at('x', '1000000000')} SELECT path, blob_hash, size FROM x")
def _(spark, d):
    ops = m.tree_ops(spark, d)
    return trees.tree(ops.withColumn("op", F.when(F.col("op") == "TreeBatch", "TreeDeltaSnapshot").otherwise(F.col("op"))), []).select("path", "entry.blob_hash", "entry.size")


@query("t1_registrations", "SELECT event_id, event_type || user_id AS state_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 AS ok FROM events")
def _(spark, d):
    return states.registered(m.events(spark, d).select(F.concat("event_type", F.col("user_id").cast("string")).alias("state_id"), "event_id"), "event_id")


@query("t2_checked_ops", "SELECT user_id, event_id + 1 AS sequence, CASE WHEN event_type = 'purchase' THEN (event_id + 1) % 5 < n ELSE true END AS ok FROM (SELECT *, count(*) FILTER (event_type <> 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'error')")
def _(spark, d):
    return states.checked_ops(m.edited_ops(spark, d).filter("op <> 'Redact'"), ["user_id"]).select("user_id", "sequence", "ok")


@query("t15_read_shapes", "SELECT CAST(c_custkey AS VARCHAR) AS state_id, CASE WHEN n IS NOT NULL THEN 'value' WHEN c_custkey % 3 < 2 THEN 'empty' ELSE 'unknown' END AS shape, coalesce(n, 0) AS length FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE user_id % 3 < 2 GROUP BY 1) ON user_id = c_custkey")
def _(spark, d):
    asked = m.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("state_id"))
    slots = asked.filter("CAST(state_id AS BIGINT) % 3 < 2")
    sizes = m.events(spark, d).filter("user_id % 3 < 2").groupBy(F.col("user_id").cast("string").alias("state_id")).agg(F.count("*").alias("length"))
    return states.read_shapes(asked, slots, sizes)


@query("t16_page_from_end", "SELECT conv_id, turn AS pos, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn < n - 2 AND turn >= n - 4")
def _(spark, d):
    ops = m.conversation_ops(spark, d)
    sizes = ops.groupBy("conv_id").agg(F.count("*").alias("length"))
    return states.page_from_end(states.log_items(ops, ["conv_id"]), ["conv_id"], sizes, 1, 2).select("conv_id", "pos", F.get_json_object("item", "$.text").alias("text"))


# Branches

FORKS = HEADS + ", f AS (SELECT 100000000 + id AS branch, id AS parent, id * 53 % 6000 AS branch_point, id % 4 > 0 AS inherits_state FROM h WHERE NOT deleted AND id * 53 % 6000 <= head)"
FORK_LINES = FORKS.replace("WITH ", "") + """, up AS (SELECT id AS branch, id AS ancestor, 9223372036854775807 AS cap FROM b
  UNION ALL SELECT u.branch, b.parent, least(u.cap, b.branch_point) FROM up u JOIN b ON u.ancestor = b.id WHERE b.parent IS NOT NULL AND b.inherits_state),
  fl AS (SELECT f.branch, ancestor, least(cap, branch_point) AS cap FROM f JOIN up ON up.branch = f.parent WHERE f.inherits_state)"""


def _requests(spark, d):
    return m.branches(spark, d).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").alias("parent"), F.when(F.col("id") % 5 > 0, F.col("id") * 53 % 6000).alias("at"))


@query("b1_forks", f"WITH {HEADS} SELECT 'f' || id AS name, id AS parent, CASE WHEN id % 5 > 0 THEN id * 53 % 6000 WHEN NOT deleted THEN head END AS branch_point, NOT deleted AND (id % 5 = 0 OR id * 53 % 6000 <= head) AS ok FROM h")
def _(spark, d):
    return br.fork(m.branch_heads(spark, d), _requests(spark, d))


def _fork_lines(spark, d):
    made = br.fork(m.branch_heads(spark, d), _requests(spark, d).withColumn("at", F.col("parent") * 53 % 6000)).filter("ok")
    forks = made.select((F.col("parent") + 100000000).alias("branch"), "parent", "branch_point", (F.col("parent") % 4 > 0).alias("inherits_state"))
    return br.fork_lineage(br.lineage(m.branches(spark, d)), forks)


@query("b2_fork_states", f"WITH RECURSIVE {FORK_LINES} SELECT fl.branch AS viewer, state_id, count(*) AS n_ops, arg_max(value, sequence) AS value FROM fl JOIN o ON o.branch = fl.ancestor AND o.sequence <= fl.cap GROUP BY ALL")
def _(spark, d):
    return br.visible_latest(m.branch_ops(spark, d), _fork_lines(spark, d))


@query("b3_empty_forks", f"WITH {FORKS} SELECT branch, CASE WHEN inherits_state THEN NULL ELSE 0 END AS n_inherited FROM f WHERE NOT inherits_state")
def _(spark, d):
    lines = _fork_lines(spark, d)
    seen = lines.groupBy("branch").agg((F.count("*") - 1).alias("n_inherited"))
    return seen.filter("(branch - 100000000) % 4 = 0").select("branch", F.col("n_inherited").cast("int").alias("n_inherited"))


@query("b5_list", f"WITH {HEADS} SELECT x.id, x.name, x.head, p.name AS parent_name, x.branch_point FROM h x LEFT JOIN h p ON p.id = x.parent WHERE NOT x.deleted")
def _(spark, d):
    return br.listed(m.branch_heads(spark, d))


@query("b7_reparent", f"WITH {BR}, gone AS (SELECT id FROM b WHERE NOT deleted AND id % 10 = 4) SELECT id, name, CASE WHEN parent IN (SELECT id FROM gone) AND NOT deleted AND id NOT IN (SELECT id FROM gone) THEN 1 ELSE parent END AS parent, deleted OR id IN (SELECT id FROM gone) AS deleted, parent AS state_parent FROM b")
def _(spark, d):
    rows = m.branches(spark, d)
    gone = rows.filter("NOT deleted AND id % 10 = 4").select("id")
    return br.reparented(rows, gone, 1).select("id", "name", "parent", "deleted", "state_parent")


@query("b9_is_visible", f"WITH {HEADS} SELECT event_id, coalesce((SELECT event_id + 1 <= head FROM h WHERE h.id = 1 + event_id % 300 AND NOT deleted), false) AS visible FROM events")
def _(spark, d):
    points = m.events(spark, d).select("event_id", (1 + F.col("event_id") % 300).alias("branch"), (F.col("event_id") + 1).alias("sequence"))
    return br.is_visible(m.branch_heads(spark, d), points).select("event_id", "visible")


@query("b18_own_and_inherited", f"WITH RECURSIVE {LINES} SELECT u.branch AS viewer, count(*) AS n_ops, count(*) FILTER (u.depth = 0) AS n_own FROM up u JOIN o ON o.branch = u.ancestor AND o.sequence <= u.cap GROUP BY 1")
def _(spark, d):
    ops, lines = m.branch_ops(spark, d), br.lineage(m.branches(spark, d))
    seen = br.visible_latest(ops, lines).groupBy("viewer").agg(F.sum("n_ops").alias("n_ops"))
    own = ops.groupBy(F.col("branch").alias("viewer")).agg(F.count("*").alias("n"))
    return seen.join(own, "viewer", "left").select("viewer", "n_ops", F.coalesce("n", F.lit(0)).alias("n_own"))


# Trees


@query("g4_valid_batches", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id % 5 > 0 WHEN page_id % 3 = 1 THEN page_id % 5 > 0 AND page_id % 7 > 0 ELSE page_id % 2 = 0 END AS ok FROM pages")
def _(spark, d):
    """Sets, batches whose second path may be bad, and sets that may lack an entry."""
    path = F.regexp_replace("url", "^https?://", "")
    one = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), path)).otherwise(path)
    two = F.when(F.col("page_id") % 7 == 0, F.lit("a/./b")).otherwise(F.lit("a/b"))
    entry = F.struct(F.sha2("html", 256).alias("blob_hash"), F.length("html").cast("bigint").alias("size"), F.lit(420).alias("mode"))
    none = F.lit(None).cast("struct<blob_hash: string, size: bigint, mode: int>")
    kind = F.col("page_id") % 3
    step = lambda op, p, e: F.struct(F.lit(op).alias("op"), p.alias("path"), e.alias("entry"))
    rows = m.table(spark, d, "pages").select(
        "page_id", F.when(kind == 1, "TreeBatch").otherwise("TreeSet").alias("op"), F.when(kind == 0, one).when(kind == 2, two.substr(1, 1)).alias("path"),
        F.when((kind == 0) | (F.col("page_id") % 2 == 0), entry).otherwise(none).alias("entry"), F.when(kind == 1, F.array(step("set", one, entry), step("remove", two, none))).alias("ops"))
    return trees.valid_ops(rows).select("page_id", "ok")


@query("g8_tree_snapshots", f"WITH {TREE}, {tree_at('x', '1000000000')} SELECT path, blob_hash, size FROM x")
def _(spark, d):
    """The tree from a snapshot at half of the log and the operations after it."""
    ops = m.tree_ops(spark, d)
    half = ops.agg(F.floor(F.max("sequence") / 2)).first()[0]
    late = ops.filter(F.col("sequence") > half)
    return trees.tree(trees.snapshots(ops, [], half).unionByName(late.drop("state_id"), allowMissingColumns=True), []).select("path", "entry.blob_hash", "entry.size")


HALVES = "(SELECT max(event_id + 1) // 2 FROM events)", "(SELECT max(event_id + 1) * 9 // 10 FROM events)"


@query("g9_diff_shapes", f"WITH {TREE}, {tree_at('x', HALVES[0])}, {tree_at('y', HALVES[1])} SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'removed' ELSE 'modified' END AS change_type, '{{\"blob_hash\":\"' || x.blob_hash || '\",\"size\":' || x.size || ',\"mode\":420}}' AS old_entry, '{{\"blob_hash\":\"' || y.blob_hash || '\",\"size\":' || y.size || ',\"mode\":420}}' AS new_entry FROM x FULL JOIN y ON x.path = y.path WHERE x.blob_hash IS DISTINCT FROM y.blob_hash OR x.size IS DISTINCT FROM y.size")
def _(spark, d):
    """Trees at a half and at nine tenths of the log."""
    ops = m.tree_ops(spark, d)
    last = ops.agg(F.max("sequence")).first()[0] or 0
    return trees.shaped_diff(trees.diff(trees.tree(ops, [], last // 2), trees.tree(ops, [], last * 9 // 10), []))


# Compaction


@query("c7_compact_all", "SELECT user_id, arg_max(props, event_id) AS value, max(event_id) + 2 AS sequence FROM events GROUP BY user_id")
def _(spark, d):
    """Snapshots of all states; the fold over operations and snapshots is the value that it was."""
    ops = m.slot_ops(spark, d)
    shots = states.compacted(ops, ["user_id"], states.latest(ops, ["user_id"]).drop("sequence"))
    return states.latest(ops.unionByName(shots.drop("derived")), ["user_id"])


KINDS = "k AS (SELECT user_id, event_id + 1 AS sequence, CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'Snapshot' WHEN event_type = 'purchase' THEN 'DeltaSnapshot' WHEN event_type = 'error' THEN 'Edit' ELSE 'Append' END AS op FROM events)"


def _kinds(spark, d):
    kind = F.col("event_type")
    op = F.when((kind == "signup") & (F.col("event_id") % 4 == 0), "Snapshot").when(kind == "purchase", "DeltaSnapshot").when(kind == "error", "Edit").otherwise("Append")
    return m.events(spark, d).select("user_id", (F.col("event_id") + 1).alias("sequence"), op.alias("op"))


@query("c8_compaction_stats", f"WITH {KINDS}, f AS (SELECT *, coalesce(max(sequence) FILTER (op = 'Snapshot') OVER (PARTITION BY user_id), 0) AS full_at, coalesce(max(sequence) FILTER (op = 'DeltaSnapshot') OVER (PARTITION BY user_id), 0) AS delta_at FROM k) SELECT user_id, CASE WHEN any_value(full_at) > 0 THEN any_value(full_at) END AS last_full, CASE WHEN any_value(delta_at) > any_value(full_at) THEN any_value(delta_at) END AS last_delta, count(*) FILTER (op = 'DeltaSnapshot' AND sequence > full_at) AS deltas_since_full, count(*) FILTER (op IN ('Append', 'Edit') AND sequence > greatest(full_at, delta_at)) + count(*) FILTER (op = 'DeltaSnapshot' AND sequence > full_at) AS ops_since_full FROM f GROUP BY user_id")
def _(spark, d):
    return states.compaction_stats(_kinds(spark, d), ["user_id"])


@query("c11_poison_verdicts", f"WITH {KINDS}, g AS (SELECT user_id, coalesce(max(sequence) FILTER (op = 'Edit'), 0) AS change_at, min(sequence) FILTER (op = 'Edit') AS first_at, max(sequence) FILTER (op = 'DeltaSnapshot') AS delta_at, max(sequence) FILTER (op = 'Snapshot') AS full_at, count(*) FILTER (op = 'Append') AS n FROM k GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 6 = 0 AND n > 0 THEN 'poisoned' WHEN full_at > delta_at AND first_at < delta_at THEN 'healed' WHEN change_at > greatest(coalesce(delta_at, 0), coalesce(full_at, 0)) THEN 'open' ELSE 'clean' END AS verdict FROM g")
def _(spark, d):
    """What is read of every sixth state is one item more than a replay gives."""
    ops = _kinds(spark, d)
    count = ops.groupBy("user_id").agg(F.count_if(F.col("op") == "Append").alias("n"))
    value = lambda more: count.select("user_id", F.when(F.col("n") + more > 0, (F.col("n") + more).cast("string")).alias("value"))
    return states.poison_verdicts(ops, ["user_id"], value(F.when((F.col("user_id") % 6 == 0) & (F.col("n") > 0), 1).otherwise(0)), value(F.lit(0)))


# Blobs


@query("o4_delete", f"WITH {BLOBS} SELECT hash, 'stays' AS state FROM bl WHERE hash NOT IN (SELECT sha256(html) FROM pages) UNION ALL SELECT DISTINCT sha256(html), 'deleted' FROM pages UNION ALL SELECT DISTINCT sha256('no blob ' || c_custkey), 'not there' FROM customer")
def _(spark, d):
    held = blobs.stored(m.blob_rows(spark, d), "place")
    wanted = m.table(spark, d, "pages").select(F.sha2("html", 256).alias("hash")).unionByName(m.table(spark, d, "customer").select(F.sha2(F.concat(F.lit("no blob "), F.col("c_custkey").cast("string")), 256).alias("hash")))
    left, gone = blobs.deleted(held, wanted)
    return blobs.listed(left).withColumn("state", F.lit("stays")).unionByName(gone.select("hash", F.when(F.col("was_there"), "deleted").otherwise("not there").alias("state")))


@query("o8_get_blobs", "SELECT DISTINCT sha256(html) AS hash, html AS content, 'text/html' AS content_type FROM pages UNION ALL SELECT DISTINCT sha256('no blob ' || c_custkey), NULL, NULL FROM customer")
def _(spark, d):
    rows = m.blob_rows(spark, d)
    wanted = rows.filter("place < 0").select(F.sha2("content", 256).alias("hash")).distinct().unionByName(m.table(spark, d, "customer").select(F.sha2(F.concat(F.lit("no blob "), F.col("c_custkey").cast("string")), 256).alias("hash")).distinct())
    return blobs.get(blobs.stored(rows.filter("place < 0"), "place"), wanted).select("hash", F.col("content").cast("string").alias("content"), "content_type")


# Feeds


@query("e2_filters", f"WITH {BOPS} SELECT 'state_delta' AS type, sequence AS id, branch, state_id FROM o WHERE state_id IN ('click', 'view') AND branch = 5 UNION ALL SELECT 'record', event_id + 1, 5, event_type FROM events WHERE event_type = 'error' AND user_id = 4 UNION ALL SELECT CASE WHEN deleted THEN 'branch_deleted' ELSE 'branch_created' END, NULL, id, NULL FROM b WHERE id = 5")
def _(spark, d):
    config = subs.Subscription(include_records=True, record_types=("error",), include_state_changes=True, state_ids=("click", "view"), include_branch_events=True, branch=5)
    records = m.records(spark, d).withColumn("branch", 1 + F.col("user_id"))
    found = subs.live(records, config, m.feed_ops(spark, d), m.branches(spark, d))
    return found.select("type", "id", "branch", F.coalesce("state_id", "record_type").alias("state_id"))


@query("e3_state_snapshots", "WITH n AS (SELECT max(event_id + 1) // 2 AS half FROM events), s AS (SELECT user_id, arg_max(props, event_id) FILTER (event_id + 1 <= (SELECT half FROM n)) AS then_value, arg_max(props, event_id) AS value, max(event_id + 1) FILTER (event_id + 1 <= (SELECT half FROM n)) AS then_at, max(event_id + 1) AS last_at FROM events GROUP BY user_id) SELECT 'state_snapshot' AS type, CAST(user_id AS VARCHAR) AS state_id, coalesce(then_value, value) AS value, coalesce(then_at, last_at) AS sequence FROM s UNION ALL SELECT 'record', NULL, NULL, event_id + 1 FROM events WHERE event_id + 1 >= (SELECT half FROM n) AND event_type = 'click' UNION ALL SELECT 'caught_up', NULL, NULL, NULL")
def _(spark, d):
    """From half of the log on: the states as they were there, then records."""
    records = m.records(spark, d)
    half = (records.agg(F.max("sequence")).first()[0] or 0) // 2
    ops = m.slot_ops(spark, d).select(F.col("user_id").cast("string").alias("state_id"), F.lit(1).cast("bigint").alias("branch"), "sequence", F.col("sequence").alias("record_id"), "op", "value", F.lit(False).alias("derived"))
    config = subs.Subscription(from_sequence=half, include_records=True, record_types=("click",), include_state_changes=True)
    return subs.catch_up(records, config, 1, ops).select("type", "state_id", "value", "sequence")


@query("e5_state_deltas", f"WITH {BOPS} SELECT 'state_delta' AS type, sequence AS id, branch, state_id, value FROM o WHERE state_id = 'purchase'")
def _(spark, d):
    config = subs.Subscription(include_state_changes=True, state_ids=("purchase",))
    return subs.live(m.records(spark, d), config, m.feed_ops(spark, d)).select("type", "id", "branch", "state_id", "value")


@query("e10_branch_events", f"WITH {BR} SELECT 'branch_created' AS type, id AS branch, name, (SELECT name FROM b p WHERE p.id = b.parent) AS parent_name FROM b UNION ALL SELECT 'branch_deleted', id, name, NULL FROM b WHERE deleted")
def _(spark, d):
    return subs.branch_events(m.branches(spark, d), subs.Subscription(include_branch_events=True)).select("type", "branch", "name", "parent_name")


# Points that move with the table: half of the log


def _half(spark, d) -> int:
    return (m.events(spark, d).agg(F.max("event_id")).first()[0] or 0) // 2


HALF = "(SELECT max(event_id) // 2 FROM events)"


@query("t5_as_of_half", f"SELECT user_id, arg_max(props, event_id) AS value, max(event_id) + 1 AS sequence FROM events WHERE event_id + 1 <= {HALF} GROUP BY user_id")
def _(spark, d):
    return states.latest(m.slot_ops(spark, d), ["user_id"], _half(spark, d))


@query("t5_items_as_of_half", f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(event_id + 1 AS VARCHAR) AS item FROM events WHERE event_type NOT IN ('purchase', 'error') AND event_id + 1 <= {HALF}")
def _(spark, d):
    return states.log_items(m.edited_ops(spark, d).filter("op = 'Append'").drop("idx", "idx_end"), ["user_id"], _half(spark, d)).select("user_id", "pos", "item")


@query("t17_chain_info_at_half", f"SELECT user_id, count(*) AS n_ops, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS n_appends, min(event_id) + 1 AS first_sequence, max(event_id) + 1 AS last_sequence FROM events WHERE event_id + 1 <= {HALF} GROUP BY user_id")
def _(spark, d):
    return states.chain_report(m.edited_ops(spark, d).filter(F.col("sequence") <= _half(spark, d)), ["user_id"])


@query("b18_visible_at_half", f"WITH RECURSIVE {LINES} SELECT u.branch AS viewer, state_id, count(*) AS n_ops, arg_max(value, sequence) AS value FROM up u JOIN o ON o.branch = u.ancestor AND o.sequence <= least(u.cap, {HALF}) GROUP BY ALL")
def _(spark, d):
    return br.visible_latest(m.branch_ops(spark, d), br.lineage(m.branches(spark, d)), _half(spark, d))


@query("w3_kept_links", f"WITH {R} SELECT id, CASE WHEN id % 2 = 0 THEN id || ',' || user_id ELSE CAST(user_id AS VARCHAR) END AS kept FROM r")
def _(spark, d):
    ids = F.array(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("1x"), F.lit(None).cast("string"), F.col("user_id").cast("string"), F.lit(""))
    return m.records(spark, d).select("id", F.array_join(rec.keep_ids(ids), ",").alias("kept"))


@query("g1_path_rules", r"WITH p AS (SELECT page_id, url AS path FROM pages UNION ALL SELECT -1 - page_id, regexp_replace(url, '^https?://[^/]*', '') FROM pages UNION ALL SELECT 1000000000 + page_id, regexp_replace(url, '^https?:/', '..') FROM pages) SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\.\.?(/|$)') AS valid FROM p")
def _(spark, d):
    pages = m.table(spark, d, "pages")
    rest = pages.select((-1 - F.col("page_id")).alias("page_id"), F.regexp_replace("url", "^https?://[^/]*", "").alias("path"))
    up = pages.select((1000000000 + F.col("page_id")).alias("page_id"), F.regexp_replace("url", "^https?:/", "..").alias("path"))
    return pages.select("page_id", F.col("url").alias("path")).unionByName(rest).unionByName(up).select("page_id", trees.valid_path("path").alias("valid"))


@query("r5_scan_from_sequence", f"SELECT event_id + 1 AS id, 1 + user_id AS branch, event_type AS record_type FROM events WHERE event_id >= coalesce((SELECT event_id FROM events WHERE user_id = 4 AND event_id + 1 = {HALF}), 0)")
def _(spark, d):
    """From what branch 5 has at half of the log, else from the start."""
    rows = m.records(spark, d).withColumn("branch", 1 + F.col("user_id"))
    return rec.scan_from_sequence(rows, 5, _half(spark, d)).select("id", "branch", "record_type")


@query("s5_bounded_lengths", f"WITH {LOGS} SELECT log, 0 AS valid_records, 0 AS truncated_at, CAST(sum(size) AS BIGINT) AS dropped_bytes FROM l GROUP BY log")
def _(spark, d):
    """The first record of each log says that its payload is four gigabytes long: nothing is read or kept for it."""
    at = 42 + F.conv(F.hex(F.expr("reverse(substring(content, 39, 2))")), 16, 10).cast("int")
    content = F.overlay("content", F.unhex(F.lit("F0FFFFFF")), at)
    found = rec.torn_tail(log_format.parsed_logs(m.logs(spark, d).withColumn("content", content)))
    return found.select(F.col("path").cast("bigint").alias("log"), "valid_records", "truncated_at", "dropped_bytes")


@query("t12_json_values", "SELECT user_id, CASE WHEN user_id % 5 > 0 THEN CAST(json_extract_string(arg_max(props, event_id), '$.k') AS BIGINT) END AS parsed, user_id % 5 > 0 AS ok FROM events GROUP BY user_id")
def _(spark, d):
    values = states.latest(m.slot_ops(spark, d), ["user_id"]).drop("sequence")
    return states.json_values(values.withColumn("value", F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("{"), "value")).otherwise(F.col("value"))), "$.k", "bigint")


@query("e1_stream_states", "SELECT 'record' AS type, event_type AS name, count(*) AS n, CAST(sum(event_id + 1) AS BIGINT) AS ids FROM events WHERE event_type = 'view' GROUP BY event_type UNION ALL SELECT 'state_delta', event_type, count(*), CAST(sum(event_id + 1) AS BIGINT) FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def _(spark, d):
    config = subs.Subscription(include_records=True, record_types=("view",), include_state_changes=True, state_ids=("click", "error"))
    found = subs.streamed(spark, d, config)
    return found.groupBy("type", F.coalesce("state_id", "record_type").alias("name")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
