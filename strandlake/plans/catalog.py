"""The registered queries of the record engine and their SQL counterparts, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import algebra, blobs, branches as br, records as rec, states, trees
from ..streaming import subscriptions as subs
from . import model as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions of the model, for the SQL side.
R = "r AS (SELECT event_id + 1 AS id, 1 AS branch, event_id + 1 AS sequence, ts, event_type AS record_type, props, user_id FROM events)"
LINKED = R + ", k AS (SELECT *, CASE WHEN id > 7 THEN [id - 1 - id % 7] ELSE [] END AS caused_by, CASE WHEN id % 3 = 0 THEN [user_id + 1, user_id + 1] ELSE [user_id + 1] END AS linked_to FROM r)"
BRANCHED = R + ", q AS (SELECT id, record_type, 1 + user_id % 3 AS branch, row_number() OVER (PARTITION BY user_id % 3 ORDER BY id) AS sequence FROM r)"
CONV = "c AS (SELECT conv_id, turn AS pos, role, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
BR = """b AS (SELECT id, 'b' || id AS name, CASE WHEN id > 1 THEN id // 2 END AS parent, id * 37 % 5000 AS branch_point, id * 3600 AS created, id % 7 = 3 AND id > 1 AS deleted, id % 11 <> 5 AS inherits_state
  FROM (SELECT c_custkey + 1 AS id FROM customer))"""
BOPS = BR + """, o AS (SELECT 1 + user_id AS branch, event_id + 1 AS sequence, event_type AS state_id, props AS value FROM events JOIN b ON b.id = 1 + user_id WHERE event_id + 1 > CASE WHEN b.id = 1 THEN 0 ELSE branch_point END)"""
HEADS = BOPS + ", h AS (SELECT b.*, greatest(coalesce(own, 0), branch_point) AS head FROM b LEFT JOIN (SELECT branch, max(sequence) AS own FROM o GROUP BY branch) x ON x.branch = b.id)"
LINES = BOPS + """, up AS (SELECT id AS branch, id AS ancestor, 9223372036854775807 AS cap, 0 AS depth FROM b
  UNION ALL SELECT u.branch, b.parent, least(u.cap, b.branch_point), u.depth + 1 FROM up u JOIN b ON u.ancestor = b.id WHERE b.parent IS NOT NULL AND b.inherits_state)"""
TREE = """t AS (SELECT event_id + 1 AS sequence, event_type AS kind, 'u' || user_id || '/' AS home, sha256(props) AS blob_hash, length(props) AS size FROM events),
s AS (SELECT sequence, 0 AS place, kind <> 'error' AS is_set, home || CASE WHEN kind = 'error' THEN 'view' ELSE kind END AS path, blob_hash, size FROM t WHERE kind <> 'purchase'
  UNION ALL SELECT sequence, 0, true, home || 'order', blob_hash, size FROM t WHERE kind = 'purchase'
  UNION ALL SELECT sequence, 1, false, home || 'click', NULL, NULL FROM t WHERE kind = 'purchase')"""


def tree_at(name: str, n: str) -> str:
    return f"{name} AS (SELECT path, blob_hash, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sequence DESC, place DESC) AS k FROM s WHERE sequence <= {n}) WHERE k = 1 AND is_set)"


EDITED = """e AS (SELECT user_id, event_id + 1 AS n, CASE event_type WHEN 'purchase' THEN 'E' WHEN 'error' THEN 'R' ELSE 'A' END AS op FROM events),
folded AS (SELECT user_id, list_reduce(list({'op': op, 'n': n, 'items': CAST([] AS BIGINT[])} ORDER BY n), lambda a, x:
  {'op': '', 'n': CAST(0 AS BIGINT), 'items': CASE
    WHEN x.op = 'A' THEN list_append(a.items, x.n)
    WHEN x.op = 'E' THEN CASE WHEN x.n % 5 < len(a.items) THEN list_concat(list_append(a.items[1:x.n % 5], x.n), a.items[x.n % 5 + 2:]) ELSE a.items END
    ELSE list_concat(a.items[1:x.n % 5], a.items[x.n % 5 + x.n % 3 + 1:]) END},
  {'op': '', 'n': CAST(0 AS BIGINT), 'items': CAST([] AS BIGINT[])}) AS f FROM e GROUP BY user_id)"""


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Records


@query("r1_get_record", f"WITH {R} SELECT id, record_type, props AS payload FROM r WHERE id = 77")
def _(spark, d):
    return rec.get_record(m.records(spark, d), 77).select("id", "record_type", F.col("payload").cast("string").alias("payload"))


@query("r2_ids_by_type", f"WITH {R} SELECT id FROM r WHERE record_type = 'purchase'")
def _(spark, d):
    return rec.ids_by_type(m.records(spark, d), "purchase")


@query("r3_range_scan", f"WITH {R} SELECT id, sequence, record_type FROM r WHERE sequence BETWEEN 101 AND 900 AND record_type IN ('click', 'purchase') ORDER BY sequence LIMIT 200")
def _(spark, d):
    return rec.query_range(m.records(spark, d), 1, 101, 900, ["click", "purchase"], 200).select("id", "sequence", "record_type")


@query("r3_range_scan_reverse", f"WITH {R} SELECT id, sequence, record_type FROM r WHERE sequence >= 101 AND record_type = 'view' ORDER BY sequence DESC LIMIT 50")
def _(spark, d):
    return rec.query_range(m.records(spark, d), 1, 101, None, ["view"], 50, reverse=True).select("id", "sequence", "record_type")


@query("r4_query_offset", f"WITH {R} SELECT id, sequence FROM r WHERE sequence <= 5000 ORDER BY sequence LIMIT 500 OFFSET 250")
def _(spark, d):
    return rec.query_range(m.records(spark, d), 1, None, 5000, limit=500, offset=250).select("id", "sequence")


@query("r5_scan_from", f"WITH {R} SELECT id, record_type, user_id FROM r WHERE id >= 400")
def _(spark, d):
    return rec.scan_from(m.records(spark, d), 400).select("id", "record_type", "user_id")


@query("r6_point", f"WITH {BRANCHED} SELECT id, branch, sequence, record_type FROM q WHERE branch = 2 AND sequence = 42")
def _(spark, d):
    return rec.point(m.branched_records(spark, d), 2, 42).select("id", "branch", "sequence", "record_type")


@query("r7_max_sequences", f"WITH {BRANCHED} SELECT branch, max(sequence) AS max_sequence FROM q GROUP BY branch")
def _(spark, d):
    return rec.max_sequences(m.branched_records(spark, d))


@query("r8_count", "SELECT count(*) AS n FROM events")
def _(spark, d):
    return m.records(spark, d).agg(F.count("*").alias("n"))


@query("r9_all_effects", f"WITH {LINKED} SELECT target, count(*) AS n_effects, min(id) AS first_effect, max(id) AS last_effect FROM (SELECT unnest(caused_by) AS target, id FROM k) GROUP BY target")
def _(spark, d):
    return rec.edges(m.linked_records(spark, d), "caused_by").groupBy("target").agg(F.count("*").alias("n_effects"), F.min("id").alias("first_effect"), F.max("id").alias("last_effect"))


@query("r9_get_effects", f"WITH {LINKED} SELECT id FROM (SELECT unnest(caused_by) AS target, id FROM k) WHERE target = 76")
def _(spark, d):
    return rec.mentions(m.linked_records(spark, d), "caused_by", 76)


@query("r10_get_links_to", f"WITH {LINKED} SELECT id FROM (SELECT unnest(linked_to) AS target, id FROM k) WHERE target = 5")
def _(spark, d):
    return rec.mentions(m.linked_records(spark, d), "linked_to", 5)


@query("r11_current_sequence", f"WITH {BRANCHED} SELECT max(sequence) AS current_sequence FROM q WHERE branch = 3")
def _(spark, d):
    return rec.max_sequences(m.branched_records(spark, d)).filter("branch = 3").select(F.col("max_sequence").alias("current_sequence"))


@query("r13_page", f"WITH {BRANCHED} SELECT id, sequence, true AS has_more FROM q WHERE branch = 1 ORDER BY sequence LIMIT 100 OFFSET 100")
def _(spark, d):
    return rec.page(m.branched_records(spark, d), 1, 100, 100).select("id", "sequence", "has_more")


@query("r14_tail", f"WITH {BRANCHED} SELECT id, sequence, (SELECT count(*) FROM q) AS total, (SELECT count(*) FROM q) > 50 AS has_more FROM q WHERE branch = 2 ORDER BY sequence DESC LIMIT 50")
def _(spark, d):
    return rec.tail(m.branched_records(spark, d), 2).select("id", "sequence", "total", "has_more")


@query("r15_types", f"WITH {BRANCHED} SELECT DISTINCT record_type FROM q WHERE branch = 1")
def _(spark, d):
    return rec.record_types(m.branched_records(spark, d), 1)


@query("r16_payload", f"WITH {R} SELECT id, CASE WHEN id % 4 = 0 THEN base64(CAST('<' || props AS BLOB)) ELSE replace(props, ' ', '') END AS shown FROM r")
def _(spark, d):
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("<").cast("binary"), F.col("payload"))).otherwise(F.col("payload"))
    return m.records(spark, d).select("id", rec.shown_payload(raw).alias("shown"))


@query("r17_older_page", f"WITH {R} SELECT id, sequence FROM r WHERE sequence <= 600 ORDER BY sequence DESC LIMIT 100")
def _(spark, d):
    return rec.query_range(m.records(spark, d), 1, None, 601 - 1, limit=100, reverse=True).select("id", "sequence")


@query("w3_links_given_as_text", f"WITH {R} SELECT id, CASE WHEN id % 2 = 0 THEN [id, user_id] ELSE [user_id] END AS kept FROM (SELECT id, user_id FROM r) ".replace("SELECT id, CASE", "SELECT id, len(CASE").replace("END AS kept", "END) AS n_kept"))
def _(spark, d):
    ids = F.array(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("x1"), F.col("user_id").cast("string"))
    return m.records(spark, d).select("id", F.size(rec.keep_ids(ids)).cast("bigint").alias("n_kept"))


@query("l9_stats", f"SELECT (SELECT count(*) FROM events) AS n_records, (SELECT count(*) FROM (SELECT text FROM documents UNION SELECT html FROM pages)) AS n_blobs, (SELECT count(*) FROM customer) AS n_branches, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_states, (SELECT CAST(sum(strlen(props)) AS BIGINT) FROM events) AS payload_bytes")
def _(spark, d):
    one = lambda df, c: df.agg(c)
    parts = [
        one(m.records(spark, d), F.count("*").alias("n_records")), one(blobs.stored(m.blob_rows(spark, d), "place"), F.count("*").alias("n_blobs")), one(m.branches(spark, d), F.count("*").alias("n_branches")),
        one(m.conversation_ops(spark, d), F.count_distinct("conv_id").alias("n_states")), one(m.records(spark, d), F.sum(F.length("payload")).alias("payload_bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))
    return out


@query("s2_validate", f"WITH {BRANCHED} SELECT branch, count(*) AS n, max(id) AS max_id, max(sequence) AS max_sequence, 0 AS n_bad FROM q GROUP BY branch")
def _(spark, d):
    return rec.validate(m.branched_records(spark, d).withColumn("crc32", F.crc32("payload")))


@query("s4_damage", f"WITH {R}, z AS (SELECT id, id > (SELECT max(id) FROM r) - 5 AS bad FROM r) SELECT min(id) FILTER (bad) AS first_bad, count(*) FILTER (NOT bad) AS valid_records, false AS corrupt FROM z")
def _(spark, d):
    rows = m.records(spark, d)
    last = rows.agg(F.max("id").alias("last"))
    torn = rows.join(F.broadcast(last), F.lit(True)).withColumn("crc32", F.crc32("payload") + F.when(F.col("id") > F.col("last") - 5, 1).otherwise(0))
    return rec.damage(torn)


@query("s8_pending", "SELECT o_orderkey AS seq, o_custkey AS entry FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def _(spark, d):
    from ..sources.wal import pending

    entries = m.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("entry"))
    return pending(entries, m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq")))


@query("e6_payload_elision", f"WITH {R} SELECT id, strlen(props) AS size, CASE WHEN strlen(props) <= 9 THEN props END AS payload FROM r")
def _(spark, d):
    return m.records(spark, d).select("id", F.length("payload").cast("bigint").alias("size"), rec.elided_payload(F.col("payload"), 9).alias("payload"))


# States


@query("t4_latest", "SELECT user_id, arg_max(props, event_id) AS value, max(event_id) + 1 AS sequence FROM events GROUP BY user_id")
def _(spark, d):
    return states.latest(m.slot_ops(spark, d), ["user_id"])


@query("t5_as_of", "SELECT user_id, arg_max(props, event_id) AS value, max(event_id) + 1 AS sequence FROM events WHERE event_id + 1 <= 700 GROUP BY user_id")
def _(spark, d):
    return states.latest(m.slot_ops(spark, d), ["user_id"], 700)


@query("a1_fold_whole_values", "SELECT user_id, arg_max(props, event_id) AS value FROM events GROUP BY user_id")
def _(spark, d):
    return states.latest(m.slot_ops(spark, d), ["user_id"]).drop("sequence")


@query("a4_append_logs", f"WITH {CONV} SELECT conv_id, pos, role, text FROM c")
def _(spark, d):
    items = states.log_items(m.conversation_ops(spark, d), ["conv_id"])
    return items.select("conv_id", "pos", F.get_json_object("item", "$.role").alias("role"), F.get_json_object("item", "$.text").alias("text"))


@query("t6_lengths", "SELECT conv_id, count(*) AS length FROM conversations GROUP BY conv_id")
def _(spark, d):
    return states.lengths(states.log_items(m.conversation_ops(spark, d), ["conv_id"]), ["conv_id"])


@query("t7_slice", f"WITH {CONV} SELECT conv_id, pos, role FROM c WHERE pos BETWEEN 1 AND 3")
def _(spark, d):
    return states.item_slice(states.log_items(m.conversation_ops(spark, d), ["conv_id"]), 1, 3).select("conv_id", "pos", F.get_json_object("item", "$.role").alias("role"))


@query("t8_item", f"WITH {CONV} SELECT conv_id, text FROM c WHERE pos = 2")
def _(spark, d):
    return states.item_slice(states.log_items(m.conversation_ops(spark, d), ["conv_id"]), 2, 1).select("conv_id", F.get_json_object("item", "$.text").alias("text"))


@query("t9_tail", f"WITH {CONV} SELECT conv_id, pos, text FROM c WHERE pos >= n - 2")
def _(spark, d):
    ops = m.conversation_ops(spark, d)
    return states.item_tail(states.log_items(ops, ["conv_id"]), ["conv_id"], 2, ops.groupBy("conv_id").agg(F.count("*").alias("length"))).select("conv_id", "pos", F.get_json_object("item", "$.text").alias("text"))


@query("t10_fold_items", f"WITH {EDITED} SELECT user_id, unnest(range(len(f.items))) AS pos, CAST(unnest(f.items) AS VARCHAR) AS item FROM folded")
def _(spark, d):
    return algebra.fold_items(m.edited_ops(spark, d), ["user_id"], strict=False)


@query("t5_fold_items_as_of", f"WITH {EDITED.replace('FROM events)', 'FROM events WHERE event_id < 800)')} SELECT user_id, unnest(range(len(f.items))) AS pos, CAST(unnest(f.items) AS VARCHAR) AS item FROM folded")
def _(spark, d):
    return algebra.fold_items(m.edited_ops(spark, d).filter("sequence <= 800"), ["user_id"], strict=False)


@query("a6_edits_without_redactions", f"WITH {EDITED.replace('FROM events)', '''FROM events WHERE event_type <> 'error')''')} SELECT user_id, unnest(range(len(f.items))) AS pos, CAST(unnest(f.items) AS VARCHAR) AS item FROM folded")
def _(spark, d):
    ops = m.edited_ops(spark, d).filter("op <> 'Redact'")
    return states.log_items(ops, ["user_id"]).drop("sequence")


@query("a12_fields", "SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS n_items, arg_max(event_id + 1, event_id) FILTER (event_type = 'purchase') AS last_count FROM events GROUP BY user_id")
def _(spark, d):
    rows = m.events(spark, d)
    number = (F.col("event_id") + 1).cast("string")
    kind = F.when(F.col("event_type").isin("click", "view"), "Append").otherwise("Set")
    field = F.when(F.col("event_type").isin("click", "view"), "items").when(F.col("event_type") == "purchase", "count").otherwise("other")
    ops = rows.select("user_id", (F.col("event_id") + 1).alias("sequence"), kind.alias("op"), number.alias("value"), F.array(field).alias("field_path"))
    value = F.parse_json("value")
    return algebra.fold(ops, ["user_id"]).select("user_id", F.coalesce(F.json_array_length(F.get_json_object("value", "$.items")), F.lit(0)).cast("bigint").alias("n_items"), F.variant_get(value, "$.count", "bigint").alias("last_count"))


@query("t13_list_states", "SELECT conv_id AS state_id, 'append_log' AS strategy, count(*) AS item_count, count(*) AS ops_since_snapshot FROM conversations GROUP BY conv_id")
def _(spark, d):
    report = states.chain_report(m.conversation_ops(spark, d), ["conv_id"])
    return report.select(F.col("conv_id").alias("state_id"), F.lit("append_log").alias("strategy"), F.col("n_appends").alias("item_count"), F.col("n_ops").alias("ops_since_snapshot"))


@query("t14_search", f"WITH {CONV} SELECT conv_id, pos FROM c WHERE contains(lower(text), 'the')")
def _(spark, d):
    return states.search(states.log_items(m.conversation_ops(spark, d), ["conv_id"]), "THE", "text", None).select("conv_id", "pos")


@query("t17_chain_info_at", "SELECT user_id, count(*) AS n_ops, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS n_appends, min(event_id) + 1 AS first_sequence, max(event_id) + 1 AS last_sequence FROM events WHERE event_id < 500 GROUP BY user_id")
def _(spark, d):
    return states.chain_report(m.edited_ops(spark, d).filter("sequence <= 500"), ["user_id"])


@query("e4_truncation", "WITH z AS (SELECT conv_id, turn AS pos, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, count(*) AS total_length, count(*) FILTER (back <= 2000) AS n_kept, coalesce(min(pos) FILTER (back <= 2000), count(*)) AS from_index, count(*) FILTER (back <= 2000) < count(*) AS truncated FROM z GROUP BY conv_id")
def _(spark, d):
    items = states.log_items(m.conversation_ops(spark, d), ["conv_id"]).withColumn("item", F.get_json_object("item", "$.text"))
    return states.truncated(items, ["conv_id"], 2000)


# Branches


@query("b8_ancestry", f"WITH RECURSIVE {BR}, up AS (SELECT id AS branch, id AS ancestor, 0 AS depth FROM b WHERE NOT deleted UNION ALL SELECT u.branch, p.id, u.depth + 1 FROM up u JOIN b ON u.ancestor = b.id JOIN b p ON p.id = b.parent WHERE NOT p.deleted) SELECT branch, ancestor, depth FROM up")
def _(spark, d):
    return br.ancestry(m.branches(spark, d))


@query("b10_children", f"WITH {BR} SELECT parent, id AS child FROM b WHERE NOT deleted AND parent IS NOT NULL")
def _(spark, d):
    return br.children(m.branches(spark, d))


@query("b11_orphaned", f"WITH {BR} SELECT id, name FROM b WHERE NOT deleted AND parent IN (SELECT id FROM b WHERE deleted)")
def _(spark, d):
    return br.orphaned(m.branches(spark, d))


@query("b12_empty", f"WITH {HEADS} SELECT id, name FROM h WHERE NOT deleted AND id <> 1 AND head = branch_point")
def _(spark, d):
    return br.empty(m.branch_heads(spark, d))


@query("b13_stale", f"WITH {BR} SELECT id, name FROM b WHERE NOT deleted AND id <> 1 AND created < 3600 * 60")
def _(spark, d):
    return br.stale(m.branches(spark, d), F.timestamp_seconds(F.lit(3600 * 60)))


@query("b14_can_delete", f"WITH {BR} SELECT id, name FROM b WHERE NOT deleted AND id NOT IN (1, 9) AND id NOT IN (SELECT parent FROM b WHERE NOT deleted AND parent IS NOT NULL)")
def _(spark, d):
    return br.can_delete(m.branches(spark, d), 9)


@query("b15_gc", f"WITH {HEADS}, live AS (SELECT * FROM h WHERE NOT deleted), cand AS (SELECT id, name FROM live WHERE parent IN (SELECT id FROM h WHERE deleted) UNION SELECT id, name FROM live WHERE id <> 1 AND head = branch_point) SELECT id, name, id NOT IN (1, 9) AND id NOT IN (SELECT parent FROM live WHERE parent IS NOT NULL) AS deleted FROM cand WHERE contains(name, '1')")
def _(spark, d):
    return br.gc_plan(m.branch_heads(spark, d), 9, pattern="1")


@query("b16_reconcile", f"WITH {BOPS}, x AS (SELECT branch + 3 AS branch, max(sequence) AS s FROM o GROUP BY branch) SELECT coalesce(id, branch) AS id, greatest(coalesce(branch_point, 0), coalesce(s, 0)) AS head, id IS NULL AS orphan FROM b FULL JOIN x ON x.branch = b.id")
def _(spark, d):
    heads = rec.max_sequences(m.branch_ops(spark, d)).withColumn("branch", F.col("branch") + 3)
    return br.reconcile_heads(m.branches(spark, d), heads)


@query("b18_visible", f"WITH RECURSIVE {LINES} SELECT u.branch AS viewer, state_id, count(*) AS n_ops, arg_max(value, sequence) AS value FROM up u JOIN o ON o.branch = u.ancestor AND o.sequence <= u.cap GROUP BY ALL")
def _(spark, d):
    return br.visible_latest(m.branch_ops(spark, d), br.lineage(m.branches(spark, d)))


@query("b2_visible_at", f"WITH RECURSIVE {LINES} SELECT u.branch AS viewer, state_id, count(*) AS n_ops, arg_max(value, sequence) AS value FROM up u JOIN o ON o.branch = u.ancestor AND o.sequence <= least(u.cap, 900) GROUP BY ALL")
def _(spark, d):
    return br.visible_latest(m.branch_ops(spark, d), br.lineage(m.branches(spark, d)), 900)


# Trees


@query("g1_valid_paths", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN false WHEN page_id % 7 = 0 THEN false ELSE true END AS valid FROM pages")
def _(spark, d):
    path = F.regexp_replace("url", "^http://", "")
    bad = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), path)).when(F.col("page_id") % 7 == 0, F.concat(path, F.lit("/../x"))).otherwise(path)
    return m.table(spark, d, "pages").select("page_id", trees.valid_path(bad).alias("valid"))


@query("g5_tree_get", f"WITH {TREE}, {tree_at('x', '1000000000')} SELECT path, blob_hash, size FROM x WHERE path = 'u8/signup'")
def _(spark, d):
    return trees.tree(m.tree_ops(spark, d), []).filter("path = 'u8/signup'").select("path", "entry.blob_hash", "entry.size")


@query("g6_tree_list", f"WITH {TREE}, {tree_at('x', '1000000000')} SELECT path, blob_hash, size FROM x WHERE starts_with(path, 'u1')")
def _(spark, d):
    return trees.listed(trees.tree(m.tree_ops(spark, d), []), "u1").select("path", "entry.blob_hash", "entry.size")


@query("g7_tree_diff", f"WITH {TREE}, {tree_at('x', '400')}, {tree_at('y', '900')} SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'removed' ELSE 'modified' END AS change, x.blob_hash AS old_hash, y.blob_hash AS new_hash FROM x FULL JOIN y ON x.path = y.path WHERE x.blob_hash IS DISTINCT FROM y.blob_hash OR x.size IS DISTINCT FROM y.size")
def _(spark, d):
    ops = m.tree_ops(spark, d)
    return trees.diff(trees.tree(ops, [], 400), trees.tree(ops, [], 900), []).select("path", "change", F.col("old.blob_hash").alias("old_hash"), F.col("new.blob_hash").alias("new_hash"))


@query("c5_tree_delta", f"WITH {TREE} SELECT path, is_set, CASE WHEN is_set THEN blob_hash END AS blob_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sequence DESC, place DESC) AS k FROM s WHERE sequence > 500) WHERE k = 1")
def _(spark, d):
    return trees.last_ops(m.tree_ops(spark, d), [], since=500).select("path", (F.col("op") == "set").alias("is_set"), "entry.blob_hash")


# Compaction


@query("c4_delta_items", "SELECT conv_id, turn + 1 AS sequence, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn >= CASE WHEN n >= 3 THEN 3 ELSE 0 END")
def _(spark, d):
    ops = m.conversation_ops(spark, d)
    marks = ops.filter("sequence = 3").select("conv_id", "sequence", F.lit("DeltaSnapshot").alias("op"), F.lit("[]").alias("value")).withColumn("derived", F.lit(True))
    both = ops.withColumn("derived", F.lit(False)).unionByName(marks)
    return states.delta_items(both, ["conv_id"]).select("conv_id", "sequence", F.get_json_object("value", "$.text").alias("text"))


CHAINS = "z AS (SELECT user_id, event_id + 1 AS sequence, strlen(props) AS size, event_type = 'signup' AND user_id % 2 = 0 AS snap FROM events), n AS (SELECT user_id, max(sequence) FILTER (snap) AS s FROM z GROUP BY user_id), st AS (SELECT z.user_id, count(*) AS total_ops, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (sequence < s) AS ops_before, CAST(coalesce(sum(size) FILTER (sequence < s), 0) AS BIGINT) AS bytes_before, bool_or(s IS NOT NULL) AS has_snapshot FROM z JOIN n USING (user_id) GROUP BY z.user_id)"


def _chains(spark, d):
    snap = (F.col("event_type") == "signup") & (F.col("user_id") % 2 == 0)
    ops = m.events(spark, d).select("user_id", (F.col("event_id") + 1).alias("sequence"), F.when(snap, "Snapshot").otherwise("Append").alias("op"), F.col("props").alias("value"))
    return states.chain_stats(ops, ["user_id"])


@query("c9_chain_stats", f"WITH {CHAINS} SELECT * FROM st")
def _(spark, d):
    return _chains(spark, d)


@query("c10_compaction_summary", f"WITH {CHAINS} SELECT count(*) AS n_states, CAST(sum(total_ops) AS BIGINT) AS total_ops, CAST(sum(CASE WHEN has_snapshot THEN ops_before ELSE total_ops - 1 END) AS BIGINT) AS compactable_ops, CAST(sum(CASE WHEN has_snapshot THEN bytes_before ELSE 0 END) AS BIGINT) AS compactable_bytes, count(*) FILTER (NOT has_snapshot AND total_ops > 1) AS n_needing FROM st")
def _(spark, d):
    return states.compaction_summary(_chains(spark, d))


@query("c11_checkpoint_invariance", "SELECT count(DISTINCT user_id) AS n_states, 0 AS n_differing FROM events")
def _(spark, d):
    """Folds all operations, and the tail after a checkpoint on top of the checkpoint: the values must agree."""
    ops = m.edited_ops(spark, d)
    head = algebra.fold(ops.filter("sequence <= 600"), ["user_id"], strict=False).select("user_id", F.lit(600).cast("bigint").alias("sequence"), F.lit("Snapshot").alias("op"), "value", F.lit(0).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("idx_end"))
    again = algebra.fold(ops.filter("sequence > 600").unionByName(head), ["user_id"], strict=False).withColumnRenamed("value", "again")
    both = algebra.fold(ops, ["user_id"], strict=False).join(again, "user_id", "full_outer")
    return both.agg(F.count("*").alias("n_states"), F.count_if(~F.col("value").eqNullSafe(F.col("again"))).alias("n_differing"))


@query("c12_chain_report", "SELECT conv_id, count(*) AS n_ops, count(*) AS n_appends, min(turn) + 1 AS first_sequence, max(turn) + 1 AS last_sequence FROM conversations GROUP BY conv_id")
def _(spark, d):
    return states.chain_report(m.conversation_ops(spark, d), ["conv_id"])


# Blobs

BLOBS = "x AS (SELECT text AS content, 'text/plain' AS content_type, doc_id AS place FROM documents UNION ALL SELECT html, 'text/html', -1 - page_id FROM pages), bl AS (SELECT sha256(content) AS hash, arg_min(content_type, place) AS content_type, strlen(any_value(content)) AS size FROM x GROUP BY 1)"


@query("o1_store_blobs", f"WITH {BLOBS} SELECT hash, content_type, size FROM bl")
def _(spark, d):
    return blobs.stored(m.blob_rows(spark, d), "place").select("hash", "content_type", "size")


@query("o2_verify_blobs", f"WITH {BLOBS} SELECT hash, content_type, size, true AS crc_ok, true AS hash_ok FROM bl")
def _(spark, d):
    return blobs.verified(blobs.stored(m.blob_rows(spark, d), "place"))


@query("o3_new_blobs", f"WITH {BLOBS} SELECT hash FROM bl WHERE hash NOT IN (SELECT sha256(html) FROM pages)")
def _(spark, d):
    rows = m.blob_rows(spark, d)
    return blobs.stored(rows, "place", blobs.stored(rows.filter("place < 0"), "place")).select("hash")


@query("o6_total_size", f"WITH {BLOBS} SELECT CAST(sum(size + 19 + strlen(content_type)) AS BIGINT) AS total_size, count(*) AS n_blobs FROM bl")
def _(spark, d):
    return blobs.total_size(blobs.stored(m.blob_rows(spark, d), "place"))


@query("o7_shards", f"WITH {BLOBS} SELECT substr(hash, 1, 2) AS shard, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM bl GROUP BY 1")
def _(spark, d):
    return blobs.stored(m.blob_rows(spark, d), "place").groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# Subscriptions


@query("e3_catch_up", f"WITH {R} SELECT 'record' AS type, id FROM r WHERE sequence >= 9000 AND record_type IN ('click', 'error') UNION ALL SELECT 'caught_up', NULL")
def _(spark, d):
    config = subs.Subscription(from_sequence=9000, include_records=True, record_types=("click", "error"))
    return subs.catch_up(m.records(spark, d), config, branch=1).select("type", "id")


@query("e5_live_events", f"WITH {R} SELECT 'record' AS type, id FROM r WHERE record_type = 'purchase'")
def _(spark, d):
    config = subs.Subscription(include_records=True, record_types=("purchase",))
    return subs.live(m.records(spark, d), config).select("type", "id")


@query("e1_stream", "SELECT 'record' AS type, record_type, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT event_id + 1 AS id, event_type AS record_type FROM events WHERE event_type IN ('view', 'error')) GROUP BY ALL")
def _(spark, d):
    config = subs.Subscription(include_records=True, record_types=("view", "error"))
    found = subs.streamed(spark, d, config)
    return found.groupBy("type", "record_type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


from . import changes as _changes  # noqa: E402, F401  (registers the rest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
