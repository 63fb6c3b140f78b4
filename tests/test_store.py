import random

import pytest
from pyspark.sql import functions as F

from strandlake import errors
from strandlake.operators import algebra, states
from strandlake.functions.json_values import text_of
from strandlake.sources import log_format
from strandlake.store import Store


@pytest.fixture()
def store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "store"))
    yield s
    s.close()


def test_append_query_reopen_and_lock(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.open_or_create(spark, path)
    a = s.append_json("message", {"n": 1})
    b = s.append("reply", b"x", caused_by=[a["id"], "no"], linked_to=[a["id"], a["id"]])
    assert (a["id"], b["id"], b["sequence"]) == (1, 2, 2)
    assert [r.id for r in s.get_effects(1).collect()] == [2] and [r.id for r in s.get_links_to(1).collect()] == [2, 2]
    with pytest.raises(errors.Locked):
        Store.open(spark, path)
    s.close()
    with pytest.raises(errors.InvalidOperation):
        s.append("x", b"")
    s = Store.open(spark, path)
    assert s.append("message", b"y")["sequence"] == 3
    assert [r.sequence for r in s.query(reverse=True, types=["message"]).collect()] == [3, 1]
    assert s.stats().first().n_records == 3
    s.close()
    with pytest.raises(errors.NotInitialized):
        Store.open_or_create(spark, str(tmp_path / "none"), create=False)


def test_uncommitted_files_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.create(spark, path)
    s.append("a", b"1")
    s.sync()
    s.table("records").withColumn("id", F.lit(9).cast("bigint")).write.parquet(f"{path}/records-torn")
    s.close()
    s = Store.open(spark, path)
    assert [r.id for r in s.table("records").collect()] == [1] and s.append("a", b"2")["id"] == 2
    s.close()


def test_bulk_append(spark, store):
    store.append("first", b"")
    rows = spark.range(1000).select(F.lit("bulk").alias("record_type"), F.col("id").cast("string").cast("binary").alias("payload"), F.lit("raw").alias("encoding"), F.col("id").alias("n"))
    assert store.append_many(rows, "n") == 1000
    got = store.query(limit=None).collect()
    assert [r.sequence for r in got] == list(range(1, 1002)) and [bytes(r.payload) for r in got[1:4]] == [b"0", b"1", b"2"]
    assert store.append("last", b"")["id"] == 1002


def test_states_over_branches(store):
    store.register_state("log", "append_log")
    with pytest.raises(errors.StateExists):
        store.register_state("log", "tree")
    assert store.get_state("log") is None
    for x in ("first", "second"):
        store.append_to_state("log", x)
    store.edit_state_item("log", 0, "FIRST")
    store.append_to_state("log", "third")
    store.redact_state_items("log", 1, 2)
    store.create_branch_at("three", "main", 3)
    store.create_branch_at("five", "main", 5)
    store.create_empty_branch("none", "main")
    assert store.get_state_json("log") == ["FIRST", "third"] and store.get_state_json("log", 2) == ["first", "second"]
    with pytest.raises(errors.InvalidOperation):
        store.edit_state_item("log", 2, "x")
    with pytest.raises(errors.InvalidSequence):
        store.create_branch_at("far", "main", 99)
    for name, want in (("three", ["FIRST", "second"]), ("five", ["FIRST", "third"]), ("none", None)):
        store.switch_branch(name)
        assert store.get_state_json("log") == want
    store.switch_branch("five")
    store.append_to_state_with_identity("log", {"k": 1})
    store.create_branch("deep")
    store.switch_branch("deep")
    store.delete_branch_with_reparent("five", "main")
    assert store.get_state_json("log")[2]["k"] == 1 and store.get_state_len("log") == 3
    assert store.get_state_item("log", 1) == "third" and store.get_state_item("log", 9) is None
    assert [r.item for r in store.get_state_tail("log", 2).collect()][0] == '"third"'
    before = store.get_state_json("log")
    assert store.compact_all_states() == 1 and store.get_state_json("log") == before
    with pytest.raises(errors.BranchNotFound):
        store.delete_branch("deep")
    store.switch_branch("main")
    assert set(store.gc()["deleted"]) == {"three", "none"}


def test_type_errors_come_at_read(store):
    store.set_state("s", {"a": 1})
    store.append_to_state("s", 1)
    with pytest.raises(Exception, match="no array"):
        store.get_state("s")


def test_trees(store):
    store.register_state("files", "tree")
    store.tree_set("files", "a.txt", "aaa", 10)
    store.tree_batch("files", [{"op": "set", "path": "src/b", "entry": {"blob_hash": "b", "size": 1, "mode": 1}}, {"op": "set", "path": "c", "entry": {"blob_hash": "c", "size": 1, "mode": 1}}, {"op": "remove", "path": "c"}])
    store.tree_remove("files", "a.txt")
    assert [r.path for r in store.tree_list("files").collect()] == ["src/b"] and store.tree_get("files", "c") is None
    assert [(r.path, r.change) for r in store.tree_diff("files", 1, 3).collect()] == [("a.txt", "removed"), ("src/b", "added")]
    for bad in ("", "/a", "../e", "d/../f", "./r", "d/./f", "n\0l"):
        with pytest.raises(errors.InvalidOperation):
            store.tree_set("files", bad, "x", 1)
    store.compact_state("files")
    store.tree_set("files", "z", "z", 1)
    assert [r.path for r in store.tree_list("files").collect()] == ["src/b", "z"]
    with pytest.raises(errors.InvalidOperation):
        store.tree_set("log", "a", "x", 1)


def test_blobs_and_events(store):
    seen = []
    store.listen(lambda kind, row: seen.append(kind))
    h = store.store_blob(b"abc", "text/plain")
    assert store.store_blob(b"abc", "other") == h and store.get_blob(h) == b"abc" and store.get_blob("0" * 64) is None
    store.append("a", b"")
    store.append_to_state("s", 1)
    store.create_branch("b")
    assert seen == ["record", "branch_head", "state_delta", "branch_head", "branch_created"]


def test_folds_agree_on_random_programs(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for chain in range(25):
        value = None
        for n in range(1, rng.randrange(2, 60)):
            kind = rng.choices(["Append", "Edit", "Redact", "Set", "Field"], [60, 15, 10, 4, 0])[0]
            op = {"op": kind, "value": str(n), "idx": rng.randrange(6), "idx_end": rng.randrange(9)}
            if kind == "Set":
                op["value"] = "[1, 2]"
            rows.append((chain, n, op["op"], op["value"], op["idx"], op["idx_end"]))
            value = algebra.apply(value, op, strict=False)
        want[chain] = text_of(value)
    ops = spark.createDataFrame(rows, "chain int, sequence long, op string, value string, idx long, idx_end long")
    assert dict(map(tuple, algebra.fold(ops, ["chain"], strict=False).collect())) == want
    plain = ops.filter("op = 'Append'")
    one = algebra.fold_items(plain, ["chain"]).select("chain", "pos", "item").collect()
    assert sorted(one) == sorted(states.log_items(plain, ["chain"]).select("chain", "pos", "item").collect())


@pytest.mark.parametrize("case", [
    (("snapshot", 1, 1, 99), None), (("delta", 5, 0, 4), None), (("delta", 5, 0, 5), "full"), (("struct", 0, 0, 100), "full"),
    (("append_log", 3, 2, 2), None), (("append_log", 3, 2, 3), "delta"), (("append_log", 3, 2, 3, 1), "full"), (("append_log", 3, 2, 3, 1, 50), "delta"),
    (("append_log", 3, 2, 3, 0, 50, True), "full"), (("tree", 3, 2, 3, 0, 50, True), "delta"), (("tree", 3, 2, 0, 2), "full"),
])
def test_snapshot_policy(case):
    assert states.snapshot_needed(*case[0]) == case[1]


def test_log_import(spark, tmp_path):
    frames = [log_format.frame(i, i, 1, i * 10, "kind", "json", b'{"i":%d}' % i, [1] * (i % 3), [2]) for i in range(1, 20)]
    (tmp_path / "records.log").write_bytes(b"".join(frames) + frames[0][:30])
    rows = log_format.read_log(spark, str(tmp_path / "records.log")).orderBy("offset").collect()
    assert [r.id for r in rows] == [*range(1, 20), None] and [r.ok for r in rows] == [True] * 19 + [False]
    assert rows[4].caused_by == [1, 1] and bytes(rows[4].payload) == b'{"i":5}'
