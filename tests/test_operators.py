"""Operators on small made-up tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake import errors
from strandlake.functions import ordering
from strandlake.operators import branches as br, records as rec, states, trees
from strandlake.plans import catalog


def test_visible_latest_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(br, "RANGE_BITS", 3)
    rng = random.Random(1)
    table = [(i, None if i == 1 else rng.randrange(1, i), rng.randrange(0, 60), i % 5 != 3) for i in range(1, 30)]
    branches = spark.createDataFrame([(i, f"b{i}", p, at, p, keeps) for i, p, at, keeps in table], "id long, name string, parent long, branch_point long, state_parent long, inherits_state boolean")
    ops = [(rng.randrange(1, 30), s, rng.choice("xyz"), f"v{k}") for k, s in enumerate(sorted(rng.sample(range(1, 400), 200)))]
    df = spark.createDataFrame(ops, "branch long, sequence long, state_id string, value string")
    of = {i: (p, at, keeps) for i, p, at, keeps in table}

    def seen(viewer, last):
        branch, cap, out = viewer, last, {}
        while branch is not None:
            for b, s, state, value in ops:
                if b == branch and s <= cap:
                    n, best = out.get(state, (0, (0, "")))
                    out[state] = (n + 1, max(best, (s, value)))
            parent, at, keeps = of[branch]
            branch, cap = (parent, min(cap, at)) if keeps else (None, cap)
        return {(viewer, state, n, best[1]) for state, (n, best) in out.items()}

    for at in (None, 100, 17):
        got = {tuple(r) for r in br.visible_latest(df, br.lineage(branches), at).collect()}
        assert got == set().union(*(seen(i, at or br.NO_CAP) for i in of))
    assert br.visible_latest(df.filter(F.lit(False)), br.lineage(branches)).collect() == []


BRANCH = "id long, name string, parent long, branch_point long, state_parent long, inherits_state boolean, deleted boolean"


def test_lineage_of_more_than_a_million_rows(spark, monkeypatch):
    """Also with jumps that are not broadcast; a parent that isn't there is the last ancestor."""
    monkeypatch.setattr(br, "BROADCAST_ROWS", 1000)
    n = 1600
    table = [(i, f"b{i}", i - 1, 5 * n - 3 * i, i - 1, i != 7, i == 9) for i in range(1, n + 1)]
    branches = spark.createDataFrame(table, BRANCH)
    found = br.lineage(branches)
    assert found.columns == ["branch", "ancestor", "cap", "depth"]
    got = found.agg(F.count("*").alias("n"), F.sum("depth").alias("d"), F.count_if(F.col("ancestor") != F.col("branch") - F.col("depth")).alias("wrong"), F.count_if((F.col("depth") > 0) & (F.col("cap") != 5 * n - 3 * F.col("branch"))).alias("caps")).first()
    steps = [i if i < 7 else i - 7 for i in range(1, n + 1)]
    assert tuple(got) == (sum(k + 1 for k in steps), sum(k * (k + 1) // 2 for k in steps), 0, 0) and got.n > 1_000_000
    few = {tuple(r) for r in br.lineage(branches.filter("id < 20")).collect()}
    assert few == {tuple(r) for i in range(1, 20) for r in br.lineage_of(branches.filter("id < 20"), i).collect()}
    assert sorted(tuple(r) for r in br.ancestry(branches.filter("id < 12")).collect()) == sorted((i, j, i - j) for i in range(1, 12) for j in range(1, i + 1) if i != 9 != j and (i < 9 or j > 9))


@pytest.mark.parametrize("name", ["b18_visible", "b18_visible_at_half", "b2_fork_states", "b3_empty_forks"])
def test_tables_of_branches_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(br, "BROADCAST_ROWS", 0)
    found = catalog.queries()[name](spark, sf_dir)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_circle_of_branches_is_an_error(spark):
    branches = spark.createDataFrame([(1, "a", None, 0, None, True, False), (2, "b", 4, 1, 4, True, False), (3, "c", 2, 2, 2, True, False), (4, "d", 3, 3, 3, True, False)], BRANCH)
    with pytest.raises(errors.InvalidOperation):
        br.lineage(branches)


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(9)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for backwards in (False, True):
        got = {(r.k, r.i): r.s for r in ordering.running_sum(df, ["k"], "i", "v", "s", backwards, bits=3).collect()}
        assert got == {(k, i): sum(v for c, j, v in rows if c == k and (j >= i if backwards else j <= i)) for k, i, _ in rows}


def test_early_edits_change_nothing(spark):
    ops = spark.createDataFrame([("s", 1, "Edit", '"no"', 0), ("s", 2, "Append", "1", None), ("s", 3, "Edit", '"a"', 0), ("s", 4, "Edit", '"b"', 1), ("s", 5, "Append", "2", None), ("s", 6, "Edit", '"c"', 0)], "k string, sequence long, op string, value string, idx long")
    assert sorted((r.pos, r.item) for r in states.log_items(ops, ["k"]).collect()) == [(0, '"c"'), (1, "2")]
    assert {r.sequence: r.ok for r in states.checked_ops(ops, ["k"]).collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_payloads_of_operations_come_back(spark):
    values = ["", "a", "é\n\"{", "x" * 1000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    coded = df.select("i", rec.op_payload("Append", F.col("v")).alias("p"))
    assert coded.orderBy("i").first().p == '{"Append":[]}'
    assert [tuple(r.o) for r in coded.select("i", rec.decoded_op(F.col("p")).alias("o")).orderBy("i").collect()] == [("Append", v) for v in values]


def test_identity_needs_an_object(spark):
    df = spark.createDataFrame([(1, '{"a": 1.50, "id": 3}'), (2, "[1]"), (3, "5"), (4, "no"), (5, None), (6, "{}")], "n long, item string")
    got = {r.n: r.v for r in df.select("n", rec.with_identity(F.col("item"), F.col("n"), F.col("n") + 10).alias("v")).collect()}
    assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4 and got[6] == '{"id":"6","sequence":16}'
    assert spark.range(1).select(F.get_json_object(F.lit(got[1]), "$.id")).first()[0] == "1"


def test_a_snapshot_and_later_operations_make_the_tree(spark):
    rows = [("t", s, "TreeSet" if s % 4 else "TreeRemove", f"p{s % 7}", (f"h{s}", s, 1) if s % 4 else None) for s in range(1, 60)]
    ops = spark.createDataFrame(rows, "k string, sequence long, op string, path string, entry struct<blob_hash: string, size: long, mode: int>")
    whole = sorted(map(str, trees.tree(ops, ["k"]).collect()))
    for at in (1, 20, 59):
        later = trees.snapshots(ops, ["k"], at).unionByName(ops.filter(F.col("sequence") > at))
        assert sorted(map(str, trees.tree(later, ["k"]).collect())) == whole


def test_a_scan_from_a_sequence_that_is_not_there_begins_at_the_start(spark):
    df = spark.createDataFrame([(i, 1 + i % 2, i // 2) for i in range(1, 20)], "id long, branch long, sequence long")
    assert [r.id for r in rec.scan_from_sequence(df, 1, 4).collect()] == list(range(8, 20))
    assert [r.id for r in rec.scan_from_sequence(df, 1, 400).collect()] == list(range(1, 20))


def test_positions_can_be_filtered_and_keys_may_be_null(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None) for i in range(100)]
    found = ordering.positioned(spark.createDataFrame(rows, "id long, k string"), ["k"], "id", "at")
    want = {}
    for i, k in rows:
        want.setdefault(k, []).append(i)
    assert {(r.id, r.at) for r in found.collect()} == {(i, n + 1) for ids in want.values() for n, i in enumerate(ids)}
    assert [r.id for r in found.filter("k = 'a' AND at = 3").agg(F.min("id").alias("id")).collect()] == [want["a"][2]]
