import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from strandlake.llm import catalog, chat_formatting as chat, merkle


def same(rows, want):
    return sorted(map(tuple, rows), key=repr) == sorted(map(tuple, want), key=repr)


def test_chat_matches_sql(spark, sf_dir):
    got = catalog.op1_chat_formatting(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = ", ".join(got.columns)
    assert same(got.collect(), con.execute(f"SELECT {names} FROM ({chat.ORACLE})").fetchall())


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
        {"instruction": "do", "input": "", "output": "done"},
        {"instruction": "do", "input": "it", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"system": "", "prompt": "p", "response": "c"},
        {"role": "user", "text": None},
        {"other": 1},
    ]
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(8, 0, "no json"), (9, 0, None)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).orderBy("conv_id", "part").collect()
    got = {}
    for r in turns:
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {
        0: [("user", "a"), ("assistant", "")], 1: [("user", "q"), ("assistant", "r")], 2: [("user", "do"), ("assistant", "done")],
        3: [("user", "do\n\nit"), ("assistant", "done")], 4: [("user", "p"), ("assistant", "c")], 5: [("user", "p"), ("assistant", "c")],
        6: [("user", "")], 7: [(None, None)], 8: [(None, None)], 9: [(None, None)],
    }


def test_escaping_is_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|x<|im_end|>\n", "<", "|", "<<||>", "", None, "é\\<|im_start|>user\n", "x" * 100000]
    rows = [(0, i, r, t, 1) for i, t in enumerate(texts) for r in ("assistant", "a\nb\\n<|c")] + [(None, 0, None, None, 2)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.op1_chat_formatting(spark, df).collect()}
    turns = sorted(((i, r, t or "") for _, i, r, t, _ in rows[:-2]), key=lambda x: x[0])
    assert got[0].n_turns == len(turns) and got[None].n_turns == 2
    learnt = "".join(t or "" for t in texts)
    assert got[0].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and got[0].loss_chars == len(learnt)
    segments = chat.formatted(chat.canonical_turns(df.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record")))).collect()
    assert sorted((s.turn, *chat.read_segment(s.segment)) for s in segments if s.conv_id == 0) == sorted(turns)
    assert all(s.segment.count("<|") == 2 for s in segments)


def test_nothing_is_lost(spark):
    """Turns longer than a JSON reader's usual bound come back; records without a mapping are counted or an error."""
    rows = spark.createDataFrame([(1, 0, "user", 3), (2, 0, "assistant", 60_000_000)], "conv_id long, turn long, role string, n int")
    rows = rows.withColumn("text", F.expr("repeat('y', n)"))
    got = {r.conv_id: r for r in chat.op1_chat_formatting(spark, rows).collect()}
    assert got[2].loss_chars == 60_000_000 and got[2].loss_sha256 == hashlib.sha256(b"y" * 60_000_000).hexdigest() and got[1].n_turns == 1 and len(got) == 3
    assert [r.conv_id for r in chat.op1_chat_formatting(spark, rows.filter(F.lit(False))).collect()] == [-1]
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", F.expr("repeat(text, 1)").alias("text"))).alias("record")).filter("conv_id = 1").unionByName(
        spark.createDataFrame([(4, 0, "no json"), (4, 1, None), (5, 0, '{"x": 1}')], "conv_id long, turn long, record string"))
    turns = chat.canonical_turns(records)
    assert {r.conv_id: r.n_unmapped for r in chat.unmapped(turns).collect()} == {4: 2, 5: 1}
    assert [r.conv_id for r in chat.digests(chat.formatted(turns, strict=False)).collect()] == [1]
    try:
        chat.digests(chat.formatted(turns)).collect()
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "no mapping for a record of conversation" in str(e)
    long = rows.filter("conv_id = 2").select("conv_id", "turn", F.to_json(F.struct("role", F.substring("text", 1, 21_000_000).alias("text"))).alias("record"))
    assert chat.digests(chat.formatted(chat.canonical_turns(long))).first().loss_chars == 21_000_000


def test_columns_select_a_mapping_too(spark):
    table = spark.createDataFrame([(1, 0, [("human", "q"), ("gpt", None)], "x")], "conv_id long, turn long, conversations array<struct<from string, value string>>, layout string")
    assert [(r.role, r.text, r.layout) for r in chat.turns_of_table(table, ["conversations"]).orderBy("part").collect()] == [("user", "q", "shared"), ("assistant", "", "shared")]
    try:
        chat.turns_of_table(table, ["layout"])
        raise AssertionError("it should have failed")
    except ValueError:
        pass


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for i, (d, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        own = str(merkle.Tree(t))
        yield d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, str(merkle.Tree(edited)), merkle.likeness(own, str(merkle.Tree(edited))), merkle.likeness(own, str(merkle.Tree(nxt)))


def test_fingerprints_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = catalog.op2_fingerprints(spark, sf_dir).collect()
    assert same(got, expected([(r.doc_id, r.text) for r in docs.collect()]))
    long = [r for r in got if r.n_chars > 300]
    assert all(r.near_edited > 0.5 for r in long) and sum(r.near_next < 0.2 for r in long) > 0.8 * len(long)


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, "a\n\nb é"), (None, "none"), (7, None), (7, ""), (3, "x" * 100000), (3, "x" * 100000), (-5, "one. two! three?\n" * 9)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, marker string")
    assert same(merkle.op2_fingerprints(df).collect(), expected(rows))
    assert same(merkle.op2_fingerprints(df.limit(1)).collect(), expected(rows[:1]))
    assert merkle.op2_fingerprints(df.filter(F.lit(False))).collect() == []


def test_differing_branches_locate_an_edit():
    lines = [f"line number {i} says this.\n" for i in range(40)]
    a = str(merkle.Tree("".join(lines)))
    lines[17] = "another line.\n"
    b = str(merkle.Tree("".join(lines)))
    flat = [(i, k) for i, (_, ps) in enumerate(merkle.parse(a)[1]) for k in range(len(ps))]
    assert merkle.differing(a, b) == [flat[17]] and merkle.differing(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1
