import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import catalog, suffix_dedup


def brute_force(rows, length=100):
    seen, out = {}, []
    for d, t in sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - length + 1):
            w = hashlib.blake2b(t[i : i + length], digest_size=12).digest()
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[i] += 1
                gone[i + length] -= 1
        cover = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((d, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, catalog.op3_suffix_dedup(spark, d).collect()), key=repr) == brute_force(rows)


def test_odd_rows_and_overlaps(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, line = text(400), text(60)
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "ab" * 5000), (None, shared)]
    for i in range(10, 60):
        a = rng.randrange(300)
        cut = shared[a : a + rng.randrange(90, 130)]
        rows.append((i, text(rng.randrange(80)) + cut + text(rng.randrange(80)) + line + text(30) + shared[rng.randrange(250) :][: rng.randrange(150)]))
    rows += [(100 + i, rows[20][1]) for i in range(5)] + [(200, shared), (201, shared + shared)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, begin int, anchor string")
    assert sorted(map(tuple, suffix_dedup.op3_suffix_dedup(df).collect()), key=repr) == brute_force(rows)
    assert suffix_dedup.op3_suffix_dedup(df.filter(F.lit(False))).collect() == []
    twice = df.filter("doc_id in (10, 11, 5)")
    one, two = suffix_dedup.op3_suffix_dedup(twice).collect(), suffix_dedup.op3_suffix_dedup(twice.unionByName(twice)).collect()
    assert sorted(two) == sorted(one * 2)


def test_columns_give_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    strings = rng.integers(0, 3, (40, 12)).astype(np.uint16)
    for start, order, common in suffix_dedup.insert_columns(lambda c: strings[:, c], 40, 12, 12):
        tails = [tuple(strings[i, start:].tolist()) for i in order]
        assert tails == sorted(tails)
        for i in range(1, 40):
            same = 0
            while same < 12 - start and tails[i][same] == tails[i - 1][same]:
                same += 1
            assert common[i] == same


def as_hashed(df):
    """Rows as their own documents: equal ones once, texts of one doc_id in the order of their hash."""
    from strandlake.llm.common import text_hash

    rows = df.select("doc_id", text_hash().alias("h"), "text").distinct().collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    return [(i, r.text) for i, r in enumerate(order)], [r.doc_id for r in order]


def test_rows_without_an_id_of_their_own(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, y = text(300), text(300)
    cases = [
        [(None, x), (None, y), (None, x[:150] + y[:150])],
        [(1, x), (1, y + x[:150]), (2, x[50:200])],
        [(None, text(90) + x[i : i + 120] + y[2 * i :][:101]) for i in range(30)] + [(4, x), (4, x), (4, y), (4, x + y), (None, None), (None, ""), (3, y)],
    ]
    for rows in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        numbered, names = as_hashed(df)
        want = sorted(((names[r[0]], *r[1:]) for r in brute_force(numbered)), key=repr)
        assert sorted(set(map(tuple, suffix_dedup.op3_suffix_dedup(df).collect())), key=repr) == sorted(set(want), key=repr)
        assert suffix_dedup.op3_suffix_dedup(df).count() == len(rows)


def test_blocks_of_whole_anchors(spark, monkeypatch):
    """More segments than a block holds, many about one anchor."""
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", 50)
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, parts = text(130), [text(140) for _ in range(8)]
    rows = [(i, text(rng.randrange(60)) + line + text(rng.randrange(60)) + rng.choice(parts)[rng.randrange(30) :]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.op3_suffix_dedup(df).collect()), key=repr) == brute_force(rows)
