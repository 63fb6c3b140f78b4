import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import catalog, components, minhash_dedup
from strandlake.llm.shingles import Words

import re


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows, percent=85):
    sets = {d: shingle_set(t) for d, t in rows}
    held = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in held[g]:
                if e < d:
                    shared[e] += 1
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in catalog.op9_minhash_dedup(spark, d).collect()}
    assert got == brute_force(rows)


def test_odd_rows_and_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 5, 9))):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A\tB"), (1005, "a"), (1006, "a b c d e"), (1007, "É b c d e"), (1008, "é b c d e"), (1009, "x y " * 9000), (1010, "X y " * 9000)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, component int, minima int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.op9_minhash_dedup(df).collect()}
    assert got == brute_force(rows)
    assert minhash_dedup.op9_minhash_dedup(df.filter(F.lit(False))).collect() == []
    kept = minhash_dedup.keep_first(df, percent=85)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in got.items() if v[2])
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "p q"), (3, "p q"), (2, "P q")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in minhash_dedup.op9_minhash_dedup(twice).collect()), key=repr) == [(2, 2), (3, 2), (3, 2), (None, None), (None, None)]


def test_words_and_shingles():
    texts = ["", "  ", "a b c d e f", "A  b\nc\td e", "x", "a b c d e f", "b\x1ca é"]
    w = Words(texts)
    assert np.diff(w.first).tolist() == [0, 0, 6, 5, 1, 6, 2]
    sets = w.sets()
    assert [len(s) for s in sets] == [0, 0, 2, 1, 1, 2, 1] and (sets[2] == sets[5]).all() and sets[3][0] in sets[2]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(1000, 1200)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {5: 5} | {k: 5 for k in range(1000, 1200)}


def test_components_of_heavy_nodes(spark, monkeypatch):
    """Nodes with many edges go by broadcast."""
    monkeypatch.setattr(components, "HEAVY", 20)
    rng = random.Random(6)
    edges = [(rng.choice((50, 60, 70)), rng.randrange(100, 400)) for _ in range(300)] + [(900 + i, 901 + i) for i in range(40)] + [(1, 60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in parent}


def test_true_pairs_in_a_group_below_the_threshold_are_found(spark):
    """A template's documents are 0.80 to 0.84 alike with each other, and a few pairs just above 0.85."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(600)]

    def edited(words, places):
        words = list(words)
        for p in places:
            words[p] = f"x{rng.randrange(10**9)}"
        return words

    rows = []
    for i in range(200):
        own = edited(base, rng.sample(range(5, 595), 6))
        rows += [(10 + 2 * i, " ".join(own))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert 1 < len({c for _, c, _ in want.values()}) < len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.op9_minhash_dedup(df).collect()}
    assert got == want


def family(rng, name, n, size=400, changes=4):
    base = [f"{name}{i}" for i in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for p in rng.sample(range(5, size - 5), changes):
            words[p] = f"x{rng.randrange(10**9)}"
        out.append(words)
    return base, out


def check(spark, rows, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in minhash_dedup.near_duplicates(df, percent).collect()}
    assert got == want
    return {c for _, c, _ in want.values()}


def test_families_with_links_that_no_hub_shows(spark):
    """Variants of a text that are hardly alike enough with each other, and two closer ones between them: one family, and
    three beside each other."""
    rng, rows = random.Random(1), []
    for f in range(3):
        base, texts = family(rng, f"f{f}w", 250, changes=6)
        for k in (40, 41):
            near = list(base)
            near[rng.randrange(5, 395)] = f"y{f}{k}"
            texts.append(near)
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
        if f == 0:
            assert len(check(spark, rows)) > 1 or len(rows) == 252
    rng.shuffle(rows)
    check(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    check(spark, [(i, t) for i, (_, t) in enumerate(rows)], 80)


def test_blocks_of_a_large_family(spark, monkeypatch):
    """Groups that take several blocks on either side."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 64)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 9000)
    rng = random.Random(2)
    rows = [(i, " ".join(t)) for i, t in enumerate(family(rng, "a", 300, changes=7)[1] + family(rng, "b", 200, changes=4)[1])]
    assert 1 < len(check(spark, rows)) < len(rows)


def test_rows_of_one_name_share_a_component(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(3, text("a")), (2, text("a")), (3, text("b")), (9, text("b")), (9, text("c")), (12, text("c") + " end"), (None, text("c")), (None, text("d")), (None, text("d") + " e"), (20, text("z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(2, 2), (3, 2), (3, 2), (9, 2), (9, 2), (12, 2), (20, 20)]
    assert [r.component_id for r in minhash_dedup.near_duplicates(df.filter("doc_id IS NULL")).collect()] == [None] * 3


def test_products_of_incidence_matrices_give_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 200, 30)]
    want = [[len(np.intersect1d(x, y)) for y in sets[9:]] for x in sets]
    for width in (7, 64, 2048):
        assert minhash_dedup.shared_counts(sets, sets[9:], width).tolist() == want
