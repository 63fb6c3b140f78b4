import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import catalog, compact_windows, minhash_dedup, quality_rules
from strandlake.llm.common import table
from tests.llm.test_minhash import brute_force as near_copies
from tests.llm.test_tokens import check_packing


def test_compact_windows_are_all_and_only():
    rng = np.random.default_rng(1)
    for sizes in ((3,), (10,), (60, 0, 9, 10), (200, 5, 40)):
        texts = [rng.integers(1, 40, n).astype(np.uint64) for n in sizes]
        first = np.concatenate([[0], np.cumsum(sizes)])
        found = compact_windows.compact_windows(np.concatenate(texts), first, 10)
        got = {(t, c, i, j) for t, a, c, b in zip(*map(np.ndarray.tolist, found)) for i in range(a, c + 1) for j in range(max(c, i + 9), b + 1)}
        assert got == {(t, i + int(x[i : j + 1].argmin()), i, j) for t, x in enumerate(texts) for i in range(len(x)) for j in range(i + 9, len(x))}


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(3)
    passage, other = words(rng, 70), words(rng, 60)
    rows, want = [], {}
    for i in range(40):
        own = words(rng, 200)
        if i % 4 == 0:
            own[100:100] = passage
        if i % 4 == 1:
            edited = list(other)
            if i > 1:
                edited[rng.randrange(60)] = "x"
            own[50:50] = edited
        rows.append((i, " ".join(own)))
        want[i] = i % 4 < 2
    rows += [(100, None), (101, ""), (102, "a b"), (None, "x " * 300), (104, " ".join(passage)), (105, rows[3][1])]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, n_chars long, begin int")
    got = {r.doc_id: r for r in compact_windows.op4_compact_windows(df).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert (got[i].n_links > 0) == (want[i] or i == 3), i
        if i % 4 == 0:
            assert got[i].component_id == 0 and (got[i].n_repeated_words in range(70, 74) if i else got[i].n_passages == 0)
        if i % 4 == 1:
            assert got[i].component_id == 1
    assert got[104].n_repeated_words == 70 and got[105].n_repeated_words == 200 and got[105].component_id == 3
    kept = {r.doc_id: r for r in compact_windows.without_passages(df).collect()}
    assert 104 not in kept and 105 not in kept and kept[0].text == rows[0][1] and kept[0].n_chars == 9
    assert kept[8].text.split() == [w for w in rows[8][1].split() if w not in set(passage)] and kept[8].n_chars == len(kept[8].text)
    assert kept[100].text is None and kept[102].text == "a b"
    assert compact_windows.op4_compact_windows(df.filter(F.lit(False))).collect() == []
    twice = compact_windows.op4_compact_windows(df.filter("doc_id in (0, 2)").unionByName(df.filter("doc_id = 0"))).collect()
    assert {r.doc_id: r.n_repeated_words for r in twice} == {0: 0, 2: 0}


def exact_runs(rows, least=50):
    """Documents with a run of `least` words (A-Z lower-cased) that a smaller doc_id or an earlier place has."""
    seen, out = {}, set()
    for d, t in sorted(rows):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        for i in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[i : i + least]), (d, i)) != (d, i):
                out.add(d)
    return out


def test_no_exact_passage_is_missed(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in catalog.op4_compact_windows(spark, d).collect()}
    assert len(got) == len(rows)
    assert exact_runs(rows) <= {k for k, r in got.items() if r.n_repeated_words >= 50}
    left = [(r.doc_id, r.text) for r in compact_windows.without_passages(docs).collect()]
    assert not exact_runs(left) - {d for d, _ in left if got[d].n_passages}


def test_pipeline(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    step = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, d).cache()
        assert step.columns == docs.columns
        kept.append([(r.doc_id, r.text) for r in step.collect()])
    n = docs.count()
    assert len(kept[0]) > 0.97 * n
    assert len(kept[1]) > 0.7 * len(kept[0])
    assert {i for i, _ in kept[2]} == {i for i, v in near_copies(kept[1], 80).items() if v[2]}
    result = corpus_pipeline.run(spark, d).collect()
    check_packing(result, kept[3])
    assert {r.doc_id for r in result} == {i for i, _ in kept[3]}


def edited(rng, words_, kind):
    """One or two words changed, put in or left out."""
    out = list(words_)
    for _ in range(1 if len(out) < 90 else 2):
        p = rng.randrange(len(out))
        if kind == "changed":
            out[p] = f"e{rng.randrange(10**9)}"
        elif kind == "put in":
            out[p:p] = [f"e{rng.randrange(10**9)}" for _ in range(rng.choice((1, 2)))]
        else:
            del out[p : p + rng.choice((1, 2))]
    return out


def likeness(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def planted(rng, groups):
    """Documents of own words with one passage each; passages of a group are edits of one text, in any order. Also the
    pairs of documents whose passages are alike by 0.8 or more, by brute force."""
    rows, pairs, texts = [], {}, []
    for g in range(groups):
        base = words(rng, rng.randrange(52, 130))
        kinds = [None] + [rng.choice(("changed", "put in", "left out")) for _ in range(rng.choice((1, 2, 4)))]
        rng.shuffle(kinds)
        texts += [(g, kind, edited(rng, base, kind) if kind else base) for kind in kinds]
    order = list(range(len(texts)))
    rng.shuffle(order)
    for i, at in enumerate(order):
        own = words(rng, 160)
        own[60:60] = texts[at][2]
        rows.append((i, " ".join(own)))
    by_group = {}
    for i, at in enumerate(order):
        by_group.setdefault(texts[at][0], []).append((i, texts[at]))
    for held in by_group.values():
        for j, (b, y) in enumerate(held):
            for a, x in held[:j]:
                if min(len(x[2]), len(y[2])) >= 50 and likeness(x[2], y[2]) >= 0.8:
                    pairs[min(a, b), max(a, b)] = {x[1], y[1]} - {None}
    return rows, pairs


def test_recall_of_edited_passages(spark):
    """Of the pairs that brute force finds, nine in ten at least lie in one component; passages alone link documents."""
    rows, pairs = planted(random.Random(21), 250)
    got = {r.doc_id: r for r in compact_windows.op4_compact_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[a].component_id == got[b].component_id for a, b in pairs]
    print("pairs", len(pairs), "recall", sum(linked) / len(linked))
    for kind in ("changed", "put in", "left out"):
        of = [got[a].component_id == got[b].component_id for (a, b), k in pairs.items() if kind in k]
        print(kind, len(of), sum(of) / len(of))
        assert sum(of) >= 0.9 * len(of)
    assert sum(linked) >= 0.95 * len(linked)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    # Texts of a passage's documents outside it differ: components are no larger than likeness makes them, but for
    # stretches that reach a little past what was planted.
    wrong = [i for i, _ in rows if find(i) != got[i].component_id]
    assert len(wrong) <= 0.1 * len(rows)


def test_passages_of_frequent_lines(spark):
    """An equal passage of two lines, each of which is frequent for itself; and passages of more such lines."""
    rng = random.Random(22)
    lines = [words(rng, 30) for _ in range(40)]
    rows = [(i, " ".join(words(rng, 40) + lines[i % 40] + words(rng, 40))) for i in range(400)]
    want = {}
    for k in range(60):
        x, y = rng.sample(range(40), 2)
        for j in range(2):
            rows.append((1000 + 2 * k + j, " ".join(words(rng, 40) + lines[x] + lines[y] + words(rng, 40))))
        want[1001 + 2 * k] = 1000 + 2 * k
    got = {r.doc_id: r for r in compact_windows.op4_compact_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d].n_repeated_words >= 60 for d in want) >= 0.95 * len(want)
    assert exact_runs(rows) >= {d for d, r in got.items() if r.n_repeated_words}
    assert all(r.n_links == 0 for d, r in got.items() if d < 1000)


def test_all_pairs_of_near_passages_are_linked(spark, monkeypatch):
    """Each of 60 documents holds a passage with a word of its own changed, so each two are near (0.84), not equal."""
    rng = random.Random(31)
    passage = words(rng, 120)
    rows = []
    for i in range(60):
        own = list(passage)
        own[30 + i] = f"e{i}"
        rows.append((i, " ".join(words(rng, 40) + own + words(rng, 40))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 16):
        monkeypatch.setattr(compact_windows, "BLOCK", block, raising=False)
        got = compact_windows.op4_compact_windows(df).collect()
        assert sum(r.n_links for r in got) >= 0.99 * 60 * 59 and {r.component_id for r in got} == {0}


def test_a_passage_of_many_texts_meets_one_of_each_kind(spark):
    """Where only repeated words matter, pairs grow with the texts, not with their square, and the same words go."""
    rng = random.Random(61)
    word = lambda: f"w{rng.randrange(20_000)}"
    passage = [word() for _ in range(70)]
    docs = []
    for i in range(120):
        mid = list(passage)
        if i % 10 == 9:
            mid[rng.randrange(70)] = word()
        docs.append((i, " ".join([word() for _ in range(40 + i % 7)] + mid + [word() for _ in range(40)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = compact_windows.row_key(df)
    spans = []
    for every in (True, False):
        found, _ = compact_windows.passages(df, key, every)
        pairs, covered = set(), {}
        for r in found.collect():
            pairs.add((r.first, r.doc_id))
            covered.setdefault(r.doc_id, set()).update(range(r.begin, r.end + compact_windows.K))
        spans.append((len(pairs), covered))
    assert spans[0][1] == spans[1][1] and len(spans[0][1]) == 119
    # Two copies that differ from the passage in different words may not be near enough.
    assert spans[0][0] > 7000 > 120 * 20 > spans[1][0]


def test_only_texts_with_candidates_are_sent(spark):
    """None of the keys looked for is left out, few others stay, and a null text is no trouble."""
    df = spark.createDataFrame([(i, i % 3, f"text {i}" if i % 5 else None) for i in range(2000)], "doc_id long, text_hash long, text string")
    some = df.filter("doc_id % 10 = 0").select("doc_id", "text_hash")
    bits = compact_windows.flags(some.unionByName(some), "doc_id", "text_hash")
    got = {r.doc_id: r.text for r in compact_windows.flagged(df, bits, "doc_id", "text_hash").collect()}
    assert set(range(0, 2000, 10)) <= set(got) and len(got) < 220
    assert compact_windows.flagged(df, compact_windows.flags(some.limit(0), "doc_id"), "doc_id").count() == 0


def test_pairs_of_a_large_group_come_some_columns_at_a_time():
    """A group in which each two windows are alike: all pairs, once each, and never all at one time."""
    m = 700
    row, code = np.repeat(np.arange(m), 5), np.tile(np.arange(5), m)
    parts = list(compact_windows.alike(np.zeros(m, np.int64), np.zeros(m, np.int64), row, code, np.full(m, 4)))
    pairs = {(i, j) for a, b in parts for i, j in zip(a.tolist(), b.tolist())}
    assert pairs == {(i, j) for j in range(m) for i in range(j)} and sum(len(a) for a, _ in parts) == len(pairs)
    assert max(len(a) for a, _ in parts) <= 256 * m < len(pairs)


def covered_by(found):
    out = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.begin, r.end + compact_windows.K))
    return out


def test_different_near_copies_are_verified_only_where_they_may_add(spark):
    """Of a family of near copies, all different, later ones are given all that any earlier one gives them, by few of these."""
    rng = random.Random(71)
    passage = words(rng, 120)
    rows = []
    for i in range(60):
        own = list(passage)
        own[30 + i] = f"e{i}"
        rows.append((i, " ".join(words(rng, 40) + own + words(rng, 40))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every, some = (compact_windows.passages(df, compact_windows.row_key(df), x)[0].collect() for x in (True, False))
    assert covered_by(every) == covered_by(some) and len(covered_by(some)) == 59
    assert len({(r.first, r.doc_id) for r in every}) >= 0.99 * 60 * 59 / 2
    assert len({(r.first, r.doc_id) for r in some}) <= 3 * 60


def test_candidates_on_one_diagonal_are_one_row(spark):
    """Runs of one word have a window at each place, and each two of these meet: a row for each distance and hash, not for each two."""
    rng = random.Random(73)
    df = spark.createDataFrame([(i, " ".join(words(rng, 20) + ["x"] * (100 + 7 * i) + words(rng, 20))) for i in range(8)], "doc_id long, text string")
    rows = compact_windows.keyed(df)
    found = compact_windows.pair_windows(compact_windows.find_windows(rows)).filter("kind = 0")
    met = compact_windows.meet(compact_windows.around(found, compact_windows._texts(rows, False))).collect()
    assert 0 < len(met) <= compact_windows.HASHES * len({(r.first, r.doc_id, r.shift) for r in met})
    got = compact_windows.op4_compact_windows(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(7, 0)}


def test_what_is_in_reach_holds_all_that_is_found():
    """Against all stretches of plain hits, and against what is found in near copies with words put in, left out and repeated."""
    rng = np.random.default_rng(72)
    for _ in range(60):
        parts = [rng.random(int(rng.integers(1, 200))) < rng.choice([0.5, 0.75, 0.8, 0.9]) for _ in range(int(rng.integers(1, 4)))]
        hit, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        at, n = np.flatnonzero(hit), np.arange(int(hit.sum()))
        got = compact_windows.within_reach(hit, first, 100 * n - 80 * at, 100 * (n + 1) - 80 * (at + 1))
        want = np.zeros(len(hit), bool)
        for p, x in zip(first.tolist(), parts):
            sums, ends = np.concatenate([[0], np.cumsum(100 * x - 80)]), np.flatnonzero(x).tolist()
            for l, r in ((l, r) for l in ends for r in ends if r - l + 1 >= compact_windows.LEAST and sums[r + 1] >= sums[l]):
                want[p + l : p + r + 1] = True
        assert (got == want).all()
    for k in range(200):
        # A small alphabet, or runs of one word, in every second case: places are not sure then.
        base = rng.integers(1, 40 if k % 2 else 1 << 40, 150).astype(np.uint64)
        if k % 4 == 3:
            base = np.repeat(base[:5], 30)
        theirs = base.copy()
        for p in rng.integers(0, 150, rng.integers(0, 12)).tolist():
            theirs = np.concatenate([theirs[:p], rng.integers(1 << 41, 1 << 42, int(rng.integers(0, 3))).astype(np.uint64), theirs[p + 1 :]])
        for shift in (0, 3, -5):
            found = np.zeros(len(base), bool)
            for l, r in compact_windows.passages_of(base, theirs, shift):
                found[l : r + 1] = True
            known = (*np.unique(theirs, return_index=True, return_inverse=True, return_counts=True), compact_windows.apart(theirs))
            # A part before it, so that places are counted over parts.
            reach, first = compact_windows._reach([base[:70], base], [compact_windows.apart(base)[:71], compact_windows.apart(base)], known)
            assert not (found & ~reach[first[1] :]).any()


def test_near_passages_go_whatever_stands_between(spark):
    """The later one of two near passages goes, with parts of it, too short for passages, in documents before each of them."""
    rng = random.Random(32)
    rows = []
    for k in range(30):
        p = words(rng, 110)
        parts = [p[i : i + 43] for i in (0, 10, 20, 30, 40, 50, 60, 67)]
        held = [*parts, p, *parts, [*p[:55], "x", *p[56:]]]
        rows += [(18 * k + j, " ".join(words(rng, 30) + q + words(rng, 30))) for j, q in enumerate(held)]
    kept = {r.doc_id: len(r.text.split()) for r in compact_windows.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[i] == len(t.split()) for i, t in rows if i % 18 < 17)
    assert sum(kept[18 * k + 17] <= 75 for k in range(30)) >= 29


def counted(sets, need):
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= max(need[i], need[j])}


def test_windows_in_common_are_all_counted(monkeypatch):
    """Small and large groups, rare and frequent shingles, and groups of two blocks, against plain sets."""
    rng = random.Random(33)
    monkeypatch.setattr(compact_windows, "SMALL", 8)
    monkeypatch.setattr(compact_windows, "RARE", 6)
    group, block, sets = [], [], []
    for g, (m, two) in enumerate([(2, False), (8, False), (40, False), (30, True), (3, False), (1, False)]):
        group += [g] * m
        block += [2 if two and i >= 20 else 1 for i in range(m)]
        sets += [set(rng.sample(range(5), 3)) | set(rng.sample(range(5, 60), 12)) for _ in range(m)]
    need = np.array([rng.randrange(2, 8) for _ in sets])
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    code = np.array([c for x in sets for c in sorted(x)])
    got = [(i, j) for a, b in compact_windows.alike(np.array(group), np.array(block), row, code, need) for i, j in zip(a.tolist(), b.tolist())]
    want = {(i, j) for i, j in counted(sets, need) if group[i] == group[j] and (group[i] != 3 or block[i] != block[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_passages_of_rows_without_an_id_of_their_own(spark):
    rng = random.Random(23)
    p, a, b = words(rng, 70), words(rng, 100), words(rng, 90)
    rows = [(1, " ".join(p)), (5, " ".join(a + p)), (5, "a b"), (None, " ".join(b + p)), (None, " ".join(b)), (None, None), (7, " ".join(words(rng, 300)))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int")
    got = compact_windows.op4_compact_windows(df).collect()
    assert len(got) == len(rows) and sum(r.n_repeated_words for r in got) == 70 + 70 + 90
    assert {r.component_id for r in got if r.doc_id == 5 and r.n_words > 2} == {1}
    kept = compact_windows.without_passages(df).collect()
    left = " ".join(r.text or "" for r in kept).split()
    # Each passage is left once, in one of its rows.
    assert sorted(left) == sorted(p + a + b + ["a", "b"] + rows[6][1].split())


def plain_quality(rows):
    """(doc_id, text) of the rows (doc_id, text, source) that the quality stage keeps, in plain Python."""
    held, by_line, hosts = [], {}, {}
    for d, text, host in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        lines = [(re.sub("[\x20\x09-\x0d]+", " ", x.lower()).strip(" "), x) for x in text.split("\n")]
        held.append((d, text, host, failed, lines))
        hosts.setdefault(host, set()).add(text)
        for norm, raw in lines:
            if re.search("[^\x20\x09-\x0d]", raw):
                by_line.setdefault((host, norm), []).append((d, text, failed))
    above = {}
    for (host, norm), docs in by_line.items():
        n = len({t for _, t, _ in docs})
        if n > 20 and n > 0.05 * len(hosts[host]):
            above[host, norm] = min((d for d, _, f in docs if not f), default=min(d for d, _, _ in docs))
    out = []
    for d, text, host, failed, lines in held:
        real = [(n, x) for n, x in lines if re.search("[^\x20\x09-\x0d]", x)]
        gone = {n for n, _ in real if above.get((host, n), d) != d}
        total = sum(len(x) for _, x in real)
        removed = sum(len(x) for n, x in real if n in gone)
        if not failed and not total - removed < 0.5 * total:
            out.append((d, "\n".join(x for n, x in lines if n not in gone or not re.search("[^\x20\x09-\x0d]", x)) if gone else text))
    return out


def test_first_stages_match_plain_versions(spark):
    from strandlake.llm import language_id
    from tests.llm.test_quality_and_language import plain_fusion

    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    # Lines that are frequent in one host, so that some go.
    docs = docs.withColumn("text", F.when(F.col("source") == "src0", F.concat(F.lit("Qzx this page\n"), "text", F.lit("\n  qzx THIS\tpage"))).otherwise(F.col("text")))
    labelled = docs.select(F.col("lang").alias("label"), "text")
    models = language_id.fit(labelled, half=1), language_id.fit(labelled, half=0)
    scored = language_id.scores(docs, models, "lang", "source").collect()
    known = {i for i, name, share in plain_fusion(scored) if name != "und" and share >= language_id.MIN_POSTERIOR}
    first = language_id.keep_known(docs)
    rows = first.collect()
    assert {r.doc_id for r in rows} == known
    want = plain_quality([(r.doc_id, r.text, r.source) for r in rows])
    got = [(r.doc_id, r.text) for r in quality_rules.keep_good(first).collect()]
    assert sorted(got) == sorted(want) and sum("Qzx this page" in (t or "") for _, t in want) == 1


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty, long and repeated rows, one doc_id for two texts, columns with clashing names, and no rows at all."""
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    some = docs.filter("lang = 'en' AND n_chars > 2000").orderBy("doc_id").limit(3)
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "src0", 0), (5001, None, "en", None, 0), (None, "  \n", "xx", "src1", 4), (5002, "a b c", "en", "src1", 5)], docs.schema)
    nameless = some.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" one more")))
    long = some.limit(1).withColumn("doc_id", F.lit(7000).cast("long")).withColumn("text", F.concat_ws(" ", *[F.col("text")] * 200))
    other = some.limit(1).withColumn("text", F.reverse("text"))
    rows = docs.unionByName(odd).unionByName(nameless).unionByName(some).unionByName(long).unionByName(other)
    for c in ("host", "component", "_gone", "row_id", "begin", "key"):
        rows = rows.withColumn(c, F.lit("x"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    step = held
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path)).cache()
        assert step.columns == held.columns, name
        assert not {5000, 5001, 5002, 7000} & {r.doc_id for r in step.select("doc_id").collect()} or name == "language ID"
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(r.doc_id, r.text) for r in step.collect()]
    assert len({r.doc_id for r in result}) == len({i for i, _ in left}) > 50
    assert sum(r.length for r in result) == sum(r.doc_tokens for r in result if r.start == 0)
    held.filter(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
