import duckdb
from pyspark.sql import functions as F

from strandlake.llm import catalog, language_id, quality_rules


def by_sql(table, columns):
    con = duckdb.connect()
    con.register("documents", table) if not isinstance(table, str) else con.execute(f"CREATE VIEW documents AS SELECT * FROM '{table}'")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({quality_rules.ORACLE})").fetchall()


def same(rows, want):
    return sorted(map(tuple, rows), key=repr) == sorted(map(tuple, want), key=repr)


def test_quality_matches_sql(spark, sf_dir):
    got = catalog.op5_quality_rules(spark, sf_dir)
    assert same(got.collect(), by_sql(f"{sf_dir}/documents.parquet", got.columns))


def test_quality_of_odd_rows(spark):
    menu, body = "Home | About | Contact us today", "a b c d e f g h i j k l m n o p q r s t u v w x y z "
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{menu}\n{own(i)}", "h") for i in range(30)] + [(100 + i, "\n".join([menu] * 20 + [own(i)[:40]] + [f"{i} {k} word" for k in range(9)]), "h") for i in range(30)]
    rows += [(900, None, "h"), (901, "", None), (None, body * 3, None), (902, body * 3, None), (902, body * 3, None), (903, "x " * 30000, "long"), (904, "é#*\t\v\f\r\n" * 60, "h"), (905, "# a\n\n# a\n#  A", "h")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, line int")
    got = quality_rules.op5_quality_rules(df)
    assert same(got.collect(), by_sql(df.toPandas(), got.columns))
    kept = {r.doc_id for r in got.collect() if r.kept}
    assert set(range(30)) <= kept and not kept & set(range(101, 130))
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == kept
    assert quality_rules.op5_quality_rules(df.filter(F.lit(False))).collect() == []


def test_lines_above_the_limits_go_from_the_texts(spark):
    menu = "Home |  About | Contact us today"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(0, f"{menu}\nshort", "h", 7)] + [(i, f"{own(i)}\n\n{menu.upper() if i % 2 else menu}\nend {i}", "h", 7) for i in range(1, 30)] + [(50, f"{own(50)}\n{menu}", "other", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = quality_rules.keep_good(df)
    assert kept.schema == df.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    # The short first document is rejected: the line stays in the next, and in the other host.
    want = {r[0]: (r[1], 7) for r in rows if r[0] in (1, 50)} | {i: (t := f"{own(i)}\n\nend {i}", len(t)) for i in range(2, 30)}
    assert got == want


def test_language_by_text_alone_is_right_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0").select(F.col("lang").alias("label"), "text"))
    held = docs.filter("doc_id % 2 = 1").withColumn("none", F.lit(None).cast("string"))
    rows = language_id.scores(held, model, "lang", "none").collect()
    names = [*language_id.LANGUAGES, "und"]
    right = sum(names[max(range(5), key=lambda i: r.logs[i])] == r.declared for r in rows)
    assert right >= 0.97 * len(rows)


def test_language_of_odd_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(9001, None, "en", "src1"), (9002, " \n", None, None), (None, "\x01\x02\x03" * 500, "xx", "src1"), (9004, docs.first().text, "de", "http://a.example.fr/x")], docs.schema)
    both = docs.unionByName(odd).unionByName(docs.limit(2)).withColumn("host", F.lit("clash"))
    rows = language_id.op8_language_id(both).collect()
    assert len(rows) == both.count()
    by = {r.doc_id: r for r in rows}
    assert [by[k].kept for k in (9001, 9002, None)] == [False] * 3 and by[9004].language == docs.first().lang
    assert sum(r.kept for r in rows) > 0.98 * docs.count()
    assert sum(r.language == r.declared for r in rows) > 0.98 * len(rows)
    kept = language_id.keep_known(both)
    assert kept.count() == sum(r.kept for r in rows) and kept.columns == both.columns
    assert language_id.op8_language_id(both.filter(F.lit(False))).collect() == []


def test_addresses(spark):
    rows = spark.createDataFrame([("https://Www.Site.FR/x?y",), ("site.co.uk:80",), ("src0",), ("",)], "a string").select(language_id.host_of(F.col("a")), language_id.suffix_of(F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [("www.site.fr", "fr"), ("site.co.uk", "uk"), ("src0", ""), ("", "")]


def plain_figures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = __import__("collections").Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(covered)


def test_long_texts_keep_hash_and_place_apart(spark):
    """Texts about the number of places that a hash's low bits hold, with few and with many repeats."""
    n = quality_rules.PLACES
    distinct = lambda k: [f"w{i}" for i in range(k)]
    texts = [" ".join(distinct(n + d) + ["w5", "w6", "w7"] * r) for d in (-3, -2, -1, 0, 1, 2, 3, 5000) for r in (0, 1, 2)] + ["a b c " * 40000, "", None, "a b", "a b c", "a b c a b c"]
    df = spark.createDataFrame([(i, t, "h", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) for r in quality_rules.op5_quality_rules(df).collect()}
    assert got == {i: plain_figures(t) for i, t in enumerate(texts)}


def test_repeated_rows_count_their_own_lines_once(spark):
    menu = "Home | About | Contact us today"
    rows = [(i, f"{menu}\n{' '.join(f'w{i}x{k}' for k in range(60))}", "h") for i in range(30)]
    df = spark.createDataFrame(rows + rows[3:6] + rows[3:5], "doc_id long, text string, source string")
    got = quality_rules.op5_quality_rules(df)
    assert same(got.collect(), by_sql(df.toPandas(), got.columns))
    assert {r.removed_chars for r in got.collect() if r.doc_id} == {len(menu)}


def plain_fusion(rows):
    """The posterior of each scored row in plain Python, from the same sums."""
    import math
    from collections import defaultdict

    k = len(language_id.LANGUAGES) + 1
    soft = []
    for r in rows:
        top = max(r.logs)
        raw = [math.exp(x - top) for x in r.logs]
        soft.append([x / sum(raw) for x in raw] if r.n_trigrams else [0.0] * k)
    sums = {c: defaultdict(lambda: [0.0] * k) for c in ("suffix", "host", "declared")}
    total = [sum(p[i] for p in soft) for i in range(k)]
    for r, p in zip(rows, soft):
        for c, held in sums.items():
            held[r[c]] = [a + b for a, b in zip(held[r[c]], p)]
    out = []
    for r in rows:
        s, h, d = (sums[c][r[c]] for c in ("suffix", "host", "declared"))
        corpus = [(t + 0.5) / (sum(total) + 0.5 * k) for t in total]
        in_suffix = [(x + language_id.STRENGTH * c) / (sum(s) + language_id.STRENGTH) for x, c in zip(s, corpus)]
        in_host = [(x + language_id.STRENGTH * c) / (sum(h) + language_id.STRENGTH) for x, c in zip(h, in_suffix)]
        tag = [(x + 1) / (t + len(sums["declared"])) for x, t in zip(d, total)]
        e = [x + math.log(a) + math.log(b) for x, a, b in zip(r.logs, in_host, tag)]
        best = max(e)
        share = 1 / sum(math.exp(x - best) for x in e)
        out.append((r.doc_id, [*language_id.LANGUAGES, "und"][e.index(best)] if r.n_trigrams else "und", share if r.n_trigrams else 0.0))
    return out


def test_fusion_matches_a_plain_version(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    address = F.concat(F.lit("http://"), "source", F.when(F.col("doc_id") % 3 == 0, ".example.fr").when(F.col("doc_id") % 3 == 1, ".example.de/x").otherwise(""))
    docs = docs.withColumn("source", address).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "en").otherwise(F.col("lang")))
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2))
    labelled = docs.select(F.col("lang").alias("label"), "text")
    models = language_id.fit(labelled, half=1), language_id.fit(labelled, half=0)
    scored = language_id.written(language_id.scores(docs, models, "lang", "source"), "scores")
    want = sorted(plain_fusion(scored.collect()), key=repr)
    for rows in (language_id.BROADCAST_ROWS, 2):
        # The second time each table is too large to be broadcast.
        monkeypatch.setattr(language_id, "BROADCAST_ROWS", rows)
        got = sorted(((r.doc_id, r.language, r.posterior) for r in language_id.fuse(scored).collect()), key=repr)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_a_text_is_scored_by_the_model_that_has_not_seen_it(spark):
    """Rows that alone hold a language's words declare another one: their texts still speak for what others say."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = docs.filter("lang = 'fr'").orderBy("doc_id").limit(1).withColumn("lang", F.lit("de"))
    both = docs.join(one.select("doc_id"), "doc_id", "left_anti").unionByName(one)
    found = {r.doc_id: r for r in language_id.op8_language_id(both).collect()}
    assert found[one.first().doc_id].language == "fr"
