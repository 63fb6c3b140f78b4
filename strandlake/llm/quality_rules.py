r"""Quality rules with cross-document line frequency. DataFrame functions only: no Python runs on executors.

Each text is read once: its base figures and its lines' hashes and lengths are written as one table, from which all
else is grouped and joined. Normalised lines (lower case, runs of white space as one space, trimmed) are hashed, and
the distinct documents of a host that hold a line are counted, exact copies of a text as one. A line in more than
`min_docs` documents and `share` of its host's documents is above the limit: it goes from every document but the first
(smallest doc_id) of the host. A document that keeps less than `least` of its lines' characters is depleted, and
rejected. op5_quality_rules counts what goes; keep_good also takes these lines out of the texts, and its first document
is the first that passes the base rules, so that a line isn't left to a text that is rejected anyway.

A null or empty text has no words: it fails. A null host is a host of its own. A null doc_id comes after all others when
the first document is looked for. Repeated rows are rows of their own with equal results. A text of any length is
worked on whole. An empty table gives no rows. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_hash, text_of, written

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
#: Runs of white space in a line that are not one space already.
UNEVEN_SPACES = r"\x20[\x20\x09\x0B-\x0D]+|[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50
MIN_DOCS, SHARE, LEAST = 20, 0.05, 0.5
#: A window's place is kept in so many low bits of its hash, in texts of fewer words than these bits can number.
PLACE_BITS = 16
PLACES = (1 << PLACE_BITS) - 1


def with_repeat_words(split: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows found twice or more. Where all windows differ, nothing is
    sorted. Else equal windows stand side by side once sorted, each with its place: in the low bits of its hash, or, in
    a text of 65,535 words or more, beside the whole hash. Each step is a column of its own, so none runs twice."""
    n = F.greatest(F.size("words") - 2, F.lit(0))
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    hashed = split.withColumn("hashes", F.slice(F.transform("words", window), F.lit(1), n))
    some = hashed.withColumn("repeats", F.size(F.array_distinct("hashes")) < F.size("hashes")).withColumn("long", F.size("hashes") >= PLACES)
    packed = F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long"))))
    apart = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
    placed = some.withColumn("packed", F.when(F.col("repeats") & ~F.col("long"), packed)).withColumn("apart", F.when(F.col("repeats") & F.col("long"), apart))
    same = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(~PLACES)) == 0, F.lit(False))
    few = F.filter("packed", lambda x, i: same(x, F.get("packed", i + 1)) | same(x, F.get("packed", i - 1)))
    alike = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    many = F.filter("apart", lambda x, i: alike(x, F.get("apart", i + 1)) | alike(x, F.get("apart", i - 1)))
    found = placed.withColumn("places", F.sort_array(F.coalesce(F.transform(few, lambda x: x.bitwiseAND(F.lit(PLACES))), F.transform(many, lambda x: x["p"]))))
    gaps = F.transform("places", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("places", i + 1) - p, F.lit(3).cast("long"))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hashes", "repeats", "long", "packed", "apart", "places")


def figures(docs: DataFrame) -> DataFrame:
    """A row of `row_id`, doc_id, host, text_hash, the base figures and `lines` (hash and characters of each line with a
    word) for each row of `docs`. Row ids hold once the table is written."""
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text_of().alias("text"))
    split = base.select(
        "row_id", "doc_id", "host", F.xxhash64("text", F.char_length("text")).alias("text_hash"),
        F.array_remove(F.split("text", SPACES), "").alias("words"),
        F.split("text", "\n").alias("raw"),
        F.split(F.regexp_replace(F.lower("text"), UNEVEN_SPACES, " "), "\n").alias("normal"),
        (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
    )
    line = lambda x, i: F.struct(F.xxhash64(F.trim(F.get("normal", i))).alias("line"), F.char_length(x).alias("chars"), x.rlike(NO_SPACE).alias("worded"))
    worded = split.select("*", F.filter("raw", lambda x: x.rlike(NO_SPACE)).alias("kept_lines"), F.transform("raw", line).alias("hashed"))
    return with_repeat_words(worded).select(
        "row_id", "doc_id", "host", "text_hash", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("kept_lines") - F.size(F.array_distinct("kept_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform(F.filter("hashed", lambda x: x["worded"]), lambda x: x.dropFields("worded")).alias("lines"),
    )


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def line_verdicts(held: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least: float = LEAST, passed_first: bool = False) -> DataFrame:
    """(row_id, removed_chars, gone, depleted) of each row of `held` (figures, as a table) that has a line above the
    limits and isn't the first to have it; gone has the hashes of these lines. passed_first: a line's first document is
    the first that passes the base rules, if one does."""
    lines = held.select("row_id", "doc_id", "host", "text_hash", base_failed().alias("failed"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("line_chars"), F.inline("lines"))
    # Exact copies count as one document: first one row for each text, then texts are counted.
    texts = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.min(F.when(~F.col("failed"), F.col("doc_id"))).alias("passed_doc"))
    first = F.coalesce(F.min("passed_doc"), F.min("doc_id")) if passed_first else F.min("doc_id")
    spread = texts.groupBy("host", "line").agg(F.count("*").alias("n_docs"), first.alias("first_doc")).filter(F.col("n_docs") > min_docs)
    hosts = held.select("host", "text_hash").distinct().groupBy(F.col("host").alias("h_host")).agg(F.count("*").alias("host_docs"))
    often = spread.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    above = often.filter(F.col("n_docs") > share * F.col("host_docs")).select(F.col("host").alias("a_host"), F.col("line").alias("a_line"), "first_doc")
    marked = lines.join(above, (F.col("line") == F.col("a_line")) & F.col("host").eqNullSafe(F.col("a_host"))).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    totals = marked.groupBy("row_id", "line_chars").agg(F.sum("chars").alias("removed_chars"), F.collect_set("line").alias("gone"))
    return totals.select("row_id", "removed_chars", "gone", (F.col("line_chars") - F.col("removed_chars") < least * F.col("line_chars")).alias("depleted"))


def quality(docs: DataFrame, **limits: float) -> DataFrame:
    """All figures and the verdict of each row of `docs`."""
    held = written(figures(docs), "figures")
    verdicts = line_verdicts(held, **limits).drop("gone")
    joined = held.drop("lines").withColumn("base_failed", base_failed()).join(verdicts, "row_id", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    return joined.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.coalesce("removed_chars", F.lit(0)).cast("long").alias("removed_chars"))


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    return quality(docs).drop("host", "text_hash")


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of `docs` that pass, less the lines above the limits (but in their first document); n_chars is counted
    anew where lines went and there is such a column. Other rows are unchanged."""
    held = written(figures(docs), "figures")
    verdicts = line_verdicts(held, passed_first=True, **limits).select(F.col("row_id").alias("v_row"), "depleted", "gone")
    joined = held.drop("lines").join(verdicts, F.col("row_id") == F.col("v_row"), "left").filter(base_failed() | F.col("v_row").isNotNull())
    bad = base_failed() | F.coalesce("depleted", F.lit(False))
    # Equal rows have equal verdicts: one mark stands for all of them.
    marks = joined.groupBy("doc_id", "host", "text_hash").agg(F.max(bad).alias("_bad"), F.first("gone", ignorenulls=True).alias("_gone"))
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), "_bad", F.when(~F.col("_bad"), F.col("_gone")).alias("_gone"))
    names = docs.columns
    ours = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"), text_hash().alias("_t"))
    same = F.col("_d").eqNullSafe(F.col("_doc")) & F.col("_s").eqNullSafe(F.col("_host")) & (F.col("_t") == F.col("_hash"))
    kept = ours.join(marks, same, "left").filter(~F.coalesce("_bad", F.lit(False)))
    old = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    stays = lambda x: ~x.rlike(NO_SPACE) | ~F.array_contains("_gone", F.xxhash64(normal(x)))
    cut = F.coalesce(F.size("_gone") > 0, F.lit(False))
    kept = kept.withColumn("_text", F.when(cut, F.array_join(F.filter(F.split(old, "\n"), stays), "\n")).otherwise(F.col("_row.text").cast("string")))
    columns = {"text": F.col("_text").cast(docs.schema["text"].dataType)}
    if "n_chars" in names:
        columns["n_chars"] = F.when(cut, F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return kept.select(*[columns[c].alias(c) if c in columns else F.col("_row").getField(c).alias(c) for c in names])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM g WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE twice) GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT * FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM lw GROUP BY r),
n AS (SELECT r, doc_id, host, text, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, sum(length(l)) AS chars FROM lw GROUP BY ALL),
s AS (SELECT host, line, count(DISTINCT text) AS n_docs, min(doc_id) AS first_doc FROM n GROUP BY host, line),
h AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
a AS (SELECT s.* FROM s JOIN h ON s.host IS NOT DISTINCT FROM h.host WHERE n_docs > 20 AND n_docs > 0.05 * host_docs),
v AS (SELECT r, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (a.line IS NOT NULL AND n.doc_id IS DISTINCT FROM a.first_doc), 0) AS removed FROM n LEFT JOIN a ON n.line = a.line AND n.host IS NOT DISTINCT FROM a.host GROUP BY r),
f AS (SELECT d.r, d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed_chars, coalesce(line_chars - removed < 0.5 * line_chars, false) AS depleted
  FROM d LEFT JOIN wc USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN v USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept, removed_chars FROM f
"""
