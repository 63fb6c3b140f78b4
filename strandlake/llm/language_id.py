"""Language identification by Bayesian evidence fusion.

Text: byte trigrams (A-Z lower-cased) under each language's smoothed counts, fitted on a bounded sample of
labelled rows. Declared language (markup), address suffix: their frequencies given the language, from
counts over the whole corpus. Two text models are fitted, each on one half of the texts (by hash), and score the other
half: so what a row declares never enters its own text likelihood, and its declared language is evidence of its own. Host: its languages, smoothed towards its suffix's, and those towards the
corpus's. All counts are grouped sums of what the text alone says, so hosts and suffixes are learnt
without labels. The sum of logarithms gives the posterior; a language `und`, under which all trigrams
are equally likely, takes texts that fit no language.

A null or empty text has no evidence of its own: it is `und` and rejected. A null declared language or
address is a value like any other. Rows are independent; repeated rows get equal results. Texts of any length count
whole. An empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_hash, text_of, written

#: Trigrams fall into so many cells.
CELLS = 1 << 15
#: Labelled rows to a language that the text model is fitted on, about; the bound of the fit.
SAMPLE = 1500
LANGUAGES = ("de", "en", "es", "fr")
#: Overlapping trigrams repeat evidence: each counts a third.
WEIGHT = 1 / 3
#: Rows that a parent's distribution counts as, in hosts and suffixes.
STRENGTH = 20.0
MIN_POSTERIOR = 0.65
#: A table of group counts is broadcast if it has no more rows than this; beyond, its join is salted.
BROADCAST_ROWS, SALTS = 50_000, 16
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
MULTIPLIER = np.uint32(2654435761)


def cells(text: bytes) -> np.ndarray:
    """The cell of each trigram of a text with a space before and after."""
    b = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    return ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * MULTIPLIER) >> np.uint32(17)


def half_of(text: Column) -> Column:
    """0 or 1, by the text."""
    return F.pmod(F.xxhash64(text, F.lit(2)), F.lit(2))


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE, half: int | None = None) -> np.ndarray:
    """Log-likelihoods [cell, language and `und`] from columns text and label. Rows are taken by a hash of
    their text, about `sample` to a language (all of them where there are fewer), and counted where they
    lie; only counts by cell come to the driver: at most cells times languages. half: takes these texts alone."""
    rows = labelled.select(F.col("label").cast("string").alias("label"), text_of().alias("text")).filter(F.col("label").isin(*languages) & (F.col("text") != ""))
    if half is not None:
        rows = rows.filter(half_of(F.col("text")) == half)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    scale = 1 << 30
    share = F.lit(0)
    for name, size in sizes.items():
        share = F.when(F.col("label") == name, min(scale, scale * sample // max(size, 1))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < share)

    def count(batches):
        table = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[languages.index(label)] += np.bincount(cells(text.encode()), minlength=CELLS)
        which, cell = np.nonzero(table)
        yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(table[which, cell])], ["language", "cell", "n"])

    counts = np.full((CELLS, len(languages)), 0.05)
    for r in chosen.mapInArrow(count, "language int, cell int, n long").groupBy("language", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell, r.language] += r.n
    logs = np.log(counts / counts.sum(0))
    return np.concatenate([logs, np.full((CELLS, 1), -math.log(CELLS))], 1).astype(np.float32)


def suffix_of(address: Column) -> Column:
    """The last label of a URL's or host's name; none: empty."""
    host = F.regexp_extract(F.lower(address), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1)
    return F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def host_of(address: Column) -> Column:
    return F.regexp_extract(F.lower(address), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1)


def scores(docs: DataFrame, model: np.ndarray | tuple[np.ndarray, np.ndarray], declared: str, address: str) -> DataFrame:
    """(doc_id, text_hash, declared, host, suffix, n_trigrams, logs): weighted log-likelihoods of each text. Of two models,
    the first is for the texts of half 0."""
    models = model if isinstance(model, tuple) else (model, model)

    def run(batches):
        for batch in batches:
            logs, sizes = [], []
            for half, text in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                at = cells(text.encode()) if text.strip() else np.zeros(0, np.uint32)
                logs.append((models[half][at].sum(0, dtype=np.float64) * WEIGHT).tolist())
                sizes.append(len(at))
            yield pa.record_batch([*batch.columns[:-2], pa.array(sizes, pa.int64()), pa.array(logs, pa.list_(pa.float64()))], [*batch.schema.names[:-2], "n_trigrams", "logs"])

    at = F.coalesce(F.col(address).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.coalesce(F.lower(F.col(declared).cast("string")), F.lit("")).alias("declared"), host_of(at).alias("host"), suffix_of(at).alias("suffix"), half_of(text_of()).cast("int").alias("half"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, declared string, host string, suffix string, n_trigrams long, logs array<double>")


def _shares(n: int, name: str) -> list[Column]:
    return [F.sum(F.get("p", F.lit(i))).alias(f"{name}_{i}") for i in range(n)]


def looked_up(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Rows with their group's counts: by broadcast where a look at the table shows that it is small, else with the rows of
    a group dealt over salted copies of its counts."""
    counts = written(counts, f"by-{key}")
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts), key)
    salted = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def fuse(scored: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Posteriors from a table of scores (read more than once: let it be written)."""
    k = len(languages) + 1
    top = F.array_max("logs")
    raw = F.transform("logs", lambda x: F.exp(x - top))
    soft = scored.withColumn("raw", raw).withColumn("p", F.when(F.col("n_trigrams") > 0, F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, y: a + y))).otherwise(F.array(*[F.lit(0.0)] * k))).drop("raw")
    # Grouped sums of soft counts: partial sums before the shuffle, a row for each group after it.
    total = soft.agg(*_shares(k, "t"))
    by_suffix, by_host, by_declared = (soft.groupBy(c).agg(*_shares(k, c[0])) for c in ("suffix", "host", "declared"))
    n_declared, n_suffix = (soft.agg(F.count_distinct(c).alias(f"n_{c}")) for c in ("declared", "suffix"))
    joined = looked_up(looked_up(looked_up(soft, by_suffix, "suffix"), by_host, "host"), by_declared, "declared")
    # One row each: the corpus's own figures.
    for one in (total, n_declared, n_suffix):
        joined = joined.join(F.broadcast(one), F.lit(True))
    sum_of = lambda name: sum((F.col(f"{name}_{i}") for i in range(1, k)), F.col(f"{name}_0"))
    names = [*languages, "und"]
    evidence = []
    for i in range(k):
        corpus = (F.col(f"t_{i}") + 0.5) / (sum_of("t") + 0.5 * k)
        in_suffix = (F.col(f"s_{i}") + STRENGTH * corpus) / (sum_of("s") + STRENGTH)
        in_host = (F.col(f"h_{i}") + STRENGTH * in_suffix) / (sum_of("h") + STRENGTH)
        # P(declared | language); the suffix enters through the host's prior, where it is the parent.
        tag = (F.col(f"d_{i}") + 1.0) / (F.col(f"t_{i}") + F.col("n_declared"))
        evidence.append(F.get("logs", F.lit(i)) + F.log(in_host) + F.log(tag))
    summed = joined.withColumn("e", F.array(*evidence))
    best = F.array_max("e")
    norm = F.aggregate(F.transform("e", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, y: a + y)
    place = F.array_position("e", best).cast("int")
    named = F.array(*map(F.lit, names))
    empty = F.col("n_trigrams") == 0
    return summed.select("doc_id", "text_hash", "host", "declared", "n_trigrams", F.when(empty, "und").otherwise(F.get(named, place - 1)).alias("language"), F.round(F.when(empty, 0.0).otherwise(1 / norm), 6).alias("posterior"))


def identify(docs: DataFrame, declared: str = "lang", address: str = "source", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Fits, scores and fuses: language, posterior and verdict of each row."""
    labelled = docs.select(F.col(declared).alias("label"), "text")
    model = fit(labelled, languages, half=1), fit(labelled, languages, half=0)
    fused = fuse(written(scores(docs, model, declared, address), "scores"), languages)
    return fused.withColumn("kept", (F.col("language") != "und") & (F.col("posterior") >= MIN_POSTERIOR))


def op8_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", "declared", "language", "posterior", "n_trigrams", "kept")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, whose language is sure."""
    bad = identify(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("b_doc"), F.col("text_hash").alias("b_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("b_doc")) & (text_hash() == F.col("b_text"))
    return docs.join(bad, same, "left_anti")
