"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import shared
from ..shared import fresh_path, shared_dir  # noqa: F401

#: Characters that separate words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's default bound of an Arrow batch, and the one used here instead: a task holds a batch in the JVM and in Python.
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "8m"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has a bound of its own."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, with bounded batches."""
    small_batches(df.sparkSession)
    return shared.written(df, name)


def text_of(column: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Stands for a null doc_id where ids are compared; it comes before all others.
NO_ID = -(1 << 63)


def text_hash(column: str = "text") -> Column:
    """Tells the texts of rows with one doc_id apart (a null text: empty)."""
    return F.xxhash64(text_of(column), F.char_length(text_of(column)))


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """A row's own key: doc_id (NO_ID for null) and a hash of its text, 0 throughout where doc_ids tell all rows apart
    (one look at that column), as that weighs nothing in shuffles. Rows that are equal in both are equal."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    apart = ids.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty()
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.lit(0).cast("long") if apart else text_hash()


def keyed(docs: DataFrame, key: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, text_hash, text): a row's own key and its text (null: empty)."""
    doc_id, told = key or row_key(docs)
    return docs.select(doc_id.alias("doc_id"), told.alias("text_hash"), text_of().alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that split the column's rows about evenly: what comes to the
    driver grows with the number of parts alone."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * parts))).first()[0]
    return sorted(set(found or []))


def bucket_of(value: Column, points: list[int]) -> Column:
    """How many of the rising points lie below the value: binary search in an array of constants."""
    if not points:
        return F.lit(0)
    held = F.array(*[F.lit(p).cast("long") for p in points])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < value, at + step).otherwise(at))


def zipped(rows: DataFrame) -> DataFrame:
    """The rows with their last column, a text, as a zstandard frame: what texts weigh in a shuffle."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        code = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], pa.array([code.compress(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())], batch.schema.names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{rows.columns[-1]}` binary"]))


def expanded(frame: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(frame).decode()
