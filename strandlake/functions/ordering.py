"""Dense positions without a window over a whole key: local positions in ranges plus prefix sums of range counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def range_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that split the rows about evenly."""
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def range_of(value: Column, points: list[int]) -> Column:
    """How many points lie below the value, by binary search."""
    if not points:
        return F.lit(0)
    held = F.array(*[F.lit(p).cast("long") for p in points])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < value, at + step).otherwise(at))


def _with_before(local: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """local with `_before` of its keys (null ones too) and range. The sums' columns get names of their own: Spark 4.1
    otherwise pushes a filter on the result into them in a form that it can't run."""
    own = before.select(*[F.col(k).alias(f"_own_{k}") for k in keys], F.col("_range").alias("_own_range"), "_before")
    same = F.col("_range") == F.col("_own_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_own_{k}"))
    return local.join(own, same).drop("_own_range", *[f"_own_{k}" for k in keys])


def positioned(df: DataFrame, keys: list[str], order: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds `name`, the row's position from 1 within `keys` by the number column `order`. A key with any share of
    the rows is spread over ranges of `order`; a range's offset is the sum of the key's counts in the ranges before."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_range", range_of(F.col(order), range_points(df, order, parts)))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)))
    return _with_before(local, before, keys).withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_range", "_local", "_before")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, backwards: bool = False, bits: int = 14) -> DataFrame:
    """Adds `name`, the sum of `value` up to and with the row within `keys` by `order`, dense positions or sequences (from
    the end if backwards). No key's rows lie in one window: they are dealt by ranges of 2 to the power `bits` positions."""
    ranged = df.withColumn("_range", F.shiftright(order, bits))
    by = F.desc if backwards else F.asc
    whole = Window.partitionBy(*keys).orderBy(by("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(whole), F.lit(0))).drop("_sum")
    local = ranged.withColumn("_local", F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)))
    return _with_before(local, before, keys).withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")
