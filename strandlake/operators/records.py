"""Scans, lookups and reversed edges over the record log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import positioned


def get_record(records: DataFrame, record_id: int) -> DataFrame:
    return records.filter(F.col("id") == record_id)


def ids_by_type(records: DataFrame, record_type: str) -> DataFrame:
    """In append order, over all branches."""
    return records.filter(F.col("record_type") == record_type).select("id").orderBy("id")


def query_range(records: DataFrame, branch: int, begin: int | None = None, end: int | None = None, types: list[str] | None = None, limit: int | None = 10_000, offset: int = 0, reverse: bool = False) -> DataFrame:
    """A branch's own records between two sequences (both included), filtered first, then ordered and cut."""
    found = records.filter(F.col("branch") == branch)
    if begin is not None:
        found = found.filter(F.col("sequence") >= begin)
    if end is not None:
        found = found.filter(F.col("sequence") <= end)
    if types is not None:
        found = found.filter(F.col("record_type").isin(*types))
    found = found.orderBy(F.desc("sequence") if reverse else F.asc("sequence"))
    if offset:
        found = found.offset(offset)
    return found if limit is None else found.limit(limit)


def scan_from(records: DataFrame, record_id: int) -> DataFrame:
    """All branches in append order."""
    return records.filter(F.col("id") >= record_id).orderBy("id")


def scan_from_sequence(records: DataFrame, branch: int, sequence: int) -> DataFrame:
    """All branches in append order, from the record that a branch has at a sequence; from the start if it has none."""
    first = records.filter((F.col("branch") == branch) & (F.col("sequence") == sequence)).agg(F.coalesce(F.min("id"), F.lit(0)).alias("_first"))
    return records.join(F.broadcast(first), F.lit(True)).filter(F.col("id") >= F.col("_first")).drop("_first").orderBy("id")


def point(records: DataFrame, branch: int, sequence: int) -> DataFrame:
    return records.filter((F.col("branch") == branch) & (F.col("sequence") == sequence))


def max_sequences(records: DataFrame) -> DataFrame:
    return records.groupBy("branch").agg(F.max("sequence").alias("max_sequence"))


def edges(records: DataFrame, column: str) -> DataFrame:
    """(target, id): each mention of a target, repeats too."""
    return records.select(F.explode(column).alias("target"), "id")


def mentions(records: DataFrame, column: str, target: int) -> DataFrame:
    """Records that name `target` in caused_by or linked_to, in append order, once for each mention."""
    return edges(records.filter(F.array_contains(column, target)), column).filter(F.col("target") == target).select("id").orderBy("id")


def page(records: DataFrame, branch: int, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """A page with the flag whether it is full."""
    rows = query_range(records, branch, limit=limit, offset=offset, **filters)
    full = rows.agg((F.count("*") == limit).alias("has_more"))
    return rows.join(F.broadcast(full), F.lit(True))


def tail(records: DataFrame, branch: int, limit: int = 50) -> DataFrame:
    """Newest first, with the number of records of all branches."""
    total = records.agg(F.count("*").alias("total"))
    return query_range(records, branch, limit=limit, reverse=True).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > limit)


def record_types(records: DataFrame, branch: int) -> DataFrame:
    return records.filter(F.col("branch") == branch).select("record_type").distinct().orderBy("record_type")


def shown_payload(payload: Column) -> Column:
    """The payload as JSON if it is some, else as base64."""
    text = F.try_validate_utf8(payload) if hasattr(F, "try_validate_utf8") else payload.cast("string")
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.base64(payload))


def elided_payload(payload: Column, most: int = 4096) -> Column:
    """The payload's text where it is JSON of at most so many bytes, else null."""
    return F.when((F.length(payload) <= most) & F.try_parse_json(payload.cast("string")).isNotNull(), payload.cast("string"))


def keep_ids(ids: Column) -> Column:
    """Links given as texts: those that are no numbers are left out."""
    return F.filter(F.transform(ids, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def validate(records: DataFrame) -> DataFrame:
    """By branch: records, largest id and sequence, and payloads whose checksum (column crc32) is another."""
    wrong = F.col("crc32") != F.crc32("payload") if "crc32" in records.columns else F.lit(False)
    return records.groupBy("branch").agg(F.count("*").alias("n"), F.max("id").alias("max_id"), F.max("sequence").alias("max_sequence"), F.count_if(wrong).alias("n_bad"))


def damage(records: DataFrame) -> DataFrame:
    """One row: the first bad record, whether good ones follow (then the log is corrupt, else its tail is torn),
    and how many records come before it."""
    bad = F.col("crc32") != F.crc32("payload")
    first = records.filter(bad).agg(F.min("id").alias("first_bad"))
    return records.join(F.broadcast(first), F.lit(True)).groupBy("first_bad").agg(
        F.count_if(F.col("first_bad").isNull() | (F.col("id") < F.col("first_bad"))).alias("valid_records"),
        F.coalesce(F.bool_or((F.col("id") > F.col("first_bad")) & ~bad), F.lit(False)).alias("corrupt"))


def assigned(inputs: DataFrame, order: str, heads: DataFrame, next_id: int) -> DataFrame:
    """Inputs (branch, ...) of one commit with the ids and sequences that they get: ids go on from `next_id` in the order
    of the number column `order`, sequences from each branch's head (heads: branch, max_sequence)."""
    numbered = positioned(positioned(inputs, [], order, "_i"), ["branch"], order, "_j")
    known = heads.select("branch", F.col("max_sequence").alias("_head"))
    joined = numbered.join(known, "branch", "left")
    return joined.select(*inputs.columns, (F.col("_i") + next_id - 1).alias("id"), (F.col("_j") + F.coalesce("_head", F.lit(0))).alias("sequence"))


def encoding_of(payload: Column) -> Column:
    """The tag of a payload: json where it is some, else raw."""
    return F.when(F.try_parse_json(F.try_validate_utf8(payload)).isNotNull(), "json").otherwise("raw")


def with_identity(item: Column, record_id: Column, sequence: Column, id_field: str = "id", sequence_field: str = "sequence") -> Column:
    """A JSON object with the record's id (as text) and sequence (as a number) in two fields, over what these held. Null
    where the item is no object: such an append is not valid."""
    held = F.from_json(item, "map<string,variant>")
    others = F.map_filter(held, lambda k, _: ~k.isin(id_field, sequence_field))
    own = F.create_map(F.lit(id_field), F.parse_json(F.to_json(F.array(record_id.cast("string")))), F.lit(sequence_field), F.parse_json(sequence.cast("string")))
    own = F.transform_values(own, lambda k, v: F.when(k == id_field, F.try_variant_get(v, "$[0]", "variant")).otherwise(v))
    return F.when(F.startswith(F.trim(item), F.lit("{")) & held.isNotNull(), F.to_json(F.map_concat(others, own)))


def op_payload(kind: str, value: Column) -> Column:
    """A state operation as it is logged: {"kind": [the value's bytes as numbers]}."""
    digits = F.hex(value.cast("binary"))
    at = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    numbers = F.when(F.length(digits) > 0, F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit(f'{{"{kind}":['), F.array_join(numbers, ","), F.lit("]}"))


def decoded_op(payload: Column) -> Column:
    """The inverse: a struct of the operation's kind and its value as text; null for what is no such payload."""
    held = F.map_entries(F.from_json(payload, "map<string,array<int>>"))
    code = F.array_join(F.transform(F.get(held, 0)["value"], lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return F.when(F.size(held) == 1, F.struct(F.get(held, 0)["key"].alias("op"), F.unhex(code).cast("string").alias("value")))


def torn_tail(frames: DataFrame) -> DataFrame:
    """For each log file (frames: sources.log_format): where its valid part ends, bytes after it, records in it, and
    whether records with larger ids follow a bad frame, so that it must not be cut."""
    bad = frames.filter(~F.col("ok")).groupBy("path").agg(F.min("offset").alias("truncated_at"))
    good = F.col("ok") & (F.col("truncated_at").isNull() | (F.col("offset") < F.col("truncated_at")))
    found = frames.join(bad, "path", "left").groupBy("path").agg(
        F.max("truncated_at").alias("truncated_at"), F.count_if(good).alias("valid_records"), F.max("size").alias("_size"),
        F.max(F.when(good, F.col("id"))).alias("_last"), F.max(F.when(F.col("ok") & ~good, F.col("id"))).alias("_later"))
    return found.select("path", "truncated_at", "valid_records", F.coalesce(F.col("_size") - F.col("truncated_at"), F.lit(0)).alias("dropped_bytes"), F.coalesce(F.col("_later") > F.coalesce("_last", F.lit(0)), F.lit(False)).alias("corrupt"))
