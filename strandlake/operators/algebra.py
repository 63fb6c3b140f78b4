"""One fold step of a named state, and folds of whole chains as Spark jobs.

`apply` is the meaning of each operation on one state; `fold` and `fold_items` run it over any number of
chains: operations are dealt by chain, sorted by sequence, and streamed past one state at a time.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..errors import Deserialization, InvalidOperation
from ..functions.json_values import Raw, parsed, text_of

WHOLE = ("Set", "Snapshot", "Delta")


def _container(value, kind: type):
    value = kind() if value is None else parsed(value)
    if not isinstance(value, kind):
        raise Deserialization(f"the state is no {'array' if kind is list else 'object'}")
    return value


def _item(text: str):
    return parsed(Raw(text))


def _tree_ops(value, ops):
    tree = _container(value, dict)
    for op in ops or ():
        if op["op"] == "set":
            tree[op["path"]] = op["entry"]
        else:
            tree.pop(op["path"], None)
    return tree


def apply(value, op: dict, strict: bool = True):
    """The state after `op`; None is a state without a value. Not strict: an Edit out of range changes nothing."""
    kind, fields = op["op"], op.get("field_path")
    if fields:
        held = _container(value, dict)
        inner = held.get(fields[0])
        held[fields[0]] = parsed(apply(inner, {**op, "field_path": fields[1:]}, strict))
        return held
    if kind in WHOLE:
        return Raw(op["value"])
    if kind == "Append":
        items = _container(value, list)
        items.append(_item(op["value"]))
        return items
    if kind == "DeltaSnapshot":
        return _container(value, list) + _item(op["value"])
    if kind == "Edit":
        items = _container(value, list)
        if 0 <= op["idx"] < len(items):
            items[op["idx"]] = _item(op["value"])
        elif strict:
            raise InvalidOperation(f"edit index {op['idx']} out of bounds (length {len(items)})")
        return items
    if kind == "Redact":
        items = _container(value, list)
        begin, end = min(op["idx"], len(items)), min(op["idx_end"], len(items))
        if begin < end:
            del items[begin:end]
        return items
    if kind == "TreeSet":
        return _tree_ops(value, [{"op": "set", "path": op["path"], "entry": op["entry"]}])
    if kind == "TreeRemove":
        return _tree_ops(value, [{"op": "remove", "path": op["path"]}])
    if kind in ("TreeBatch", "TreeDeltaSnapshot"):
        return _tree_ops(value, op["ops"])
    raise InvalidOperation(f"unknown operation {kind}")


OP_COLUMNS = ["op", "value", "idx", "idx_end", "path", "entry", "ops", "field_path"]


def _streamed(ops: DataFrame, keys: list[str], order: str, strict: bool, emit, schema: str) -> DataFrame:
    """Folds each chain; `emit` makes rows (without the keys) of its value."""
    have = [c for c in OP_COLUMNS if c in ops.columns]
    width = len(keys)
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = ops.select(*keys).schema
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), schema])

    def run(batches):
        key, value, rows = None, None, []
        arrow = None

        def block():
            columns = list(zip(*rows)) if rows else [[]] * (width + len(names))
            out = pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, arrow)], [*kinds.names, *names])
            rows.clear()
            return out

        def emitted():
            for x in emit(value):
                rows.append((*key, *x))
                if len(rows) > 20_000:
                    yield block()

        for batch in batches:
            if arrow is None:
                arrow = [*(batch.schema.field(i).type for i in range(width)), *(pa.int64() if x.strip().split()[1] == "bigint" else pa.string() for x in schema.split(","))]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:width] != key:
                    if key is not None:
                        yield from emitted()
                    key, value = row[:width], None
                value = apply(value, dict(zip(have, row[width + 1 :])), strict)
        if key is not None:
            yield from emitted()
            yield block()

    dealt = ops.select(*keys, order, *have).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)
    return dealt.mapInArrow(run, out_schema)


def fold(ops: DataFrame, keys: list[str], order: str = "sequence", strict: bool = True) -> DataFrame:
    """The value (JSON text) of each chain."""
    return _streamed(ops, keys, order, strict, lambda v: [(text_of(v),)], "value string")


def fold_items(ops: DataFrame, keys: list[str], order: str = "sequence", strict: bool = True) -> DataFrame:
    """The items of each chain's array, a row for each with its position from 0."""

    def items(value):
        return ((i, json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)) for i, x in enumerate(_container(value, list)))

    return _streamed(ops, keys, order, strict, items, "pos bigint, item string")
