"""JSON as digests and documents hold it: keys in order, no blanks, text as it is, and numbers in the shortest decimal form that gives them back (0.0004, 20000000.0)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.bits import compact_json


def _plain(value: object, kind: pa.DataType) -> object:
    """A cell as JSON has it: structs and maps are objects, maps with their keys as text."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind}
    if pa.types.is_map(kind):
        return {str(k): _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    return value


def merged(value: dict, constants: dict) -> dict:
    """value with the members of constants, object by object; where both have one that is no object, that of value stays."""
    both = {k: merged(value[k], c) for k, c in constants.items() if isinstance(c, dict) and isinstance(value.get(k), dict)}
    return constants | value | both


def canonical_json(value: Column, constants: dict | None = None) -> Column:
    """A struct, map or array as canonical JSON; nulls within it are written, a null stays null. constants (a struct's or map's alone) are members that every document has beside its own.
    A NaN or infinite number has no JSON and ends the job."""

    @F.arrow_udf("string")
    def text(cells: pa.Array) -> pa.Array:
        plain = lambda v: merged(_plain(v, cells.type), constants) if constants else _plain(v, cells.type)
        return pa.array([None if v is None else compact_json(plain(v)) for v in cells.to_pylist()], pa.string())

    return text(value)


def json_number(value: Column) -> Column:
    """A finite double as JSON writes it; other values are null."""

    @F.arrow_udf("string")
    def text(cells: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v - v != 0 else repr(v) for v in cells.to_pylist()], pa.string())

    return text(value.cast("double"))
