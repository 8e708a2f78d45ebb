"""JSON by the strict rules: UTF-8, an object at the root, no repeated key, finite numbers, nothing behind the end, bounded depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH = 64


def fault(data: bytes | str | None, most_bytes: int | None = None) -> str | None:
    """What makes data no strict JSON, or None."""
    if data is None:
        return "missing"
    try:
        text = data.decode("utf-8") if isinstance(data, bytes) else data
    except UnicodeDecodeError:
        return "encoding"
    if most_bytes is not None and len(text.encode("utf-8")) > most_bytes:
        return "size"

    def pairs(items: list[tuple[str, object]]) -> dict:
        found = dict(items)
        if len(found) < len(items):
            raise ValueError("repeated")
        return found

    def number(text: str) -> float:
        value = float(text)
        if value in (float("inf"), float("-inf")):
            raise ValueError("number")
        return value

    def constant(_: str) -> float:
        raise ValueError("number")

    try:
        root = json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_constant=constant)
    except RecursionError:
        return "depth"
    except ValueError as e:
        return str(e) if str(e) in ("repeated", "number") else "syntax"
    level, depth = [root], 0
    while level:
        depth += 1
        if depth > MOST_DEPTH + 1:
            return "depth"
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return None if isinstance(root, dict) else "root"


def json_fault(data: Column, most_bytes: int | None = None) -> Column:
    """fault() of a string or binary column, in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            yield pa.array([fault(x, most_bytes) for x in cells.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(data)


def contract_fault(data: Column, schema: str, contract_set: str, most_bytes: int | None = None) -> Column:
    """What makes a column no JSON of a contract: a fault of its own, or another `schema` or `contract_set` than asked for; null where nothing does."""
    text = data.cast("string")
    strict = json_fault(data, most_bytes)
    other = F.when(~F.get_json_object(text, "$.schema").eqNullSafe(F.lit(schema)), "schema").when(~F.get_json_object(text, "$.contract_set").eqNullSafe(F.lit(contract_set)), "contract_set")
    return F.coalesce(strict, other)
