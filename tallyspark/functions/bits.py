"""Doubles by their bits: NaN payloads and signed zeros are data."""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_bits(v: Column) -> Column:
    """The bits of a double as a long; null stays null. Project it before joining by it."""
    return F.when(v.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(v, F.lit(0.0))).cast("long"))


def same_bits(a: Column, b: Column) -> Column:
    """Null-safe equality of projected bits."""
    return a.eqNullSafe(b)


def canonical(value: object) -> bytes:
    """Bytes that tell typed values apart: 1 is not 1.0, -0.0 is not 0.0, and order of keys does not matter. Only finite numbers have any.

    The format is fixed: a scalar is its tag, the payload's length, a colon and the payload; lists and objects are their tag, count and members in brackets.
    """
    if value is None or isinstance(value, bool):
        return {None: b"n;", True: b"b1;", False: b"b0;"}[value]
    if isinstance(value, (list, dict)):
        if isinstance(value, list):
            members, form = [canonical(v) for v in value], b"a%d[%s]"
        else:
            if not all(isinstance(k, str) for k in value):
                raise TypeError("keys of an object are strings")
            members, form = [canonical(k) + canonical(value[k]) for k in sorted(value)], b"m%d{%s}"
        return form % (len(members), b"".join(members))
    if isinstance(value, str):
        scalar = b"s", value.encode("utf-8")
    elif isinstance(value, int):
        scalar = b"i", b"%d" % value
    elif isinstance(value, float) and math.isfinite(value):
        scalar = b"f", struct.pack(">d", value).hex().encode("ascii")
    else:
        raise ValueError(f"{value!r} has no canonical form")
    return b"%s%d:%s" % (scalar[0], len(scalar[1]), scalar[1])


def compact_json(value: object) -> str:
    """JSON without blanks, keys in order, text as it is: the form that digests of rows are made of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
