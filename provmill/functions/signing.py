"""Canonical JSON (RFC 8785) and the payloads that signatures are made over."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _number(x: float | int) -> str:
    """As ECMAScript prints it."""
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a number of JSON")
    if x == 0:
        return "0"
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, rest = digits.partition(".")
    rest = "" if rest == "0" else rest
    point = len(whole) + int(exponent or 0)
    all_digits = (whole + rest).lstrip("0")
    point -= len(whole + rest) - len((whole + rest).lstrip("0"))
    all_digits = all_digits.rstrip("0") or "0"
    n = len(all_digits)
    if n <= point <= 21:
        out = all_digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{all_digits[:point]}.{all_digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + all_digits
    else:
        e = point - 1
        out = all_digits[0] + (f".{all_digits[1:]}" if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if x < 0 else "") + out


def canonical_json(value) -> str:
    """Keys in order of their UTF-16 units, no white space."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


@pandas_udf(StringType())
def canonical(raw: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for what isn't JSON."""

    def one(x):
        try:
            return None if x is None else canonical_json(json.loads(x))
        except ValueError:
            return None

    return raw.map(one)


def payload_digest(raw: Column | str) -> Column:
    """SHA-256 (hexadecimal) of the canonical form."""
    return F.sha2(canonical(F.col(raw) if isinstance(raw, str) else raw).cast("binary"), 256)


def step_payload(step: Column, change: Column) -> Column:
    """What an author signs of a step; both are JSON objects."""
    return F.concat(F.lit('{"change":'), change, F.lit(',"step":'), step, F.lit("}"))


def path_payload(path: Column, step_ids: Column) -> Column:
    """What an author signs of a path: the path object (JSON) and the ids of its steps in order (an array)."""
    return F.concat(F.lit('{"path":'), path, F.lit(',"step_ids":'), F.to_json(step_ids), F.lit("}"))


def review_payload(path_id: Column, head: Column, reviewed_at: Column) -> Column:
    """What a reviewer signs: the path, its head at that time, and the time."""
    return F.to_json(F.struct(head.alias("head"), path_id.alias("path_id"), reviewed_at.alias("reviewed_at")))
