"""Scalar helpers: keys, durations, ids and literals."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of printed ids (Crockford's base 32) and unit lengths in milliseconds.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"
UNITS_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
MAX_NAME = 511


# ---- keys


def key_of_token(token: str) -> int | str:
    """A key as typed: true and false are 1 and 0, what reads as a 64-bit integer is one, the rest is text."""
    if token in ("true", "false"):
        return int(token == "true")
    if re.fullmatch(r"[+-]?[0-9]+", token) and -(1 << 63) <= int(token) < 1 << 63:
        return int(token)
    return token


def key_int(token: Column) -> Column:
    """The integer that a typed key stands for, or null."""
    return F.when(token == "true", F.lit(1).cast("bigint")).when(token == "false", F.lit(0).cast("bigint")).otherwise(
        F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("bigint"))
    )


def widen(key_i: Column, key_s: Column) -> Column:
    return F.coalesce(key_s, key_i.cast("string"))


def narrow(key_s: Column) -> Column:
    return F.when(key_s.rlike(r"^-?[0-9]+$"), key_s.try_cast("bigint"))


def matches_prefix(key_i: Column, key_s: Column, prefix: int | str) -> Column:
    """Text keys match by prefix, integer keys by equality, never across."""
    found = key_s.startswith(prefix) if isinstance(prefix, str) else key_i == prefix
    return F.coalesce(found, F.lit(False))


def check_name(name: str, dots: bool = False) -> str:
    if not name or len(name.encode()) > MAX_NAME or any(ord(c) < 32 or ord(c) == 127 for c in name) or ("." in name and not dots):
        raise ValueError(f"not a usable name: {name!r}")
    return name


# ---- durations and sizes


def duration_ms(text: str) -> int:
    """`90`, `90s`, `5m`, `2h`, `1d` or `250ms`; a bare number is seconds."""
    found = re.fullmatch(r"\s*([0-9]+)\s*(ms|s|m|h|d)?\s*", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    out = int(found[1]) * UNITS_MS[found[2] or "s"]
    if out >= 1 << 63:
        raise OverflowError(text)
    return out


def duration_ms_column(text: Column) -> Column:
    number = F.regexp_extract(text, r"^\s*([0-9]+)\s*(ms|s|m|h|d)?\s*$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^\s*([0-9]+)\s*(ms|s|m|h|d)?\s*$", 2)
    factor = F.lit(1000).cast("bigint")
    for name, ms in UNITS_MS.items():
        factor = F.when(unit == name, F.lit(ms).cast("bigint")).otherwise(factor)
    return number * factor


def show_duration(ms: int) -> str:
    for name in ("d", "h", "m", "s"):
        if ms >= UNITS_MS[name] and ms % UNITS_MS[name] == 0:
            return f"{ms // UNITS_MS[name]}{name}"
    return f"{ms}ms"


def show_bytes(size: int) -> str:
    value, units = float(size), ["B", "KB", "MB", "GB", "TB"]
    while value >= 1024 and len(units) > 1:
        value /= 1024
        units.pop(0)
    return f"{size} B" if units[0] == "B" else f"{value:.1f} {units[0]}"


# ---- ids


def base32(number: int, width: int = 0) -> str:
    out = ""
    while number:
        number, low = divmod(number, 32)
        out = ALPHABET[low] + out
    return (out or "0").rjust(width, "0")


def from_base32(text: str) -> int:
    out = 0
    for c in text.lower():
        out = out * 32 + ALPHABET.index({"o": "0", "i": "1", "l": "1"}.get(c, c))
    return out


def revision_number(ts_ms: int, cluster: int, process: int, seq: int) -> int:
    return ts_ms << 80 | cluster << 64 | process << 48 | seq


def split_revision(number: int) -> tuple[int, int, int, int]:
    return number >> 80, number >> 64 & 0xFFFF, number >> 48 & 0xFFFF, number & (1 << 48) - 1


def _digits(value: Column, bits: int) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 2), bits, "0")


def revision_base32(rev: Column) -> Column:
    """Printed form of a revision struct: its 128 bits, five at a time, without leading zeros."""
    bits = F.concat(F.lit("00"), _digits(rev.ts_ms, 48), _digits(rev.cluster, 16), _digits(rev.process, 16), _digits(rev.seq, 48))
    letters = F.transform(
        F.sequence(F.lit(0), F.lit(25)), lambda i: F.substring(F.lit(ALPHABET), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    )
    shown = F.ltrim(F.array_join(letters, ""), F.lit("0"))
    return F.when(shown == "", "0").otherwise(shown)


# ---- literals


def literal(text: str) -> Any:
    """A value as typed in an expression: quoted text, true or false in any case, integer, float, else bare text."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?[0-9]+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if re.fullmatch(r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?", text):
        return float(text)
    return text


def property_json(value: Any) -> Any:
    """A property as JSON shows it: bytes by their number, a place as [lat, lon]."""
    if isinstance(value, bytes | bytearray):
        return f"<{len(value)} bytes>"
    return list(value) if isinstance(value, tuple) else value


def property_of_json(text: str) -> Any:
    """JSON to a property: objects, and arrays that aren't two numbers, are refused."""
    value = json.loads(text)
    if isinstance(value, dict) or (isinstance(value, list) and (len(value) != 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in value))):
        raise ValueError(f"not a property: {text}")
    return tuple(map(float, value)) if isinstance(value, list) else value
