"""Ordered access to the live view: scans forwards and backwards, counts, range deletes, pop.

A namespace with text keys is scanned by prefix; one with integer keys only by an inclusive bound.  Offsets count rows that
pass the filters; a limit of 0 gives nothing, None everything.  All filters stand before the order, so that they reach
the file scan where the view is a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.operators import log as L


def by_prefix(prefix: str | int, ordered: bool, reverse: bool = False) -> Column:
    """The scan's key filter: text prefix, or integer bound from which keys are listed."""
    if not ordered:
        return F.col("key_s").startswith(str(prefix))
    if prefix == "":
        return F.col("key_i").isNotNull()
    return F.col("key_i") <= int(prefix) if reverse else F.col("key_i") >= int(prefix)


def scan(view: DataFrame, prefix: str | int = "", limit: int | None = None, offset: int = 0, ordered: bool = False, reverse: bool = False) -> DataFrame:
    """Rows of a live (or latest) view in key order, or from the end."""
    out = view.where(by_prefix(prefix, ordered, reverse)).orderBy(*L.key_order(reverse))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def deleted_too(log: DataFrame) -> DataFrame:
    """The view that scans list deleted and expired keys from."""
    return L.latest(log)


def get(view: DataFrame, key: int | str) -> DataFrame:
    return view.where(F.col("key_i") == key) if isinstance(key, int) else view.where(F.col("key_s") == key)


def get_many(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the wanted (ns, key_i, key_s); null-safe, so either kind of key meets."""
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"k.{k}")) for k in L.KEY]
    return view.alias("v").join(keys.alias("k"), on, "left_semi")


def exists(view: DataFrame, key: int | str) -> bool:
    return not get(view, key).isEmpty()


def count(view: DataFrame, prefix: str | None = None) -> DataFrame:
    rows = view if prefix is None else view.where(by_prefix(prefix, False))
    return rows.agg(F.count("*").alias("n"))


def delete_range(view: DataFrame, start: int | str, end: int | str, rev: Column, inclusive: bool = False) -> DataFrame:
    """Tombstones for live keys from `start` up to `end`."""
    c = F.col("key_s") if isinstance(start, str) else F.col("key_i")
    return L.tombstones(view.where((c >= start) & ((c <= end) if inclusive else (c < end))), rev)


def delete_prefix(view: DataFrame, prefix: str, rev: Column) -> DataFrame:
    """Tombstones for live text keys with the prefix; integer keys never match."""
    return L.tombstones(view.where(F.col("key_s").startswith(prefix)), rev)


def pop_first(view: DataFrame, prefix: str | int = "", ordered: bool = False) -> DataFrame:
    """The first live row; the caller appends its tombstone."""
    return scan(view, prefix, 1, ordered=ordered)
