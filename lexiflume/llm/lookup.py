"""Joins with a table of keys, some of which may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: A key with more than one in so many rows is looked up by a broadcast: there are at most so many of these keys.
HEAVY = 1000


def lookup(rows: DataFrame, keys: DataFrame, on: list[str], n_col: str, n_rows: int) -> DataFrame:
    """Inner join of rows with keys (one row for each key, nulls equal; n_col: how many rows have it, of n_rows in all).

    Heavy keys are broadcast, so their rows stay where they are; no other key has more than one in HEAVY rows in the shuffle.
    Both tables are read twice: hand over kept ones. n_col and the keys' own columns go."""
    named = keys.select(*[F.col(c).alias(f"{c}_looked_up") if c in on else F.col(c) for c in keys.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_looked_up")) for c in on])
    heavy = F.col(n_col) * HEAVY > n_rows
    few, many = F.broadcast(named.where(heavy)), named.where(~heavy)
    found = rows.join(few, same).unionByName(rows.join(few, same, "left_anti").join(many, same))
    return found.drop(n_col, *[f"{c}_looked_up" for c in on])
