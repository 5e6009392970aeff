"""Per-row metrics as Column expressions, and the one that needs a loop as an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from lexiflume.functions.text import eval_normalize


def let(f, *columns: Column) -> Column:
    """f of the columns, each of them evaluated once however often f uses it."""
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return F.transform(F.array(row), lambda r: f(*[r[f"c{i}"] for i in range(len(columns))]))[0]


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    least = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0), lambda s, t: s + F.least(count(x, t), count(y, t)))
    # Only shared tokens are counted, so a long text is gone through once.
    return let(lambda x, y: let(least, x, F.filter(y, lambda t: F.array_contains(x, t))), a, b)


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall over tokens (E08): twice the overlap over both sizes; 0 without overlap."""
    return let(lambda x, y: let(lambda o, n: F.when(o > 0, 2.0 * o / n).otherwise(F.lit(0.0)), overlap(x, y), F.size(x) + F.size(y)), a, b)


def exact_match(a: Column | str, b: Column | str) -> Column:
    return (eval_normalize(a) == eval_normalize(b)).cast("double")


def bleu1(candidate: Column, reference: Column) -> Column:
    """Clipped unigram precision with brevity penalty (E10); 0 without overlap."""

    def score(o, c, r):
        penalty = F.when((c > 0) & (c < r), F.exp(1 - r / F.nullif(c, F.lit(0)))).otherwise(F.lit(1.0))
        return F.when(o > 0, penalty * o / F.nullif(c, F.lit(0))).otherwise(F.lit(0.0))

    return let(lambda x, y: let(score, overlap(x, y), F.size(x), F.size(y)), candidate, reference)


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, bit-parallel: bit i of a whole number stands for item i of ``a``, and stays set as long as the item is in no longest one yet; an
    addition moves all of them at once for an item of ``b``."""
    masks: dict = {}
    for i, t in enumerate(a):
        masks.setdefault(t, []).append(i)
    masks = {t: sum(1 << i for i in at) for t, at in masks.items() if len(at) < 64} | {t: _bits(at) for t, at in masks.items() if len(at) >= 64}
    every = (1 << len(a)) - 1
    left = every
    for t in b:
        if m := masks.get(t):
            met = left & m
            left = ((left + met) | (left - met)) & every
    return len(a) - left.bit_count()


def _bits(at: list[int]) -> int:
    flags = np.zeros(at[-1] + 1, np.uint8)
    flags[at] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of two token arrays (E11). Time grows with the product of their lengths over 64."""

    def one(x, y):
        n = lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
        return 2 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def valid_scores(*columns: str) -> Column:
    """All are present and no NaN."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out
