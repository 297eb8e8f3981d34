"""Global alignment of token sequences with affine gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
MATCH, MISMATCH, OPEN, EXTEND = 2.5, -100.0, -5.0, -0.5


def gotoh(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Index pairs of the best alignment, gaps as None. A gap of k costs OPEN + EXTEND (k-1).

    Three score tables; ties prefer a pair, then a gap in ``a``, then one in ``b``.
    """
    if not a or not b:
        raise ValueError("both sides need tokens")
    n, m = len(a), len(b)
    codes = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[t] for t in a]), np.array([codes[t] for t in b])
    pair, up, left = (np.full((n + 1, m + 1), -np.inf) for _ in range(3))
    pair[0, 0] = 0
    up[1:, 0] = OPEN + EXTEND * np.arange(n)
    left[0, 1:] = OPEN + EXTEND * np.arange(m)
    slope = EXTEND * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.maximum(np.maximum(pair[i - 1], up[i - 1]), left[i - 1])
        pair[i, 1:] = best[:-1] + np.where(y == x[i - 1], MATCH, MISMATCH)
        up[i, 1:] = np.maximum(np.maximum(pair[i - 1, 1:], left[i - 1, 1:]) + OPEN, up[i - 1, 1:] + EXTEND)
        start = np.maximum(pair[i], up[i])[:-1] + OPEN - slope[1:]
        left[i, 1:] = np.maximum.accumulate(start) + slope[1:]
    i, j, out = n, m, []
    state = int(np.argmax([pair[n, m], left[n, m], up[n, m]]))
    while i or j:
        if state == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
            state = int(np.argmax([pair[i, j], left[i, j], up[i, j]]))
        elif state == 1:
            here, j = left[i, j], j - 1
            out.append((None, j))
            came = [pair[i, j] + OPEN, left[i, j] + EXTEND, up[i, j] + OPEN]
            state = int(np.argmin(np.abs(np.array(came) - here)))
        else:
            here, i = up[i, j], i - 1
            out.append((i, None))
            came = [pair[i, j] + OPEN, left[i, j] + OPEN, up[i, j] + EXTEND]
            state = int(np.argmin(np.abs(np.array(came) - here)))
    return gaps_in_order(out[::-1])


def gaps_in_order(pairs: list[tuple[int | None, int | None]]) -> list[tuple[int | None, int | None]]:
    """Between two pairs, gaps in ``a`` come before gaps in ``b``; after the last pair, the other
    way round."""
    out: list = []
    gaps: tuple[list, list] = ([], [])
    for i, j in pairs:
        if i is not None and j is not None:
            out += [*gaps[0], *gaps[1], (i, j)]
            gaps = ([], [])
        else:
            gaps[0 if i is None else 1].append((i, j))
    return [*out, *gaps[1], *gaps[0]]


def align(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, pairs) for rows with two token arrays; a pair has a null for a gap. Rows with an
    empty side have no pairs. Cost grows with the product of the lengths, in one row's task."""

    @F.pandas_udf("array<struct<idx_a:int,idx_b:int>>")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([gotoh(list(p), list(q)) if p is not None and q is not None and len(p) and len(q) else [] for p, q in zip(left, right)])

    return rows.select(*keys, run(a, b).alias("pairs"))


def alignment_score(aligned: DataFrame, keys: list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, n_aligned, n_gaps_a, n_gaps_b, <field>_match_rate): aligned: keys, pairs and two arrays
    a field. Empty values never match; a rate's denominator is 1 at least."""
    both = F.filter("pairs", lambda p: p["idx_a"].isNotNull() & p["idx_b"].isNotNull())

    def rate(a, b):
        one, two = (lambda p: F.get(F.col(a), p["idx_a"])), (lambda p: F.get(F.col(b), p["idx_b"]))
        same = F.filter(both, lambda p: (one(p) == two(p)) & (one(p) != ""))
        return F.size(same) / F.greatest(F.lit(1), F.size(both))

    def missing(side):
        return F.size(F.filter("pairs", lambda p: p[f"idx_{side}"].isNull()))

    gaps = {f"n_gaps_{x}": missing(x) for x in "ab"}
    rates = [rate(a, b).alias(f"{name}_match_rate") for name, (a, b) in fields.items()]
    return aligned.select(*keys, F.size(both).alias("n_aligned"), *[c.alias(n) for n, c in gaps.items()], *rates)
