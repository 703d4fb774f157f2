"""Similarity of names by the published ratio family: indel ratio, token sort, token set, partial.

The kernels work on whole batches; candidates should be pruned in SQL first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        match = where.get(c, 0) & state
        state = (state + match | state - match) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_sort(a: str, b: str, score=ratio) -> float:
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str, score=ratio) -> float:
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    if score is partial_ratio:
        return 100.0 if both else partial_ratio(only_x, only_y)
    return max([score(left, right), *([score(both, left), score(both, right)] if both else [])])


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if long < 1.5:
        return max(base, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if long < 8 else 0.6
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * max(token_sort(a, b, partial_ratio), token_set(a, b, partial_ratio)))


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
