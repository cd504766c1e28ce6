"""Normalized indel similarity as a native Spark expression.

``ratio(a, b) = (1 - (|a| + |b| - 2 * LCS(a, b)) / (|a| + |b|)) * 100`` --
the typo-tolerant score used by the description parser (case sensitive,
0 when either side is empty). LCS is a row-by-row dynamic programme
written with ``aggregate`` over the characters of ``a``; each DP row is
built left to right by an inner ``aggregate``. Everything stays inside
the JVM; no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two non-empty strings."""
    lb = F.length(b)
    zeros = F.transform(F.sequence(F.lit(0), lb), lambda _j: F.lit(0))

    def next_row(prev: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), lb),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.greatest(
                F.element_at(prev, j + 1),
                F.element_at(acc, -1),
                F.when(ch == F.substr(b, j, F.lit(1)), F.element_at(prev, j) + 1).otherwise(F.lit(0)),
            ))),
        )

    last = F.aggregate(F.split(a, ""), zeros, next_row)
    return F.element_at(last, lb + 1)


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100; 0 when either string is empty."""
    la, lb = F.length(a), F.length(b)
    total = (la + lb).cast("double")
    dist = total - F.lit(2.0) * lcs_length(a, b).cast("double")
    return (F.when((la == 0) | (lb == 0), F.lit(0.0))
            .otherwise((F.lit(1.0) - dist / total) * F.lit(100.0)))


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """Best ratio two strings of these lengths could reach; used to skip
    pairs that can never pass the cutoff."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(0.0)).otherwise(
        F.lit(200.0) * F.least(la, lb).cast("double") / (la + lb).cast("double"))
