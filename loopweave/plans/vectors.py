"""Fixed-width vectors as unrolled columns: sums stay partially aggregated and every
expression stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(col: Column | str, width: int) -> list[Column]:
    """The elements of an array column of known width."""
    col = F.col(col) if isinstance(col, str) else col
    return [col[i] for i in range(width)]


def sum_vector(col: Column, width: int) -> Column:
    """Element-wise sum of array<double> rows; partial sums are made before the shuffle."""
    return F.array(*[F.sum(x) for x in items(col, width)])


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def log_sum_exp(terms: Sequence[Column]) -> Column:
    """log(sum(exp(term))) without overflow."""
    if len(terms) == 1:
        return terms[0]
    top = F.greatest(*terms)
    return top + F.log(total([F.exp(t - top) for t in terms]))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("bigint")
