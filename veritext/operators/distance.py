"""Edit distances: exact ones are Spark's levenshtein, segmented ones an Arrow UDF over line and character alignments."""

from __future__ import annotations

import difflib

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritext.config import EXACT_BLOCK_CELLS
from veritext.functions.arrow import arrow_udf


def levenshtein(a: str, b: str) -> int:
    """Edit distance of code points, with the shorter text's row in numpy."""
    import numpy as np

    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    other = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for k, x in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        best = np.empty_like(row)
        best[0] = k
        np.minimum(row[1:] + 1, row[:-1] + (other != x), out=best[1:])
        # Insertions run along the row: a running minimum of what each place costs less its offset.
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def _changes(a, b):
    return (x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal")


def block_cost(a: str, b: str) -> int:
    """The distance of two blocks; for very large ones that of their alignment by characters."""
    if not a or not b or len(a) * len(b) <= EXACT_BLOCK_CELLS:
        return levenshtein(a, b)
    return sum(max(i2 - i1, j2 - j1) for _, i1, i2, j1, j2 in _changes(a, b))


def segmented(a: str, b: str) -> int:
    """An upper bound of the distance: lines are aligned first, and the blocks between equal runs compared."""
    x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
    return sum(block_cost("".join(x[i1:i2]), "".join(y[j1:j2])) for _, i1, i2, j1, j2 in _changes(x, y))


def _segmented_if(a, b, wanted):
    return segmented(a, b) if wanted else None


segmented_udf = arrow_udf(_segmented_if, "int")


def normalized(a: Column, b: Column, exact_cells: int) -> Column:
    """Distance over the longer length, at most 1: exact up to exact_cells, segmented beyond. a and b must be in normal form."""
    n, m = F.length(a).cast("bigint"), F.length(b).cast("bigint")
    small = n * m <= exact_cells
    steps = F.when(a == b, 0).when(small, F.levenshtein(a, b)).otherwise(segmented_udf(a, b, ~small & (a != b)))
    return F.least(F.lit(1.0), steps / F.greatest(n, m, F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    """1 less the normalized distance of two flat texts; 1 if both are empty, 0 if one is."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))
