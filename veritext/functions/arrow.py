"""Arrow UDFs that are made as they are called, so that modules can be imported before a session begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kernel: Callable, returns: str, once: bool = False) -> Callable[..., Column]:
    """once: the optimizer must not merge the call into expressions that use its result, nor repeat it."""

    def call(*columns) -> Column:
        made = F.udf(kernel, returns, useArrow=True)
        return (made.asNondeterministic() if once else made)(*columns)

    return call


def settled(c: Column) -> Column:
    """c as a column of its own: the optimizer merges nothing non-deterministic into the expressions above it.

    The arguments of UDFs must not hold lambda functions, which a merge could bring in.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)
