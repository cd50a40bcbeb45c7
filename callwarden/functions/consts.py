"""Literal columns built from the vocabularies; all fold to constants in the plan."""

from __future__ import annotations

import functools
import json

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def per_session(build):
    """Reuse the columns a builder returns within one Spark context.

    Long decision chains cost thousands of gateway calls to put together; the expressions
    themselves are unresolved and can serve any number of plans.
    """
    made: dict = {}

    @functools.wraps(build)
    def reuse(*args):
        context = SparkContext._active_spark_context
        kept = made.get(args)
        if kept is None or kept[0] is not context:
            made[args] = kept = (context, build(*args))
        return kept[1]

    return reuse


def const(value, ddl: str) -> Column:
    """Nested Python value as a constant column of type ``ddl``."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def strings(values) -> Column:
    """Constant array of strings."""
    return F.array(*[F.lit(v) for v in values])


def known(*values: Column) -> Column:
    """Array of those of different strings that are not NULL.

    ``array_compact`` would do, but like every function with a lambda it walks its whole argument as a tree
    for each row, where the rest of a row's work is compiled.
    """
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def first_by_order(order, present: Column) -> Column:
    """First member of ``order`` that occurs in the array ``present``; NULL when none does."""
    return F.get(F.array_intersect(strings(order), present), F.lit(0))
