"""Keep derived columns computed once.

Catalyst pushes a filter on a derived column through every projection below it and inlines
each definition on the way; with decision chains that reference one another the expression
grows exponentially. ``seal`` ends an operator with a one-row generator: filters on sealed
columns stop there, filters on all other columns still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.functions.sqlx import when


def seal(df: DataFrame, *columns: str) -> DataFrame:
    """Same rows and columns; predicates on ``columns`` are not inlined further down."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def with_texts(df: DataFrame, only=None, **values) -> DataFrame:
    """Add columns given as the texts of expressions; NULL, and not computed, where not ``only``."""
    return df.withColumns({name: (value if only is None else when(only, value)).column() for name, value in values.items()})


def spread(df: DataFrame, light: bool = False) -> DataFrame:
    """Rows over all cores, dealt in turn.

    Rows of calls take few bytes and much work, and a file can't be read by more tasks than it has row
    groups: 600,000 calls in one group would be one task, whatever the cluster. ``light`` work is dealt
    in one-machine sessions only; elsewhere the input's own splits serve.
    """
    context = df.sparkSession.sparkContext
    if context.master.startswith("local["):
        return df.repartition(context.defaultParallelism)
    return df if light else df.repartition(context.defaultParallelism * 4)
