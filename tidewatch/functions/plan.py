"""Small helpers that shape a plan."""

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A filter on a plain computed column is pushed under its projection together with a copy of
    the expression, so that a text would be parsed again for every use. Filters are not pushed
    through a generator, so the values come out of one that yields a single row.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(values)))
