"""Statistics of columns, by table or by row group, and their merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDERED = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """Per column: column, min_value, max_value (as text; null for types without order), n_values, null_count and, if asked for, distinct_count.

    One aggregation over all columns, which then become rows.
    """
    return grouped_stats(df, [], columns, distinct)


def grouped_stats(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """column_stats of each group, such as a row group or file."""
    names = [c for c in (columns or df.columns) if c not in by]
    kinds = {f.name: f.dataType for f in df.schema}
    aggregates = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        ordered = isinstance(kinds[n], _ORDERED)
        aggregates += [(F.min(c) if ordered else F.first(F.lit(None))).cast("string").alias(f"min{i}"), (F.max(c) if ordered else F.first(F.lit(None))).cast("string").alias(f"max{i}")]
        aggregates += [F.count(c).alias(f"n{i}"), F.count(F.when(c.isNull(), 1)).alias(f"null{i}")]
        if distinct:
            aggregates.append(F.count_distinct(c).alias(f"d{i}"))
    one = df.groupBy(*by).agg(*aggregates)
    rows = []
    for i, n in enumerate(names):
        fields = [F.lit(n).alias("column"), F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"), F.col(f"n{i}").alias("n_values"), F.col(f"null{i}").alias("null_count")]
        rows.append(F.struct(*fields, *([F.col(f"d{i}").alias("distinct_count")] if distinct else [])))
    return one.select(*by, F.explode(F.array(*rows)).alias("s")).select(*by, "s.*")


def merge_stats(stats: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Statistics of parts merged per column. Numbers of distinct values are lost, since parts may share values.

    numeric: the columns whose least and greatest values are compared as numbers, not as text; whole numbers exactly.
    """
    number = F.col("column").isin(list(numeric)) if numeric else F.lit(False)
    low, high = F.col("min_value"), F.col("max_value")
    # ordered as doubles, and equal doubles as whole numbers where both are; a number isn't compared through text
    as_number = lambda c: F.when(number, F.struct(c.try_cast("double"), c.try_cast("decimal(38,0)")))
    return stats.groupBy("column").agg(
        F.coalesce(F.min_by(low, as_number(low)), F.min(low)).alias("min_value"),
        F.coalesce(F.max_by(high, as_number(high)), F.max(high)).alias("max_value"),
        F.sum("n_values").alias("n_values"),
        F.sum("null_count").alias("null_count"),
    )
