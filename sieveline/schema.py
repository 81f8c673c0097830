"""Column checks that fail before any job runs, and JSON-safe numbers."""

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def finite(x: Column) -> Column:
    """null for NaN and infinities, as reports need."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column, default=0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))
