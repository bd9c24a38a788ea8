"""Type names users write in configurations, and casts that never throw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted type names.
CAST_TYPES: dict[str, T.DataType] = {
    "int": T.LongType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "float32": T.FloatType(),
    "str": T.StringType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}


def safe_cast(value: Column, type_name: str) -> Column:
    """Cast, with null where the value does not fit; an unknown type name leaves the value alone."""
    target = CAST_TYPES.get(type_name.lower())
    return value if target is None else value.try_cast(target)


def parse_date(value: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Date in the given pattern, null where it does not parse."""
    return F.try_to_date(value, pattern) if hasattr(F, "try_to_date") else F.try_to_timestamp(
        value, F.lit(pattern)
    ).cast("date")
