"""Schemas that start with a field of any name and type."""

from __future__ import annotations

from pyspark.sql.types import StructField, StructType


def schema(first: StructField, rest: str) -> StructType:
    """The field and those of a DDL text: names that DDL would have to quote stay as they are."""
    return StructType([first, *StructType.fromDDL(rest)])
