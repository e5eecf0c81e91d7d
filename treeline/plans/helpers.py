"""Shared by the modules that register queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relations import oracle, relation
from ..session import table
from .registry import query

__all__ = ["F", "oracle", "query", "relation", "rounded", "table"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that engines that add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
