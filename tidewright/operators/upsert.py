"""Key differences and upserts of reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty keys of ``wanted`` that ``known`` lacks."""
    return wanted.select(key).filter(F.col(key) != "").distinct().join(known.select(key).distinct(), key, "left_anti")


def needs_refresh(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns is null or blank."""
    test = F.lit(False)
    for c in columns:
        test = test | (F.trim(F.coalesce(c, F.lit(""))) == "")
    return df.filter(test)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` whose keys ``new`` lacks, and all of ``new``; columns missing on a side are null."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
