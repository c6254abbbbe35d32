"""Rows that stand for several jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column with the number of jobs that a row of a reduced table stands for.
WEIGHT = "_jobs"


def job_count(df: DataFrame) -> Column:
    """Aggregate: the number of jobs, in a table of jobs or a reduced one."""
    return F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))


def job_count_if(df: DataFrame, test: Column) -> Column:
    """Aggregate: the number of jobs for which ``test`` holds."""
    return F.coalesce(F.sum(F.when(test, F.col(WEIGHT))), F.lit(0)) if WEIGHT in df.columns else F.count_if(test)


def submit_bounds(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates: the first and the last submit."""
    return (F.min("_first"), F.max("_last")) if WEIGHT in df.columns else (F.min("Submit"), F.max("Submit"))
