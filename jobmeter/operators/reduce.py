"""Jobs reduced by several sets of keys in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import WEIGHT

#: Columns of a reduced row beside its keys: the jobs it stands for, their hours (summed under the names that jobs have them), sums and numbers of
#: waiting times and of positive durations, and the first and last submit.
MEASURES = [WEIGHT, "CPUHours", "GPUHours", "_waited", "_waits", "_ran", "_runs", "_first", "_last"]


def reduce_by(jobs: DataFrame, sets: Mapping[str, Sequence[str]], always: Sequence[str] = (), extra: Sequence[Column] = (), gathered: bool = False) -> DataFrame:
    """One row per set of keys (named in ``set``) and values of its keys and of ``always``; keys of other sets are null.

    Columns are named as those of jobs, so operators on jobs take the rows of a set instead. ``extra`` are further aggregates. Every task reduces its jobs
    before the one shuffle. ``gathered`` jobs, of which a task has all with the same values of ``always``, are reduced where they are, without a shuffle.
    """
    sets = {name: list(dict.fromkeys([*always, *keys])) for name, keys in sets.items()}
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    measures = [
        F.count(F.lit(1)).alias(WEIGHT), F.sum("CPUHours").alias("CPUHours"), F.sum("GPUHours").alias("GPUHours"),
        F.sum("_w").alias("_waited"), F.count("_w").alias("_waits"), F.sum("_r").alias("_ran"), F.count("_r").alias("_runs"),
        F.min("Submit").alias("_first"), F.max("Submit").alias("_last")]
    given = jobs.withColumns({"_w": F.col("WaitingTimeHours"), "_r": F.when(F.col("ElapsedHours") > 0, F.col("ElapsedHours"))})
    if gathered:
        own = [k for k in keys if k not in always]
        row = lambda name, those: F.struct(F.lit(name).alias("set"), *[(F.col(k) if k in those else F.lit(None).cast(jobs.schema[k].dataType)).alias(k) for k in own])
        given = given.select(*[c for c in given.columns if c not in own], F.inline(F.array(*[row(name, those) for name, those in sets.items()])))
        return given.groupBy(*always, "set", *own).agg(*measures, *extra)
    cube = given.groupingSets([[F.col(k) for k in s] for s in sets.values()], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_id"), *measures, *extra)
    name = F.lit(None).cast("string")
    for set_name, own in sets.items():
        absent = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        name = F.when(F.col("_id") == absent, set_name).otherwise(name)
    return cube.withColumn("set", name).drop("_id")
