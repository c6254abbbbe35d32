"""Expressions over the text fields of a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def account_prefix(account: Column | str, segments: int | None = 3, sep: str = "-") -> Column:
    """First ``segments`` parts of an account name; 0 or None keeps the whole name."""
    account = as_column(account)
    return F.substring_index(account, sep, segments) if segments else account


def primary_partition(partition: Column | str) -> Column:
    return F.trim(F.substring_index(as_column(partition), ",", 1))


def partition_list(partition: Column | str) -> Column:
    """Partitions named in a comma list, trimmed, without empty pieces."""
    pieces = F.transform(F.split(as_column(partition), ","), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")


def clean_text(c: Column | str, default: str | None = "unknown") -> Column:
    """Trimmed text; null, blank, 'nan' and 'none' become ``default``."""
    c = F.trim(as_column(c))
    missing = c.isNull() | F.lower(c).isin("", "nan", "none")
    return F.when(missing, F.lit(default).cast("string")).otherwise(c)


def job_state(c: Column | str, first_word: bool = False) -> Column:
    """State without its ' by <uid>' tail; ``first_word`` keeps only the first word, as the weekly collector does."""
    text = clean_text(c, "UNKNOWN")
    cut = F.substring_index(text, " " if first_word else " by ", 1)
    return F.trim(cut)


def state_class(state: Column | str) -> Column:
    """'completed', 'failed' or null for states that count as neither."""
    state = as_column(state)
    return F.when(state == "COMPLETED", "completed").when(
        state.isin("FAILED", "TIMEOUT", "CANCELLED"), "failed")


def is_present(c: Column | str) -> Column:
    c = F.trim(as_column(c))
    return c.isNotNull() & ~F.lower(c).isin("", "nan")


def array_job(job_id: Column | str) -> Column:
    """Struct (JobID, TaskIndex) of an id such as '123_7'; TaskIndex is '' for a plain job."""
    parts = F.split(as_column(job_id), "_")
    return F.struct(
        F.get(parts, F.lit(0)).alias("JobID"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("TaskIndex"))


# AllocTRES -----------------------------------------------------------------------------------------

def _tres_entries(tres: Column) -> Column:
    """Array of (key, value) for every 'key=value' piece."""
    pieces = F.filter(F.split(tres, ","), lambda p: F.instr(p, "=") > 0)
    return F.transform(pieces, lambda p: F.struct(
        F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"),
        F.substr(p, F.instr(p, "=") + 1).alias("value")))


def _last_value(entries: Column, test) -> Column:
    return F.get(F.reverse(F.filter(entries, lambda e: test(e["key"]))), F.lit(0))["value"]


def parse_tres(tres: Column | str) -> Column:
    """Struct (cpus, gpus, mem_mb, nodes) from text such as 'cpu=4,mem=16G,gres/gpu=2,node=1'; absent parts are 0.

    Any key containing cpu, gpu or mem counts, tested in that order; the last such entry wins.
    """
    is_cpu = lambda k: k.contains("cpu")
    is_gpu = lambda k: k.contains("gpu") & ~k.contains("cpu")
    is_mem = lambda k: k.contains("mem") & ~k.contains("cpu") & ~k.contains("gpu")

    def whole(text: Column) -> Column:
        return F.coalesce(text.try_cast("int"), F.lit(0))

    def fields(entries: Column) -> Column:
        return F.struct(
            whole(_last_value(entries, is_cpu)).alias("cpus"),
            whole(_last_value(entries, is_gpu)).alias("gpus"),
            F.floor(memory_gb(_last_value(entries, is_mem)) * 1024).cast("long").alias("mem_mb"),
            whole(_last_value(entries, lambda k: k == "node")).alias("nodes"))

    # The entries are bound to a lambda variable, so that the text is split once and not once per field.
    entries = _tres_entries(F.coalesce(as_column(tres), F.lit("")))
    return F.transform(F.array(entries), fields)[0]


def memory_gb(text: Column | str, strict: bool = False) -> Column:
    """Memory text with unit M or G as GB. Other units are 0, or an error when ``strict``."""
    text = F.upper(F.trim(as_column(text)))
    number = F.substr(text, F.lit(1), F.length(text) - 1).try_cast("double")
    other = F.raise_error(F.concat(F.lit("unsupported memory unit in "), text)).cast("double") if strict else F.lit(0.0)
    gb = F.when(text.endswith("G"), number).when(text.endswith("M"), number / 1024)
    return F.when(text.isNull(), 0.0).otherwise(F.coalesce(gb, other))


# Labels --------------------------------------------------------------------------------------------

def account_short_name(account: Column | str) -> Column:
    account = as_column(account)
    return F.when(account.contains("-"), F.upper(F.substring_index(account, "-", -1))).otherwise(account)


def partition_title(partition: Column | str) -> Column:
    partition = as_column(partition)
    first = F.upper(F.substring(partition, 1, 1))
    rest = F.lower(F.substr(partition, F.lit(2)))
    return F.concat(first, rest, F.lit(" Partition"))
