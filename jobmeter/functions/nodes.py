"""Expressions over node names and compressed node lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


_NO_NAMES = "array<string>"  # type of an empty list


def _expand_item(prefix: Column, item: Column) -> Column:
    """Names for one comma piece inside brackets: a number range or a single name part."""
    bounds = F.split(item, "-")
    first, last = bounds[0].try_cast("int"), bounds[1].try_cast("int")
    width = F.when(item.startswith("0"), F.length(bounds[0])).otherwise(0)

    def name(number: Column) -> Column:
        digits = number.cast("string")
        return F.concat(prefix, F.lpad(digits, F.greatest(width, F.length(digits)), "0"))

    names = F.when(first <= last, F.transform(F.sequence(first, last), name)).otherwise(F.array().cast(_NO_NAMES))
    return (F.when(item.rlike(r"^\d+-\d+$"), names)
            .when(item == "", F.array().cast(_NO_NAMES))
            .otherwise(F.array(F.concat(prefix, item))))


def _expand_groups(text: Column) -> Column:
    """Names in text with brackets: groups 'prefix', 'prefix[body]' or 'prefix[body' (closing bracket lost)."""
    groups = F.regexp_extract_all(text, F.lit(r"([^,\[]+(?:\[[^\]]*\]?)?)"), F.lit(1))
    # Prefix and items are held in a struct: inside a lambda every mention of an expression is computed again.
    parts = F.transform(groups, lambda g: F.struct(
        F.replace(F.trim(F.substring_index(g, "[", 1)), F.lit("]"), F.lit("")).alias("prefix"),
        F.when(F.instr(g, "[") > 0, F.split(F.replace(F.substr(g, F.instr(g, "[") + 1), F.lit("]"), F.lit("")), ","))
        .alias("items")))
    return F.flatten(F.transform(parts, lambda p: F.when(p["items"].isNull(), F.array(p["prefix"])).otherwise(
        F.flatten(F.transform(p["items"], lambda i: _expand_item(p["prefix"], F.trim(i)))))))


def expand_nodelist(nodelist: Column | str) -> Column:
    """Node names in a compressed list such as 'gpu[08-09,11],cpu1', keeping zero padding.

    Null, blank, 'None assigned' and text without any letter give an empty array.
    """
    text = F.trim(as_column(nodelist))
    nothing = text.isNull() | (text == "None assigned") | text.rlike(r"^[\d\[\],\- ]*$")
    plain = F.transform(F.split(F.replace(text, F.lit("]"), F.lit("")), ","), lambda n: F.trim(n))
    names = F.when(F.instr(text, "[") > 0, _expand_groups(text)).otherwise(plain)
    return F.when(nothing, F.array().cast(_NO_NAMES)).otherwise(F.filter(names, lambda n: n != ""))


def node_pieces(nodelist: Column | str) -> Column:
    """Number of comma pieces in the raw text; ranges are not expanded."""
    pieces = F.filter(F.split(as_column(nodelist), ","), lambda p: F.trim(p) != "")
    return F.coalesce(F.size(pieces), F.lit(0))


def natural_key(name: Column | str) -> Column:
    """Sort key under which 'cpu2' comes before 'cpu11'."""
    runs = F.regexp_extract_all(F.lower(as_column(name)), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"),
                                                F.lpad(r, F.greatest(F.lit(10), F.length(r)), "0")).otherwise(r))
    return F.array_join(padded, "")


def valid_node(name: Column | str) -> Column:
    return as_column(name).rlike(r"^[a-zA-Z][a-zA-Z0-9_-]*$")


def node_type(name: Column | str) -> Column:
    low = F.lower(as_column(name))
    return (F.when(low.contains("gpu"), "gpu")
            .when(low.contains("login"), "login")
            .when(low.contains("storage") | low.contains("nas"), "storage")
            .otherwise("cpu"))
