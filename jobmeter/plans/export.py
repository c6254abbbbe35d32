"""Report sections as CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

# There is no section per user.
SECTIONS = ["summary", "by_account", "by_partition", "by_state", "timeline"]


def export_report(report: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write each section below ``path`` as one file: a report has at most a row per account or per day."""
    written = []
    for name in SECTIONS:
        target = f"{path}/{name}"
        writer = report[name].coalesce(1).write.mode("overwrite")
        (writer.option("header", "true").csv if fmt == "csv" else writer.json)(target)
        written.append(target)
    return written
