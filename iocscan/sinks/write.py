"""Writers. Every task writes its own part; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from iocscan.sinks.render import csv_lines, json_lines, text_lines


def write_csv(findings: DataFrame, path: str, details: bool = False, mode: str = "errorifexists") -> None:
    """RFC 4180: quotes are doubled, and line breaks stay inside quotes."""
    csv_lines(findings, details).write.mode(mode).csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_json(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line. Findings should come from a scan with ``details=True``."""
    json_lines(findings).write.mode(mode).text(path)


def write_text(findings: DataFrame, path: str, details: bool = False, mode: str = "errorifexists") -> None:
    text_lines(findings, details).write.mode(mode).text(path)
