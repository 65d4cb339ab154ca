"""The common shape of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from iocscan.schemas import FINDING, STRING_MATCHES


def finding(
    scanner: Column | str,
    rule_name: Column,
    artifact_path: Column,
    found_in_file: Column,
    value_data: Column | None = None,
    contained_file: Column | None = None,
    part: Column | None = None,
    strings: Column | None = None,
) -> Column:
    """A finding as one struct column."""
    missing = F.lit(None).cast("string")
    return F.struct(
        (F.lit(scanner) if isinstance(scanner, str) else scanner).alias("scanner"),
        rule_name.alias("rule_name"),
        artifact_path.alias("artifact_path"),
        found_in_file.alias("found_in_file"),
        (missing if value_data is None else value_data).alias("value_data"),
        (missing if contained_file is None else contained_file).alias("contained_file"),
        (F.lit(0).cast("long") if part is None else part.cast("long")).alias("part"),
        (F.lit(None) if strings is None else strings).cast(STRING_MATCHES).alias("strings"),
    )


COLUMNS = FINDING.fieldNames()


def exploded(frame: DataFrame, array: Column, name: str, *kept: str) -> DataFrame:
    """One row per element of an array that is costly to compute.

    A plain ``explode`` makes the optimizer test the size of the array in a
    filter of its own, which evaluates the array twice. The outer form does not;
    the rows it adds for empty arrays are dropped afterwards.
    """
    return frame.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def positions_where(tests: list[tuple[int, Column]]) -> Column:
    """Array of the numbers whose condition is true, in order.

    Written without a lambda, so that it stays in generated code.
    """
    if not tests:
        return F.array().cast("array<int>")
    return F.array_remove(F.array(*[F.when(test, F.lit(i)).otherwise(F.lit(-1)) for i, test in tests]), -1)
