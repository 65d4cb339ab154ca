"""Indicator lists: digests, filename patterns, watch-lists of names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from iocscan.functions.names import WELL_KNOWN_NAMES
from iocscan.functions.patterns import checked_name_patterns, name_pattern, required_literal


def hash_iocs(hashes: DataFrame, column: str = "hash") -> DataFrame:
    """(algo, digest) of a table of hex digests, each once.

    The kind follows from the length. A value that is no hex digest of 16, 20 or
    32 bytes fails the job, as a typing error in an indicator must not go unseen.
    """
    value = F.col(column)
    algo = (
        F.when(F.length(value) == 32, "MD5")
        .when(F.length(value) == 40, "SHA1")
        .when(F.length(value) == 64, "SHA256")
    )
    checked = F.when(value.rlike(r"^[0-9A-Fa-f]+\z") & algo.isNotNull(), F.lower(value)).otherwise(
        F.raise_error(F.concat(F.lit("invalid hash '"), F.coalesce(value, F.lit("NULL")), F.lit("'")))
    )
    return (
        hashes.select(checked.alias("digest"))
        .select(
            F.when(F.length("digest") == 32, "MD5").when(F.length("digest") == 40, "SHA1")
            .otherwise("SHA256").alias("algo"),
            "digest",
        )
        .dropDuplicates(["algo", "digest"])
    )


def hash_list(spark: SparkSession, hashes: Iterable[str]) -> DataFrame:
    """The same from a Python list given as an option."""
    rows = [(h,) for h in hashes]
    return hash_iocs(spark.createDataFrame(rows, "hash string"))


def filename_patterns(spark: SparkSession, patterns: Iterable[str]) -> list[tuple[str, str]]:
    """(pattern, Java pattern) in the given order; a pattern given twice stays twice."""
    patterns = list(patterns)
    return list(zip(patterns, checked_name_patterns(spark, patterns))) if patterns else []


def pattern_table(spark: SparkSession, patterns: Iterable[str] | DataFrame) -> DataFrame:
    """(pattern, java, literal, times) of any number of patterns, each once: Java form, a string its matches contain, and how often it was given.

    From strings or a table with ``pattern``. Null patterns are left out; a bad one fails when the table is computed.
    """
    if not isinstance(patterns, DataFrame):
        patterns = spark.createDataFrame([(p,) for p in patterns], "pattern string")

    def translated(frames):
        for frame in frames:
            frame["java"] = [name_pattern(p) for p in frame["pattern"]]
            frame["literal"] = [required_literal(p) for p in frame["pattern"]]
            yield frame
    counted = patterns.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count(F.lit(1)).alias("times"))
    table = counted.mapInPandas(translated, "pattern string, times long, java string, literal string")
    # every pattern is compiled once, so that a bad one does not depend on the names
    return table.where(F.rlike(F.lit(""), F.col("java")).isNotNull())


def known_names(spark: SparkSession, names: Iterable[str] = WELL_KNOWN_NAMES) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, known string")
