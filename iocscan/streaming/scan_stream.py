"""The row-local detectors on a stream of artifacts.

All detectors are stateless, so the same plan serves a stream: indicator lists
are static, only digests meet a long list in a shuffle, and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from iocscan.api import one_pass
from iocscan.functions.names import WELL_KNOWN_NAMES
from iocscan.functions.patterns import checked_name_patterns
from iocscan.operators.content import rule_findings, uses_arrow
from iocscan.operators.digests import HashList, hash_findings
from iocscan.operators.names import exclude_names
from iocscan.operators.rules import RuleSet
from iocscan.operators.units import raw_units, with_externals
from iocscan.sources.iocs import filename_patterns as pattern_list, hash_iocs, hash_list


def scan_stream(
    artifacts: DataFrame,
    *,
    rules: RuleSet | None = None,
    filename_patterns: Iterable[str] = (),
    known_names: bool | Iterable[str] = False,
    hashes: Iterable[str] | DataFrame = (),
    exclude: str | None = None,
) -> DataFrame:
    """Findings of a streaming DataFrame with ``path, basename, content``; the options are those of ``scan``."""
    spark = artifacts.sparkSession
    if exclude is not None:
        artifacts = exclude_names(artifacts, checked_name_patterns(spark, [exclude])[0])
    watched = WELL_KNOWN_NAMES if known_names is True else list(known_names or ())
    if isinstance(hashes, DataFrame):
        hashes = hashes if {"algo", "digest"} <= set(hashes.columns) else hash_iocs(hashes)
    else:
        hashes = list(hashes)
        hashes = hash_list(spark, hashes) if hashes else None
    listed = None if hashes is None else HashList.of(hashes)
    small = listed if listed is not None and listed.small else None
    arrow = rules is not None and uses_arrow(rules)
    findings = one_pass(
        artifacts, None if arrow else rules, pattern_list(spark, filename_patterns),
        watched, small,
    )
    if listed is not None and not listed.small:
        findings = findings.unionByName(hash_findings(artifacts, listed))
    if arrow:
        findings = findings.unionByName(rule_findings(raw_units(with_externals(artifacts)), rules))
    return findings


def write_stream(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all findings available now to parquet, exactly once, and stop."""
    return (
        findings.writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
