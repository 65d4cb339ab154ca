"""Digest detector: content digests that are in an indicator list."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from iocscan.operators.findings import exploded, finding
from iocscan.schemas import HASH
from iocscan.session import has_at_most

#: Lists up to this size are collected and kept as local rows.
LOCAL_HASHES = 20_000
#: Lists up to this size are broadcast (about 100 bytes a row when hashed).
BROADCAST_HASHES = 500_000
# Digest kinds in the order in which they are reported.
ALGORITHMS = ("MD5", "SHA1", "SHA256")


@dataclass
class HashList:
    """An indicator list (``algo, digest``) of known size class."""

    table: DataFrame
    algorithms: list[str]
    small: bool

    @classmethod
    def of(cls, iocs: DataFrame, broadcast_limit: int = BROADCAST_HASHES) -> HashList:
        """Look at the list once: a short one is kept as local rows.

        Otherwise only its size class and the digest kinds in it are found out;
        no other digests are computed later. A long list is kept on the executors
        meanwhile, as it may be costly to derive; lost blocks are derived again.
        """
        limit = min(LOCAL_HASHES, broadcast_limit)
        iocs = iocs.persist(StorageLevel.MEMORY_AND_DISK)
        rows = iocs.select("algo", "digest").limit(limit + 1).collect()
        if len(rows) <= limit:
            kinds = {r.algo for r in rows}
            iocs.unpersist()
            table = iocs.sparkSession.createDataFrame(rows, "algo string, digest string")
            return cls(table, [a for a in ALGORITHMS if a in kinds], True)
        kinds = {r.algo for r in iocs.select("algo").distinct().limit(len(ALGORITHMS)).collect()}
        small = broadcast_limit > limit and has_at_most(iocs, broadcast_limit)
        return cls(iocs, [a for a in ALGORITHMS if a in kinds], small)


def digest_column(algo: str, content: Column) -> Column:
    if algo == "MD5":
        return F.md5(content)
    return F.sha1(content) if algo == "SHA1" else F.sha2(content, 256)


def shown_digests(algos: Iterable[str], content: Column) -> list[Column]:
    """``ALGO:hex`` of the content for each kind."""
    return [F.concat(F.lit(f"{a}:"), digest_column(a, content)) for a in algos]


def hash_rows(artifacts: DataFrame, algos: list[str]) -> DataFrame:
    """(path, basename, algo, digest); the content is dropped right here.

    Digests that the source has already computed (columns named like the
    algorithm in lower case) are used as they are.
    """
    ready = [a for a in algos if f"digest_{a.lower()}" in artifacts.columns]
    parts = [
        F.struct(
            F.lit(a).alias("algo"),
            (F.col(f"digest_{a.lower()}") if a in ready else digest_column(a, F.col("content"))).alias("digest"),
        )
        for a in algos
    ]
    return exploded(artifacts, F.array(*parts), "d", "path", "basename").select(
        "path", "basename", "d.algo", "d.digest"
    )


def hash_matches(artifacts: DataFrame, hashes: HashList) -> DataFrame:
    """Rows of ``hash_rows`` whose digest is in the list."""
    rows = hash_rows(artifacts, hashes.algorithms)
    if hashes.small:
        return rows.join(F.broadcast(hashes.table), ["algo", "digest"], "left_semi")
    # of a digest that very many files share, adaptive execution splits the rows; the list itself is never copied
    return rows.join(hashes.table.select("algo", "digest"), ["algo", "digest"], "left_semi")


def hash_finding() -> Column:
    """Digest findings name the file by its basename, other detectors by its path."""
    return finding(
        HASH, F.concat_ws(":", "algo", "digest"), F.col("path"), F.col("basename")
    )


def hash_findings(artifacts: DataFrame, hashes: HashList) -> DataFrame:
    return (
        hash_matches(artifacts, hashes)
        .select(hash_finding().alias("f")).select("f.*")
    )
