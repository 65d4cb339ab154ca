"""Detectors on names: filename patterns and near misses of a watch-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from iocscan.functions.names import SHORTENED, WHOLE, edit_keys, one_edit_apart
from iocscan.operators.findings import exploded, finding, positions_where
from iocscan.schemas import FILENAME, LEVENSHTEIN
from iocscan.session import has_at_most

#: Watch-lists up to this size become one expression per row, larger ones a join.
INLINE_NAMES = 64
#: So many filename patterns become expressions of one row, more of them a join.
INLINE_PATTERNS = 64
#: Pattern tables up to this size are broadcast, larger ones are shuffled.
BROADCAST_PATTERNS = 20_000
#: Characters of the grams on which names and patterns meet.
GRAM = 3
#: Watch-lists up to this size are broadcast, larger ones are shuffled. With
#: about thirty short keys per name this stays well under 100 MB.
BROADCAST_NAMES = 20_000


def exclude_names(artifacts: DataFrame, pattern: str | None) -> DataFrame:
    """Drop artifacts whose basename matches (Java form of) the pattern."""
    return artifacts if pattern is None else artifacts.where(~F.col("basename").rlike(pattern))


def name_tests(patterns: Sequence[tuple[str, str]], watched: Sequence[str]) -> list[tuple[str, str, Column]]:
    """(scanner, rule name, condition) for each pattern and each name of a short watch-list.

    Patterns and names are literals, so they are compiled once per task and all
    of them are tested in the same pass.
    """
    name = F.col("basename")
    return [
        *[(FILENAME, pattern, name.rlike(java)) for pattern, java in patterns],
        *[(LEVENSHTEIN, known, one_edit_apart(name, F.lit(known))) for known in watched],
    ]


def _grams(text: Column) -> Column:
    """Distinct runs of ``GRAM`` characters."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def pattern_pairs(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(basename, pattern, times) of distinct names and the patterns of a table (pattern, java, literal, times) that match them.

    A pattern with a literal meets the names that share one gram of it, the one that fewest names have; a gram that no name has rules
    the pattern out. Only names that meet a pattern and contain its literal are tested. Patterns without a literal long enough are
    tested against every name, all in one pass.
    """
    keyed = F.length("literal") >= GRAM
    grams = exploded(names, _grams(F.col("basename")), "gram", "basename")
    wanted = exploded(patterns.where(keyed), _grams(F.col("literal")), "gram", "pattern", "java", "literal", "times")
    few = has_at_most(patterns, BROADCAST_PATTERNS)
    asked = wanted.select("gram").distinct()
    uses = grams.join(F.broadcast(asked) if few else asked, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    rarest = wanted.join(uses, "gram", "left").groupBy("pattern", "java", "literal", "times").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("key"))
    keys = rarest.where("key.uses > 0").select(F.col("key.gram").alias("gram"), "pattern", "java", "literal", "times")
    met = grams.join(F.broadcast(keys) if few else keys, "gram")
    found = met.where(F.contains("basename", "literal") & F.rlike("basename", F.col("java"))).select("basename", "pattern", "times")
    rest = patterns.where(~keyed).select("pattern", "java", "times").collect()
    if not rest:
        return found
    tests = positions_where([(i, F.col("basename").rlike(r.java)) for i, r in enumerate(rest, 1)])
    rows = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.times).cast("long").alias("times")) for r in rest])
    hits = exploded(names, tests, "at", "basename").select("basename", F.element_at(rows, F.col("at")).alias("hit"))
    return found.union(hits.select("basename", "hit.pattern", "hit.times"))


def pattern_findings(artifacts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings of filename patterns given as a table (see ``pattern_pairs``) of any size, one for each time a pattern was given.

    Names are made distinct first, and the pairs joined back to the files; a name that very many files
    carry is split by adaptive execution. Null names match nothing.
    """
    tasks = int(artifacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = artifacts.select("path", "basename")
    pairs = pattern_pairs(files.where(F.col("basename").isNotNull()).select("basename").distinct().repartition(tasks), patterns)
    hits = exploded(
        files.join(pairs, "basename"), F.array_repeat(F.lit(1), F.col("times").cast("int")), "time", "path", "pattern")
    return hits.select(finding(FILENAME, F.col("pattern"), F.col("path"), F.col("path")).alias("f")).select("f.*")


def near_miss_pairs(names: DataFrame, known: DataFrame, broadcast: bool) -> DataFrame:
    """(basename, known) pairs one edit apart, as an equi-join.

    Names of equal length meet on the string that is left without the character
    in which they differ, at its position; names of different length meet where
    one is a deletion of the other. Every pair comes out exactly once, and apart
    from equal names nothing else meets, so neither a distance nor a ``distinct``
    is needed after the join.
    """
    left = exploded(names, edit_keys(F.col("basename"), WHOLE, SHORTENED), "key", "basename")
    right = exploded(known, edit_keys(F.col("known"), SHORTENED, WHOLE), "key", "known").select(
        "known", "key.variant", "key.mark"
    )
    return (
        left.select("basename", "key.variant", "key.mark")
        .join(F.broadcast(right) if broadcast else right, ["variant", "mark"])
        .where(F.col("basename") != F.col("known"))
        .select("basename", "known")
    )


def near_misses(artifacts: DataFrame, known: DataFrame) -> DataFrame:
    """Findings for a watch-list of any size given as a table with ``known``.

    Names are made distinct first (partial aggregation absorbs a name that very
    many files carry), and the pairs found are joined back to the files.
    """
    # Each name grows to some thirty keys. Adaptive execution would put the few
    # bytes of the distinct names into very few tasks; a fixed number is not merged.
    tasks = int(artifacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.select("known").distinct()
    small = has_at_most(known, BROADCAST_NAMES)
    files = artifacts.select("path", "basename")
    pairs = near_miss_pairs(
        files.select("basename").distinct().repartition(tasks), known if small else known.repartition(tasks), small
    )
    # the rows of a name that very many files carry are split by adaptive execution
    hits = files.join(pairs, "basename")
    return hits.select(
        finding(LEVENSHTEIN, F.col("known"), F.col("path"), F.col("path")).alias("f")
    ).select("f.*")


def known_name_list(spark: SparkSession, known: DataFrame) -> list[str] | None:
    """The watch-list itself when it is short enough to be inlined, else None."""
    rows = known.select("known").limit(INLINE_NAMES + 1).collect()
    return [r.known for r in rows] if len(rows) <= INLINE_NAMES else None
