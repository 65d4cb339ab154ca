"""Findings as CSV lines, JSON lines and readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from iocscan.functions.content import escape_bytes
from iocscan.schemas import FILENAME, FINDING, HASH, LEVENSHTEIN, STRING_MATCHES, YARA

_KEEP_NULLS = {"ignoreNullFields": "false"}


_KEY = [c for c in FINDING.fieldNames() if c not in ("part", "strings")]


def whole_findings(findings: DataFrame) -> DataFrame:
    """One row per finding, with all its strings: what pieces of a file have is put together in order of offsets.

    Only findings in files that were read in pieces are shuffled, match by match first combined by string. What ``part`` is
    is known to the plan, so where nothing was read in pieces nothing is added to it.
    """
    own = [F.coalesce(c, F.lit("")).alias(c) for c in _KEY] + [F.struct(*[F.col(c).isNull() for c in _KEY]).alias("_null")]
    key = [*_KEY, "_null"]
    pieces = findings.where("part = 2").select(*own, F.posexplode("strings").alias("place", "s"))
    strings = pieces.groupBy(*key, "place", F.col("s.identifier").alias("identifier")).agg(
        F.array_sort(F.flatten(F.collect_list("s.matches"))).alias("matches"))
    strings = strings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "identifier", "matches"))).alias("found"))
    strings = strings.select(*key, F.transform("found", lambda s: F.struct(s["identifier"], s["matches"])).alias("found"))
    heads = findings.where("part = 1").select(*own, "strings").join(strings, key, "left")
    heads = heads.select(
        *[F.when(~F.col("_null")[f"col{i + 1}"], F.col(c)).alias(c) for i, c in enumerate(_KEY)], F.lit(0).cast("long").alias("part"),
        F.coalesce(F.col("found").cast(STRING_MATCHES), "strings").alias("strings"))
    return findings.where("part = 0").unionByName(heads)


def _string_details(value: Column) -> Column:
    """One text per match; a string without a match is shown by its identifier, but not for a piece."""
    def of_string(s: Column) -> Column:
        bare = F.when(value.isNull(), s["identifier"]).otherwise(F.concat(s["identifier"], F.lit(" in "), value))
        matches = F.transform(s["matches"], lambda m: F.concat(
            s["identifier"], F.lit(" at offset "), F.lower(F.hex(m["offset"])), F.lit(": "), escape_bytes(m["data"]),
            F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(" in ("), value, F.lit(")"))),
        ))
        return F.when((F.size(s["matches"]) == 0) & (F.col("part") < 2), F.array(bare)).otherwise(matches)

    return F.flatten(F.transform("strings", of_string))


def csv_lines(findings: DataFrame, details: bool = False) -> DataFrame:
    """``scanner_name, rule_name, found_in_file, details``; equal lines of one finding once."""
    nothing = F.array(F.lit(""))
    first = findings if details else findings.where("part < 2")
    # a head without strings says that all have a match
    lines = F.when(
        F.coalesce(F.size("strings"), F.lit(0)) > 0, F.array_distinct(_string_details(F.col("value_data")))
    ).otherwise(F.when((F.col("part") == 0) | F.col("strings").isNotNull(), nothing)) if details else nothing
    return first.select(
        F.col("scanner").alias("scanner_name"), "rule_name", "found_in_file", F.explode(lines).alias("details")
    )


def json_lines(findings: DataFrame) -> DataFrame:
    """``value``: one JSON object per finding, all keys present even when null.

    Findings of rules need their strings (``scan`` with ``details``): without them the job fails, as an empty list would say that nothing matched.
    """
    findings = whole_findings(findings)
    shown = F.transform("strings", lambda s: F.struct(
        s["identifier"].alias("identifier"),
        F.transform(s["matches"], lambda m: F.struct(
            m["offset"].alias("offset"), escape_bytes(m["data"]).alias("data")
        )).alias("matches"),
    ))
    file = F.col("found_in_file").alias("02_suspicious_file")

    def line(scanner: str, *columns: Column) -> Column:
        return F.to_json(F.struct(F.lit(scanner).alias("01_scanner"), file, *columns), _KEEP_NULLS)

    scanner = F.col("scanner")
    return findings.select(
        F.when(scanner == FILENAME, line("filename", F.col("rule_name").alias("03_pattern")))
        .when(scanner == LEVENSHTEIN, line("levenshtein", F.col("rule_name").alias("03_original_name")))
        .when(scanner == HASH, line("hash", F.col("rule_name").alias("03_hash")))
        .when(scanner == YARA, line(
            "yara", F.col("value_data").alias("03_value"),
            F.coalesce(shown, F.raise_error(F.lit("JSON lists the strings of rules: scan with details=True")).cast(
                "array<struct<identifier:string,matches:array<struct<offset:bigint,data:string>>>>"
            )).alias("04_strings"),
            F.col("contained_file").alias("05_contained_file"),
        ))
        .otherwise(F.to_json(F.struct(
            F.lower(scanner).alias("01_scanner"), file, F.col("rule_name").alias("03_rule"),
            F.col("value_data").alias("04_value"),
        ), _KEEP_NULLS)).alias("value")
    )


def text_lines(findings: DataFrame, details: bool = False) -> DataFrame:
    """``value``: readable text, with ``details`` followed by indented lines for the strings."""
    scanner, file, rule, value = (F.col(c) for c in ("scanner", "found_in_file", "rule_name", "value_data"))

    def of_string(s: Column) -> Column:
        name = s["identifier"]
        bare = F.when(value.isNull(), F.concat(F.lit("  "), name, F.lit(" matches"))).otherwise(
            F.concat(F.lit("  '"), value, F.lit("' matches to "), name)
        )
        head = F.when(value.isNull(), F.concat(F.lit("  "), name, F.lit(" has the following matches:"))).otherwise(
            F.concat(F.lit("  "), name, F.lit(" has the following matches in '"), value, F.lit("':"))
        )

        def of_match(m: Column) -> Column:
            code = F.lower(F.hex(m["offset"]))
            wide = F.lpad(code, F.greatest(F.length(code), F.lit(8)), F.lit("0"))
            return F.concat(F.lit("    0x"), wide, F.lit(": "), escape_bytes(m["data"]))

        return F.when(F.size(s["matches"]) == 0, F.array(bare)).otherwise(
            F.concat(F.array(head), F.transform(s["matches"], of_match))
        )

    title = F.concat(
        F.when(scanner == YARA, "Yara: ").otherwise(F.concat(scanner, F.lit(": "))), rule, F.lit(" "), file
    )
    strings = F.coalesce(F.flatten(F.transform("strings", of_string)), F.array().cast("array<string>"))
    other = F.array_join(F.concat(F.array(title), strings) if details else F.array(title), "\n")
    shown = whole_findings(findings) if details else findings.where("part < 2")
    return shown.select(
        F.when(scanner == FILENAME, F.concat(
            F.lit("the name of '"), file, F.lit("' matches the pattern /"), rule, F.lit("/")
        )).when(scanner == LEVENSHTEIN, F.concat(
            F.lit("the name of the file "), file, F.lit(" is very similar to "), rule
        )).when(scanner == HASH, F.concat(
            F.lit("file "), file, F.lit(" has the hash value "), rule
        )).otherwise(other).alias("value")
    )


def suspicious_files(findings: DataFrame) -> DataFrame:
    """The distinct files that findings name."""
    return findings.select("found_in_file").distinct()
