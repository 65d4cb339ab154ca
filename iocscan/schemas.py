"""Schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

MATCH = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("data", T.BinaryType()),
])

STRING_MATCHES = T.ArrayType(T.StructType([
    T.StructField("identifier", T.StringType()),
    T.StructField("matches", T.ArrayType(MATCH)),
]))

#: One row per finding, with ``part`` 0. A finding in a file that was read in pieces is one row with part 1, which lists the strings without any
#: match (null if there is none), and with part 2 a row for each piece with matches, which lists all strings; sinks put them together.
FINDING = T.StructType([
    T.StructField("scanner", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("artifact_path", T.StringType()),
    T.StructField("found_in_file", T.StringType()),
    T.StructField("value_data", T.StringType()),
    T.StructField("contained_file", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("strings", STRING_MATCHES),
])

SCAN_ERROR = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("message", T.StringType()),
])

#: One row per byte string on which rules are evaluated independently.
UNIT = T.StructType([
    T.StructField("artifact_path", T.StringType()),
    T.StructField("found_in_file", T.StringType()),
    T.StructField("unit_kind", T.StringType()),
    T.StructField("unit_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("filepath", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("filetype", T.StringType()),
    T.StructField("md5", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("value_data", T.StringType()),
    T.StructField("contained_file", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
])

#: Scanner names as they appear in the first output column.
YARA, FILENAME, LEVENSHTEIN, HASH = "Yara", "Filename", "Levenshtein", "Hash"
