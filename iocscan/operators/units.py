"""Scan units: the byte strings on which rules are evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from iocscan.functions.content import file_type, registry_display
from iocscan.functions.names import basename, extension
from iocscan.operators.content import may_match
from iocscan.operators.leaves import DEPTH, string_leaves
from iocscan.operators.rules import RuleSet
from iocscan.session import has_at_most

#: File types that are decoded before the scan.
PACKED = ("gz", "bz2", "xz", "zip")
#: Lists of covered files up to this size are broadcast.
BROADCAST_PATHS = 500_000


def artifacts_from(
    table: DataFrame, path: Column, content: Column | None = None, owner: Column | None = None
) -> DataFrame:
    """Artifacts of any table: ``path``, ``basename`` and, if wanted, ``content`` and ``owner``.

    Columns that a later step does not use are never read from the table.
    """
    columns = [path.alias("path"), basename(path).alias("basename")]
    if content is not None:
        columns.append(content.cast("binary").alias("content"))
    if owner is not None:
        columns.append(owner.alias("owner"))
    return table.select(*columns)


def with_externals(artifacts: DataFrame, md5: bool = False) -> DataFrame:
    """Variables that rule conditions can refer to.

    The digest stays ``-`` unless asked for; the owner is ``-`` where the source
    has none.
    """
    have = set(artifacts.columns)
    has_content = "content" in have
    return artifacts.select(
        "*",
        F.col("basename").alias("filename"),
        F.col("path").alias("filepath"),
        extension(F.col("basename")).alias("extension"),
        *([] if "filetype" in have else [(file_type(F.col("content")) if has_content else F.lit("-")).alias("filetype")]),
        (F.md5("content") if md5 and has_content else F.lit("-")).alias("md5"),
        *([] if "owner" in have else [F.lit("-").alias("owner")]),
    )


def raw_units(artifacts: DataFrame) -> DataFrame:
    """The whole content of each artifact (with externals) as one unit."""
    none = F.lit(None).cast("string")
    return artifacts.select(
        F.col("path").alias("artifact_path"), F.col("path").alias("found_in_file"),
        F.lit("raw").alias("unit_kind"), F.col("path").alias("unit_id"),
        "filename", "filepath", "extension", "filetype", "md5", "owner", "content",
        none.alias("value_data"), none.alias("contained_file"), F.lit(False).alias("truncated"),
    )


def chunk_units(pieces: DataFrame) -> DataFrame:
    """Units of large files that come in several rows (see ``sources.files``)."""
    none = F.lit(None).cast("string")
    return with_externals(pieces).select(
        F.col("path").alias("artifact_path"), F.col("path").alias("found_in_file"), F.col("path").alias("unit_id"),
        "filename", "filepath", "extension", "filetype", "md5", "owner", "content",
        none.alias("value_data"), none.alias("contained_file"),
        "chunk_start", "chunk_lead", "chunk_length", "filesize",
    )


def record_units(
    records: DataFrame, depth: int = DEPTH, rules: RuleSet | None = None
) -> tuple[DataFrame, DataFrame]:
    """One unit per string leaf of each record, and the records that could not be read.

    ``records`` has ``file``, ``record_id`` and the JSON text ``data``. A finding
    in a leaf carries the whole record. Where ``rules`` allow it, records in which
    nothing can be found are dropped before they are taken apart.
    """
    candidates = None if rules is None else may_match(rules, F.col("data"))
    leaves, errors = string_leaves(records, depth)
    if candidates is not None:
        leaves, _ = string_leaves(records.where(candidates), depth)
    units = leaves.select(
        F.col("file").alias("artifact_path"), F.col("file").alias("found_in_file"),
        F.lit("record_leaf").alias("unit_kind"),
        F.concat_ws("#", "file", F.col("record_id").cast("string")).alias("unit_id"),
        basename(F.col("file")).alias("filename"), F.col("file").alias("filepath"),
        extension(basename(F.col("file"))).alias("extension"), F.lit("evtx").alias("filetype"),
        F.lit("-").alias("md5"), F.lit("-").alias("owner"),
        F.col("leaf").cast("binary").alias("content"), F.col("data").alias("value_data"),
        F.lit(None).cast("string").alias("contained_file"), F.lit(False).alias("truncated"),
    )
    return units, errors


def registry_units(values: DataFrame) -> DataFrame:
    """One unit per string, per binary value and per element of a multi-string.

    ``values`` has ``hive, key_path, value_name, value_type`` and the value in
    ``s`` (string), ``b`` (binary) or ``multi`` (list). Other types are skipped;
    so are the key names.
    """
    texts = F.when(F.col("value_type") == "string", F.array("s")).when(
        F.col("value_type") == "multi", F.col("multi")
    )
    parts = F.when(
        F.col("value_type") == "binary",
        F.array(F.struct(F.col("b").alias("content"), F.lit("<binary data>").alias("shown"))),
    ).otherwise(F.transform(texts, lambda t: F.struct(t.cast("binary").alias("content"), t.alias("shown"))))
    flat = values.select("hive", "key_path", "value_name", F.posexplode(parts).alias("place", "part"))
    return flat.select(
        F.col("hive").alias("artifact_path"), F.col("hive").alias("found_in_file"),
        F.lit("reg_value").alias("unit_kind"),
        F.concat_ws("#", "hive", F.concat_ws("/@", "key_path", "value_name"), F.col("place").cast("string")).alias("unit_id"),
        basename(F.col("hive")).alias("filename"), F.col("hive").alias("filepath"),
        extension(basename(F.col("hive"))).alias("extension"), F.lit("reg").alias("filetype"),
        F.lit("-").alias("md5"), F.lit("-").alias("owner"),
        F.col("part.content").alias("content"),
        registry_display(F.col("key_path"), F.col("value_name"), F.col("part.shown")).alias("value_data"),
        F.lit(None).cast("string").alias("contained_file"), F.lit(False).alias("truncated"),
    )


def is_plain(expand_archives: bool, records: bool = False, registry: bool = False) -> Column:
    """Whether an artifact (with ``filetype``) is scanned as raw bytes under these options."""
    special = [*(PACKED if expand_archives else ()), *(["evtx"] if records else []), *(["reg"] if registry else [])]
    return ~F.col("filetype").isin(*special) if special else F.lit(True)


def covered_hives(registry_values: DataFrame) -> tuple[DataFrame, bool]:
    """The hives for which there are values (``path``, ``_covered``), and whether they are few."""
    hives = registry_values.select(F.col("hive").alias("path")).distinct()
    return hives.withColumn("_covered", F.lit(True)), has_at_most(hives, BROADCAST_PATHS)
