"""Expressions over binary content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Leading bytes of the content types that are routed specially
# (public format descriptions).
MAGIC = {
    "gz": "1F8B",
    "bz2": "425A68",
    "xz": "FD377A585A00",
    "zip": "504B0304",
    "evtx": "456C6646696C6500",
    "reg": "72656766",
}


def file_type(content: Column) -> Column:
    """Routing tag from the leading bytes, ``raw`` when none is known."""
    tag = F.lit("raw")
    for name, prefix in reversed(MAGIC.items()):
        tag = F.when(F.startswith(content, F.lit(bytes.fromhex(prefix))), F.lit(name)).otherwise(tag)
    return F.when(content.isNull(), F.lit("raw")).otherwise(tag)


def latin1(content: Column) -> Column:
    """One character per byte, so that character positions are byte offsets."""
    return F.decode(content, "ISO-8859-1")


def escape_bytes(data: Column) -> Column:
    r"""Printable ASCII as it is, all other bytes (and the space) as ``\xx``.

    Each byte value that occurs is replaced in one go. The replacements consist
    of printable ASCII only, so their order does not matter.
    """
    text = latin1(data)
    others = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x21-\x7e]"), F.lit(0)))
    return F.aggregate(
        others, text,
        lambda done, c: F.replace(done, c, F.concat(F.lit("\\"), F.lower(F.hex(F.encode(c, "ISO-8859-1"))))),
    )


def registry_display(key_path: Column, value_name: Column, value: Column) -> Column:
    return F.concat(key_path, F.lit("/@"), value_name, F.lit(" = '"), value, F.lit("'"))
