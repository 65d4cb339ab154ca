"""String leaves of JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from iocscan.operators.findings import exploded

#: Levels that are opened step by step; what lies deeper is searched as JSON text.
DEPTH = 12
#: A key with its colon, or a string as a group. Neither can be given back, so the search is a loop however long they are.
_TOKEN = r'"(?:[^"\\]++|\\.)*+":|("(?:[^"\\]++|\\.)*+")'


def _deep_strings(node: Column) -> Column:
    """All strings below a variant, at whatever depth: keys are passed over in its JSON text, which has no blanks."""
    found = F.filter(F.regexp_extract_all(F.to_json(node), F.lit(_TOKEN), F.lit(1)), lambda token: token != "")
    return F.transform(found, lambda token: F.variant_get(F.parse_json(token), "$", "string"))


def string_leaves(records: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """All string values at any level of ``data``, and the records in error.

    One level is opened per step by exploding a variant, all of it map-side and evaluated once: a
    node that is no object or array passes through unchanged. Keys, numbers,
    booleans and nulls are no leaves. The result has the columns of ``records``
    and ``leaf``; errors have ``file, record_id, message``.
    """
    parsed = records.select("*", F.try_parse_json("data").alias("_node"))
    names = ", ".join(f"`{c}`" for c in records.columns)
    level = f"SELECT {names}, _node FROM {{parsed}}"
    for _ in range(depth):
        level = (
            f"SELECT {names}, coalesce(t.value, _node) AS _node FROM ({level}), "
            "LATERAL variant_explode_outer(_node) AS t"
        )
    view = records.sparkSession.sql(level, parsed=parsed)
    kind = F.schema_of_variant("_node")
    # an empty container is a leaf without text, not a deeper level
    closed = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~kind.isin("OBJECT<>", "ARRAY<VOID>")
    texts = F.when(kind == "STRING", F.array(F.variant_get("_node", "$", "string"))).when(closed, _deep_strings(F.col("_node")))
    unread = parsed.where(F.col("_node").isNull() & F.col("data").isNotNull()).select(
        "file", "record_id", F.lit("malformed record").alias("message")
    )
    return exploded(view, texts, "leaf", *records.columns), unread
