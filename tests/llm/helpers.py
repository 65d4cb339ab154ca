"""Small inputs with everything that is easily got wrong."""

import random
import re

from pyspark.sql import types as T

#: Names that operators use inside; as further columns they must not matter.
CLASHING = ["id", "member", "key", "row", "at", "line", "bucket", "spans", "n_words", "score", "label", "chunk", "Text2", "next"]
LOWER = {c: c + 32 for c in range(65, 91)}


def sentence(seed: int, words: int, kinds: int = 400) -> str:
    chosen = random.Random(seed)
    return " ".join(f"w{chosen.randrange(kinds)}" for _ in range(words))


def edited(text: str, seed: int, changes: int) -> str:
    words, chosen = text.split(" "), random.Random(seed)
    for _ in range(changes):
        words[chosen.randrange(len(words))] = f"new{chosen.randrange(1000)}"
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty, blank, short, repeated, tied, very long and near equal texts."""
    base, other = sentence(1, 300), sentence(2, 120)
    rows = [
        (10, base), (11, edited(base, 5, 3)), (12, base), (13, edited(base, 6, 60)), (14, other), (15, other + " tail"),
        (16, None), (17, ""), (18, " \t\n "), (19, "one"), (20, "one two"), (21, "One  TWO"), (22, "naïve Ünïcode ünïcode İstanbul ſ K"),
        (23, sentence(3, 40_000, 5_000)), (24, edited(sentence(3, 40_000, 5_000), 7, 200)), (25, "a " * 3_000), (25, "a " * 3_000),
        (None, base), (None, None), (-3, sentence(9, 50)), (2 ** 40, sentence(9, 50)), (26, "x" * 5_000), (27, "x" * 5_001),
    ]
    rows += [(100 + i, edited(base, 50 + i, 8)) for i in range(25)]
    rows += [(200 + i, sentence(500 + i, 60)) for i in range(20)]
    return rows


def table(spark, rows, schema="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, schema)
    if clash:
        from pyspark.sql import functions as F
        df = df.select(F.lit(7).alias("id"), *df.columns, *[F.lit("no").alias(c) for c in CLASHING[1:]])
    return df


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def white_words(text) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
