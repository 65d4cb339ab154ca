"""Document fingerprints: bottom-k sketches of word shingles, in built-in expressions only.

A fingerprint holds the k smallest 64-bit hashes of a text's distinct shingles. Fingerprints of
parts merge into that of the whole; resemblance, containment and the number of distinct
shingles are estimated from fingerprints alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS

#: Hashes kept: the standard error of a resemblance r is sqrt(r * (1 - r) / K), at most 0.045.
K = 128
#: Words in a shingle.
SHINGLE = 5
_WHITE = r"[\x20\x09-\x0D]+"
_LONGS = "array<long>"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in order, lower-cased; null and empty texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WHITE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Bottom-k sketch (sorted array of long) from the word hashes of a text, a column of its own.

    Fewer words than a shingle make one shingle; no words make an empty sketch.
    """
    n = F.size(hashes)
    many = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    shingles = F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast(_LONGS))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the texts of two sketches; of two empty ones, 1."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact where there are fewer than k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``; of an empty one, 1."""
    inside = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(inside, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def from_text(text: Column) -> Column:
    n = (F.length(text) / 16).cast("int")
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    return F.when(n > 0, digits).otherwise(F.array().cast(_LONGS))


def fingerprints(df: DataFrame, text_col: str = "text", *, name: str = "sketch", k: int = K, size: int = SHINGLE) -> DataFrame:
    """``df`` with a column ``name``: the sketch of each row's text.

    Equal texts have equal sketches. Null and empty texts, and those without words, have an empty
    one. All rows and other columns stay; a column called ``name`` is replaced. No shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    return df.withColumn("__hashes", word_hashes(text)).withColumn(name, sketch_of(F.col("__hashes"), k, size)).drop("__hashes")


def merge_parts(df: DataFrame, group_col: str, sketch_col: str = "sketch", *, k: int = K, salts: int = 64) -> DataFrame:
    """(group, sketch): the sketch of all parts of a group together.

    The k smallest hashes are first taken in ``salts`` shares of each group, so a group with very many
    parts is spread; an empty sketch adds nothing, and a group of only those has an empty one.
    """
    parts = df.select(F.col(f"`{group_col}`").alias("group"), F.explode_outer(F.col(f"`{sketch_col}`")).alias("h"))
    parts = parts.distinct().withColumn("salt", F.pmod("h", F.lit(salts)))

    def lowest(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("h")))).where(F.col("rank") <= k)
    few = lowest(lowest(parts, "group", "salt"), "group")
    return few.groupBy("group").agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "id", rows_each: int = 1000) -> DataFrame:
    """``docs`` with a struct ``next``: ``columns`` of the row before it in order of ids, of the last one for the first.

    Rows are dealt into ranges of ids of about ``rows_each`` rows, by quantiles and evenly within them, and put
    in order there. Only the ends of ranges need rows of another range; their number is in proportion
    to the input, and they come by a join on the range, never through one task.
    """
    steps = 64
    stats = docs.agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(id_col, [i / steps for i in range(steps + 1)], 10_000).alias("q")).first()
    ends = sorted(set(stats.q or []))
    each = max(1, -(-stats.n // (rows_each * max(1, len(ends) - 1))))
    place = F.lit(0).cast("long")
    for i, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
        share = F.floor((F.col(id_col) - F.lit(low)).cast("double") / F.lit(float(high - low)) * each)
        place = F.when(F.col(id_col) >= F.lit(low), F.lit(i * each) + F.greatest(F.lit(0), F.least(share, F.lit(each - 1)))).otherwise(place)
    docs = docs.withColumn("__range", place.cast("long"))
    order = Window.partitionBy("__range").orderBy(F.desc(id_col))
    follows = F.struct(*columns)

    # the first row of each range, and the range whose last row it follows
    heads = docs.groupBy("__range").agg(F.max(id_col).alias("__head"))
    by_block = heads.withColumn("__block", F.floor(F.col("__range") / 1000))
    here = Window.partitionBy("__block").orderBy(F.desc("__range"))
    inside = by_block.withColumn("__before", F.lag("__range").over(here))
    tops = by_block.groupBy("__block").agg(F.min("__range").alias("__lowest"))
    above = tops.withColumn("__before_block", F.lag("__lowest").over(Window.orderBy(F.desc("__block"))))
    before = inside.join(above.select("__block", "__before_block"), "__block").select(
        F.col("__head"), F.coalesce("__before", "__before_block", F.lit(0)).alias("__range"))
    # known size: one head for each range; the semi join goes below what computes the columns
    small = each * len(ends) <= BROADCAST_IDS
    sent = F.broadcast(before) if small else before
    found = docs.join(sent.select(F.col("__head").alias(id_col)), id_col, "left_semi").withColumnRenamed("__range", "__own")
    first = found.join(before, found[id_col] == before["__head"]).select("__range", follows.alias("__first"))
    return (
        docs.withColumn("next", F.lead(follows).over(order)).join(first, "__range", "left")
        .withColumn("next", F.coalesce("next", "__first")).drop("__range", "__first"))
