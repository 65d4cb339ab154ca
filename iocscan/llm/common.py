"""Shared helpers: hashing of words, cutting of lineage, groups of linked nodes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import has_at_most, prepare, shuffles_freed, work_folder

#: Odd multipliers of the shingle hash and the splitmix64 finaliser.
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Ids up to which a side of a semi join is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def fold_table(separators: str) -> bytes:
    """For ``bytes.translate``: ASCII letters to lower case, the given ASCII signs to a space."""
    gone = separators.encode()
    return bytes(0x20 if c in gone else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


#: Words are what lies between white space.
WHITE = fold_table(" \t\n\x0b\x0c\r")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes that are hashed at a time; a longer text is hashed alone.
_STRETCH = 1 << 18


@lru_cache(maxsize=4)
def _stretch_powers(base: int) -> np.ndarray:
    out = np.full(_STRETCH + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n - 1."""
    if n <= _STRETCH + 1:
        return _stretch_powers(int(base))[:n]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], fold: bytes = WHITE, least: int = 1) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, which are runs of ``least`` bytes or more that ``fold`` doesn't make a space.

    A word's hash is a polynomial over its bytes, taken from running sums over many texts at once, and mixed.
    """
    out: list[np.ndarray] = []
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) + 1 > _STRETCH:
            out += _stretch_hashes(texts[first:i], fold, least)
            first, size = i, 0
        size += len(text) + 1
    return out + (_stretch_hashes(texts[first:], fold, least) if first < len(texts) else [])


def _stretch_hashes(texts: list[bytes], fold: bytes, least: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]).translate(fold), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 0x20, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if least > 1:
        kept = ends - starts >= least
        starts, ends = starts[kept], ends[kept]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(_ODD, len(data)), out=sums[1:])
    found = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return np.split(found, np.searchsorted(starts, offsets[1:-1]))


def sorted_unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words in order; of a shorter sequence, one hash of all of it."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        total = mix(total * _MULTIPLIERS[i % 8] + words[i:n - width + 1 + i])
    return total


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def binary_values(column: pa.Array) -> list[bytes]:
    """The bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` at most (one row at least)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again, without its lineage; its shuffle files go once it is written."""
    spark = df.sparkSession
    folder = f"{work_folder(spark, 'llm')}/{name}-{uuid.uuid4().hex[:8]}"
    with shuffles_freed(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def texts_of(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Just ``id`` and ``text``, and the columns ``carry`` in a struct ``row``: others, whatever their names, play no part."""
    prepare(df.sparkSession)
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row)


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``ids``, null included; broadcast only after a look at their number."""
    small = has_at_most(ids, BROADCAST_IDS)
    return df.join(F.broadcast(ids) if small else ids, column, "left_anti")


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids``; broadcast only after a look at their number."""
    small = has_at_most(ids, BROADCAST_IDS)
    return df.join(F.broadcast(ids) if small else ids, column, "left_semi")


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _smallest_in_reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        p, q = root[one], root[two]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        one, two, p, q = one[apart], two[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _few_components(links: DataFrame) -> DataFrame:
    """``components`` of links that fit one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)) for batch in batches]
        if held:
            found = _smallest_in_reach(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])
    return cut(links.select("a", "b").repartition(1).mapInArrow(run, "node long, component long"), "groups")


def components(links: DataFrame) -> DataFrame:
    """Connected groups of ``links`` (a, b: long): (node, component), the smallest node naming the group.

    ``BROADCAST_IDS`` links at most (16 MB) are put together by one task, more of them on tables.
    Alternating large-star and small-star steps on tables: each round hangs the
    neighbours of a node on the smallest node in reach, until nothing changes. Minima are
    aggregated before the shuffle, and the join back is an ordinary join whose hot keys
    Spark can split, so a hub with very many links is no problem.
    """
    links = links.where("a <> b")
    if has_at_most(links, BROADCAST_IDS):
        return _few_components(links)
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        after = cut(small, "edges")
        # done once every node hangs on one smaller node that hangs on nothing
        marks = [
            after.groupBy("u").count().where("count > 1").select("u"),
            after.select("v").join(after.select(F.col("u").alias("v")), "v", "left_semi"),
        ]
        edges = after
        if all(not m.take(1) for m in marks):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def linked_groups(
    members: DataFrame, looks: DataFrame, may_link: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Links (a, b) that connect what ``verify`` accepts among the members of each bucket, without testing all pairs.

    ``members`` has (bucket, member), each once; member numbers are hashes, so that their order is random. ``looks`` has
    (member, look): something small of each member, a struct, by which ``may_link`` rules out pairs that
    cannot be linked. ``verify`` gets pairs (a, b) and returns the linked ones.

    Round 0 tests everyone against the most central of the bucket, the member with the most company in all its buckets. Each further round
    tests against about 64 times as many leaders of each bucket, members with the smallest numbers, but only
    pairs whose ends are not yet connected and which ``may_link`` leaves; the last round has everyone as leader. So
    every pair in a bucket is tested, ruled out or already connected, and components are exact. A group of k
    copies costs about k tests, and pairs that are ruled out are never rows.
    """
    sizes = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "sizes")
    company = cut(members.join(sizes, "bucket").groupBy("member").agg(F.sum("size").alias("company")).join(looks, "member"), "company")
    first = members.join(company.select("member", "company"), "member").groupBy("bucket").agg(
        F.max(F.struct("company", "member")).alias("first"))
    pairs = members.join(first, "bucket").select(F.col("first.member").alias("a"), F.col("member").alias("b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (company.select(F.col("member").alias(x), F.col("look").alias(f"look_{x}")) for x in "ab")
    pairs = pairs.join(one, "a").join(two, "b").where(may_link(F.col("look_a"), F.col("look_b"))).select("a", "b")
    links = cut(verify(pairs), "links")

    label = None
    most = sizes.agg(F.max("size")).first()[0] or 0
    reach = 2 if most <= 2 else 1
    while reach < most:
        label = label or components(links)
        now = (
            members.join(sizes.where("size > 2"), "bucket").join(label.withColumnRenamed("node", "member"), "member", "left")
            .select("bucket", "size", "member", F.coalesce("component", "member").alias("component"))
        )
        now = cut(now, "state")
        mixed = now.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        now = cut(now.join(mixed.select("bucket"), "bucket").join(company.select("member", "look"), "member"), "mixed")
        if not now.take(1):
            break
        # share of the 64-bit range below the member's number, times the size
        rank = (F.col("member") / F.lit(2.0 ** 64) + F.lit(0.5)) * F.col("size")
        after = 64 * reach
        leader = now.where((rank <= after) & ((rank > reach) | F.lit(reach == 1)))
        leader = leader.select("bucket", F.col("member").alias("a"), F.col("component").alias("ca"), F.col("look").alias("look_a"))
        pairs = (
            now.join(leader, (now["bucket"] == leader["bucket"]) & (F.col("a") < now["member"]) & (now["component"] != F.col("ca"))
                     & may_link(F.col("look_a"), now["look"]))
            .select("a", now["member"].alias("b")).distinct()
        )
        more = cut(verify(pairs), "links")
        if more.take(1):
            links, label = links.union(more), None
        reach = after
    return links
