"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Every shingle flips one bit of a sketch, so two
sketches differ in at most as many bits as the sets have elements that only one of them holds.
Sets of a and b shingles with Jaccard similarity s or more differ in at most
``(a + b) * (1 - s) / (1 + s)`` elements. Within a band of sizes a sketch has more parts than that
bound at the band's upper end, so linked sets agree in at least one whole part
(pigeonhole). Equal parts are found by an equi-join, and what meets there is verified on texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    BROADCAST_IDS, binary_values, components, cut, linked_groups, mix, only_ids, shingle_hashes, signed, small_batches, sorted_unique,
    texts_of, word_hashes,
)

@lru_cache(maxsize=4)
def _bands(percent: int) -> list[int]:
    """Lower ends of size bands, so wide that linked sizes lie in one band or in neighbours."""
    ends = [1, 2]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * 100 // percent + 1))
    return ends


def _most_different(total: int, percent: int) -> int:
    """Elements in which two sets of ``total`` elements together may differ when linked."""
    return total * (100 - percent) // (100 + percent)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ASCII lower case, split at ASCII white space."""
    return [sorted_unique(shingle_hashes(words, size)) for words in word_hashes(texts)]


def _identity(found: np.ndarray) -> int:
    """A 64-bit number that names a set, by its members and their count."""
    total = np.bitwise_xor.reduce(mix(found), keepdims=True)
    return int(mix(total + mix(np.array([len(found)], np.uint64))).view(np.int64)[0])


def sketch(found: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of ``words`` 64-bit words: every element flips one bit."""
    places = (((found >> np.uint64(32)) * np.uint64(words * 64)) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(places, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


@lru_cache(maxsize=4096)
def _parts(label: int, percent: int) -> tuple[int, int]:
    """(parts, spare) of the sketch of a size band and the one below: ``spare`` parts more than linked sets need.

    Linked sets agree in at least ``spare + 1`` parts. An empty part says nothing, so there are enough spare ones to
    have an agreeing part that is not empty, unless both sets leave more than ``spare`` parts empty.
    """
    ends = _bands(percent)
    most = _most_different(2 * (ends[label + 1] - 1), percent)
    if not most:  # only equal sets are linked, and those are one member already
        return 0, 0
    empty = (most + 1) * np.exp(-ends[max(0, label - 1)] / (most + 1))
    spare = int(np.ceil(2 * empty)) + 2
    return most + 1 + spare, spare


def _keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set: every part of its sketch, in its own size band and the next.

    A part is a parity sketch of 2**64 bits, each element flipping one of them, of which the exclusive or of
    the hashes of its elements is kept. A set that leaves many parts empty has keys of those as well.
    """
    band = int(np.searchsorted(_bands(percent), len(found), side="right")) - 1
    keys = []
    for label in (band, band + 1):
        parts, spare = _parts(label, percent)
        if parts:
            part = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the sorted hashes
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            number, words = part[first], np.bitwise_xor.reduceat(mix(found), first)
            if parts - len(first) > spare:
                absent = np.setdiff1d(np.arange(parts, dtype=np.uint64), number, assume_unique=True)
                number, words = np.concatenate([number, absent]), np.concatenate([words, np.zeros(len(absent), np.uint64)])
            keys.append(mix(words * np.uint64(0x9E3779B97F4A7C15) + mix(number + np.uint64(label << 32))))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, member): member names the set; null where it is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = shingle_sets(binary_values(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(x) for x in found], pa.int64()),
                pa.array([_identity(x) if len(x) else None for x in found], pa.int64()),
            ], names=["id", "n_shingles", "member"])
    return docs.mapInArrow(run, "id long, n_shingles long, member long")


def _sketch_words(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, member): one row for each part of the sketch of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys, names = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for found in shingle_sets(binary_values(batch.column("text")), size):
                if len(found):
                    keys.append(_keys(found, percent))
                    names.append(np.full(len(keys[-1]), _identity(found), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(names))], names=["bucket", "member"])
    return docs.mapInArrow(run, "bucket long, member long")


#: Words of the short sketch by which pairs are looked at before their texts are.
_SHORT = 16


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and the distance of short sketches, a lower bound, leave it possible that two sets are linked."""
    differ = sum((F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(1, _SHORT)), F.bit_count(a["s0"].bitwiseXOR(b["s0"])))
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    return (100 * small >= percent * large) & ((100 + percent) * differ <= (100 - percent) * (small + large))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), by the exact shingle sets of their texts (member, text)."""
    pairs = cut(pairs, "pairs")
    texts = only_ids(texts.select("member", "text"), pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct(), "member")
    left = texts.select(F.col("member").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("member").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor().decompress, (b"", None)
        for batch in small_batches(batches, 1 << 20):
            keep = []
            firsts, seconds = binary_values(batch.column("text_a")), binary_values(batch.column("text_b"))
            for x, two in zip(firsts, shingle_sets([unpack(y) for y in seconds], size), strict=True):
                if last[0] != x:
                    last = (x, shingle_sets([unpack(x)], size)[0])
                one = last[1]
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _packed(docs: DataFrame, size: int) -> DataFrame:
    """(member, look, text): what looking at and verifying pairs needs."""
    look = pa.struct([("n", pa.int64()), *[(f"s{i}", pa.int64()) for i in range(_SHORT)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in small_batches(batches):
            texts = binary_values(batch.column("text"))
            found = shingle_sets(texts, size)
            bits = np.array([signed(sketch(x, _SHORT)) for x in found]).reshape(-1, _SHORT)
            columns = [np.array([len(x) for x in found], np.int64), *bits.T]
            yield pa.RecordBatch.from_arrays([
                batch.column("member"), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(look)),
                pa.array([pack(t) for t in texts], pa.binary()),
            ], names=["member", "look", "text"])
    words = ",".join(f"s{i}:long" for i in range(_SHORT))
    return docs.mapInArrow(run, f"member long, look struct<n:long,{words}>, text binary")


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
) -> DataFrame:
    """(id, n_shingles, component): groups of documents linked by Jaccard similarity of word shingles.

    ``percent``: two documents link when 100 * intersection >= percent * union. The component
    is the smallest id in reach of links. Documents without words, null texts included, have no
    shingles, link with nothing and are their own component. A document of fewer words than a
    shingle has all of them as one shingle. Equal texts, repeated rows included, are one member
    of the join; rows with a null id keep a null id and never name a group of others. One row for
    each input row; further columns are not used and not returned. An empty table gives an empty
    result.
    """
    docs = texts_of(docs, id_col, text_col)
    sets = cut(_sets(docs, size), "sets")
    words = _sketch_words(docs, size, percent)
    shared = words.groupBy("bucket").agg(F.min("member").alias("first"), F.max("member").alias("last")).where("first <> last")
    members = cut(words.join(shared.select("bucket"), "bucket").distinct(), "members")

    named = sets.where("member is not null").groupBy("member").agg(F.min("id").alias("id"))
    needed = cut(named.join(members.select("member").distinct(), "member").where("id is not null"), "needed")
    n_needed = needed.count()
    texts = docs.join(F.broadcast(needed) if n_needed <= BROADCAST_IDS else needed, "id").select("member", "text")
    texts = cut(_packed(texts, size), "texts")
    if texts.count() > n_needed:  # rows with an equal id
        texts = cut(texts.dropDuplicates(["member"]), "texts")
    links = linked_groups(
        members, texts.select("member", "look"), lambda a, b: _may_link(a, b, percent), lambda pairs: _verified(pairs, texts, size, percent))
    groups = components(links)

    label = named.join(groups.withColumnRenamed("node", "member"), "member", "left").select(
        "member", "id", F.coalesce("component", "member").alias("group"))
    smallest = label.groupBy("group").agg(F.min("id").alias("component"))
    of_member = label.join(smallest, "group").select("member", "component")
    return sets.join(of_member, "member", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component"))
