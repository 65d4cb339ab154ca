"""Best-fit packing of tokenised documents into sequences of fixed length.

Hierarchical residual packing: pieces are dealt out by chance, so that large and small ones of all partitions meet, and each
group packs its own by best fit and gives out bins that are full or nearly so. All bins that are not are items themselves,
which are dealt out to fewer and fewer groups up a tree and packed by best fit again. A group has no more bins than a task can hold: where
many don't fit together the tree ends in several groups, each with a mix of all. A bin holds at most as many pieces as it has tokens.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of

#: A task packs about so many pieces at most (a bound on memory).
LOCAL_PIECES = 100_000
#: Groups whose bins go to one group of the next level.
FAN_IN = 8
#: A bin with no more free tokens than this is given out.
SLACK = 16
#: Bins that are passed on to one group, about; for more there are more groups. All bins that are not nearly full are passed on.
PASSED_ON = 5_000
_PIECE = pa.struct([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
_BIN = "node long, number long, size long, pieces array<struct<doc:long,piece:int,start:long,length:long,crc:long>>"
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Token ids of a text, as the ``tokenizers`` file at ``path`` makes them.

    Where the same vocabulary lies beside it as ranks (.tiktoken), texts of Latin letters without
    special tokens go through that faster encoder, which gives the same ids; all others, and all
    texts where there is no such file, through the file itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    fast = None
    try:
        import public_tokenizers
        import tiktoken
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if path == public_tokenizers.path("byte_bpe_50k.json"):
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        fast = None

    def encode(text: str) -> np.ndarray:
        if fast is not None and _SPECIAL not in text and (not text or max(text) < "ɐ"):
            ids = fast.encode_ordinary(text)
        else:
            ids = slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32)
    return encode


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, by best fit over items in falling order of size."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = {}
    free = 0  # bit f is set where a bin with f free places is open
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            number = open_bins[left].pop()
            if not open_bins[left]:
                free &= ~(1 << left)
            bins[number].append(item)
            left -= size
        else:
            number, left = len(bins), capacity - size
            bins.append([item])
        if left:
            open_bins.setdefault(left, []).append(number)
            free |= 1 << left
    return bins


def _table(node: int, bins: list[tuple[int, list[dict]]], first: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([node] * len(bins), pa.int64()), pa.array(range(first, first + len(bins)), pa.int64()),
        pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.list_(_PIECE)),
    ], names=["node", "number", "size", "pieces"])


def _fill(items: list[tuple[int, list[dict]]], capacity: int) -> list[tuple[int, list[dict]]]:
    """Packed bins."""
    packed = best_fit([size for size, _ in items], capacity)
    return [(sum(items[i][0] for i in members), [p for i in members for p in items[i][1]]) for members in packed]


def _pieces(texts: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """Bins of level 0: the pieces of each partition, each in a bin of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, encode, number = TaskContext.get().partitionId(), _encoder(path), 0
        end = np.array([end_id], np.uint32)
        found: list[tuple[int, list[dict]]] = []
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % capacity or capacity
                    crc = zlib.crc32(ids[start:start + length].tobytes())
                    row = {"doc": doc, "piece": piece, "start": start, "length": length, "crc": crc}
                    found.append((length, [row]))
                    start, piece = start + length, piece + 1
                if len(found) >= 4096:
                    yield _table(node, found, number)
                    number, found = number + len(found), []
        yield _table(node, found, number)
    return texts.mapInArrow(run, _BIN)


def _merge(bins: DataFrame, capacity: int, groups: int) -> DataFrame:
    """Bins of the next level: all of ``bins`` dealt out by chance to ``groups`` groups, and packed there as items."""
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: (r["size"], r["was"], r["number"]))
        return pa.Table.from_batches([_table(node, _fill([(r["size"], r["pieces"]) for r in rows], capacity))])
    dealt = bins.withColumn("was", F.col("node")).withColumn("node", F.pmod(F.xxhash64("node", "number"), F.lit(groups).cast("long")))
    return dealt.groupBy("node").applyInArrow(run, _BIN)


def pack_documents(
    docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
) -> DataFrame:
    """(id, piece, start, length, crc, sequence, offset): documents packed into sequences.

    A document is its token ids and then ``end_id``; null and empty texts are that one token. A
    document longer than ``capacity`` is cut into pieces of ``capacity`` tokens, of which only the first
    may be shorter; none other is cut. ``crc`` is the CRC-32 of a piece's ids as little-endian
    unsigned 32-bit numbers. Pieces of a sequence lie gapless from offset 0. Every input row is
    packed, repeated rows and rows with a null id as well; further columns are not used. An empty
    table gives an empty result.

    ``tokenizer`` is the path of a ``tokenizers`` file that all executors can open.
    """
    docs = texts_of(docs, id_col, text_col)
    done, level = [], 0
    bins = cut(_pieces(docs, capacity, tokenizer, end_id), "bins")
    groups = (bins.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        ready = F.col("size") >= capacity - (SLACK if level else 0)
        count, pieces = bins.where(~ready).agg(F.count(F.lit(1)), F.sum(F.size("pieces"))).first()
        least = max(1, -(-(pieces or 0) // LOCAL_PIECES))
        if level:
            # no two bins of a group fit together: groups that don't get fewer by half would gain next to nothing
            fewer = max(-(-groups // FAN_IN), -(-count // PASSED_ON), least)
            last = groups == 1 or fewer > -(-groups // 2)
        else:
            fewer, last = max(groups, least), False
        last = last or not count
        done.append((bins if last else bins.where(ready)).select(F.lit(level).cast("long").alias("level"), "node", "number", "pieces"))
        if last:
            break
        bins, groups, level = cut(_merge(bins.where(~ready), capacity, fewer), "bins"), fewer, level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    # 5 bits of level, 29 of node, 29 of number
    sequence = F.shiftleft("level", 58) + F.shiftleft("node", 29) + F.col("number")
    placed = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("offsets")),
        lambda s, p: F.struct((s["at"] + p["length"]).alias("at"), F.concat(s["offsets"], F.array(s["at"])).alias("offsets")),
        lambda s: s["offsets"])
    rows = rows.select(sequence.alias("sequence"), F.explode(F.arrays_zip(F.col("pieces").alias("p"), placed.alias("o"))).alias("x"))
    return rows.select(
        F.col("x.p.doc").alias("id"), F.col("x.p.piece").alias("piece"), F.col("x.p.start").alias("start"),
        F.col("x.p.length").alias("length"), F.col("x.p.crc").alias("crc"), "sequence", F.col("x.o").alias("offset"))
