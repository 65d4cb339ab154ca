"""Periodic runs in the words of a text, by internal pattern matching.

The words of a document are numbers. Ranks of all blocks whose length is a power of two come from prefix doubling, which
ends in the suffix array; the suffixes that begin with a block are an interval of it. A run of period p has a block of length
b, b <= p < 2b, which begins at a multiple of the stride and occurs again p words on. So each such block asks for its occurrences among the
next places b to 2b - 1: by range successors in a wavelet tree over its interval of the suffix array. Occurrences that close form an arithmetic
progression. One or two give their distances as candidate periods; a longer progression means that the block is itself periodic,
and only the two distances that bring the ends of the periodic stretches together can be new periods. A candidate is
extended both ways by comparing ranks, largest blocks first. All steps work on the blocks of many documents at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_values, small_batches, texts_of

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of documents that are looked at together; a longer document is looked at alone.
BATCH_WORDS = 1 << 17


class Ranks:
    """Ranks of all blocks of 1, 2, 4, ... symbols, and the suffix array.

    ``symbols`` are numbers from 0, and each document ends with one that occurs nowhere else, so that no repeated block reaches into the next.
    Equal ranks at a level mean equal blocks; the suffixes that begin with a block of rank r are the interval of the
    suffix array that begins at r.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        sizes = np.bincount(symbols)
        starts = np.cumsum(sizes) - sizes
        rank = starts[symbols]
        self.levels = [rank.astype(np.int32)]
        self.sizes = [sizes[symbols].astype(np.int32)]
        alive = np.flatnonzero(self.sizes[0] > 1)
        block = 1
        while len(alive):
            follow = alive + block
            second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
            keys = rank[alive] * np.int64(n + 1) + second
            order = np.argsort(keys, kind="stable")
            alive, keys = alive[order], keys[order]
            fresh = np.append(True, keys[1:] != keys[:-1])
            old = rank[alive]
            classes = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            firsts = np.flatnonzero(fresh)
            counts = np.diff(np.append(firsts, len(alive)))
            within = firsts - classes[np.searchsorted(classes, firsts, side="right") - 1]
            rank, size = rank.copy(), self.sizes[-1].copy()
            rank[alive] = np.repeat(old[firsts] + within, counts)
            size[alive] = np.repeat(counts, counts)
            self.levels.append(rank.astype(np.int32))
            self.sizes.append(size)
            alive = np.sort(alive[np.repeat(counts, counts) > 1])
            block *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on are those from ``b`` on (a < b)."""
        n, out = len(self.order), np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            at = b + out
            inside = at < n
            same = inside & (self.levels[level][np.where(inside, a + out, 0)] == self.levels[level][np.where(inside, at, 0)])
            # the ranks of the highest levels are all different: equal ones there mean the same place, which a < b rules out
            out += np.where(same, 1 << level, 0)
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` are those before ``b`` (a < b)."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            first = a - out - (1 << level)
            inside = first >= 0
            same = inside & (self.levels[level][np.where(inside, first, 0)] == self.levels[level][np.where(inside, b - out - (1 << level), 0)])
            out += np.where(same, 1 << level, 0)
        return out


class WaveletTree:
    """Counts and order statistics of stretches of a sequence of numbers, one bit of the numbers at each level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            counts = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=counts[1:])
            self.zeros.append(counts)
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers at the places low to high - 1 are less than ``bound``."""
        out = np.where(bound >> self.bits > 0, high - low, 0)
        live = bound >> self.bits == 0
        for level, zeros in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            z_low, z_high = zeros[low], zeros[high]
            out += np.where(one & live, z_high - z_low, 0)
            low = np.where(one, low - z_low + zeros[-1], z_low)
            high = np.where(one, high - z_high + zeros[-1], z_high)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones at the places low to high - 1."""
        out, k = np.zeros(len(low), np.int64), k.copy()
        for level, zeros in enumerate(self.zeros):
            z_low, z_high = zeros[low], zeros[high]
            count = z_high - z_low
            one = k >= count
            out += np.where(one, 1 << (self.bits - 1 - level), 0)
            k -= np.where(one, count, 0)
            low = np.where(one, low - z_low + zeros[-1], z_low)
            high = np.where(one, high - z_high + zeros[-1], z_high)
        return out


def _candidates(ranks: Ranks, tree: WaveletTree, level: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) that blocks of 2 ** level symbols give."""
    block = 1 << level
    # a run of four periods p >= b that begins before the next multiple still holds the block there and its next occurrence
    stride = 4 if block == 1 else 2 * block
    places = np.arange(0, length, stride)
    sizes = ranks.sizes[level][places]
    places = places[sizes > 1]
    low = ranks.levels[level][places].astype(np.int64)
    high = low + ranks.sizes[level][places]
    first = tree.below(low, high, places + block)
    count = tree.below(low, high, places + 2 * block) - first
    met = count > 0
    places, low, high, first, count = places[met], low[met], high[met], first[met], count[met]
    if not len(places):
        return places, places
    one = tree.smallest(low, high, first)
    several = count > 1
    a = places[several]
    p1 = one[several] - a
    p2 = tree.smallest(low[several], high[several], first[several] + 1) - a
    pair = count[several] == 2
    # three or more: the block has the period p2 - p1
    long = ~pair
    s, q, step = a[long], (a + p1)[long], (p2 - p1)[long]
    starts = [x - ranks.behind(x, x + step) for x in (s, q)]
    ends = [x + step + ranks.ahead(x, x + step) for x in (s, q)]
    apart = starts[0] != starts[1]
    s = s[apart]
    all_places = np.concatenate([places[count <= 2], a[pair], s, s])
    periods = np.concatenate([
        (one - places)[count <= 2], p2[pair], (starts[1] - starts[0])[apart], (ends[1] - ends[0])[apart]])
    kept = (periods >= block) & (periods < 2 * block)
    return all_places[kept], periods[kept]


def find_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; see ``Ranks`` for ``symbols``."""
    none = np.empty((0, 3), np.int64)
    if len(symbols) < LEAST_WORDS:
        return none
    ranks = Ranks(symbols)
    tree = None
    found = [none]
    for level in range(len(ranks.levels)):
        if LEAST_PERIODS << level > len(symbols) or not (ranks.sizes[level] > 1).any():
            break
        tree = tree or WaveletTree(ranks.order)
        places, periods = _candidates(ranks, tree, level, len(symbols))
        if not len(places):
            continue
        left = ranks.behind(places, places + periods)
        right = ranks.ahead(places, places + periods)
        runs = np.stack([places - left, left + right + periods, periods], axis=1)
        runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * periods)]
        found.append(np.unique(runs, axis=0))
    runs = np.concatenate(found)
    # a stretch that has a period has its multiples too: the smallest counts
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[:len(runs)]
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def altered(words: list[bytes], doc: int | None) -> list[bytes]:
    """The words with a repeated end in one of ten documents, which the digits of its id choose; a null id changes nothing."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * (-(-(n - a) // period)))[:n - a]


def _found(lists: list[list[bytes]]) -> Iterator[np.ndarray]:
    """The runs of each list of words."""
    at = 0
    while at < len(lists):
        numbers: list[int] = []
        edges = [0]
        known = 0
        while at < len(lists) and (len(edges) == 1 or len(numbers) + len(lists[at]) <= BATCH_WORDS):
            # words of different documents are different symbols
            own: dict[bytes, int] = {}
            numbers += [own.setdefault(w, known + len(own)) for w in lists[at]]
            known += len(own) + 1
            numbers.append(known - 1)
            edges.append(len(numbers))
            at += 1
        runs = find_runs(np.array(numbers, np.int64))
        cuts = np.searchsorted(runs[:, 0], edges)
        for i, begin in enumerate(edges[:-1]):
            yield runs[cuts[i]:cuts[i + 1]] - np.array([begin, 0, 0])


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [w for w, dropped in zip(words, np.cumsum(edges).tolist(), strict=False) if not dropped]


_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alter: bool = False, collapsed_text: bool = True,
) -> DataFrame:
    """(id, n_words, runs, collapsed, collapsed_sha256): the periodic runs among the words of each text.

    Words are what lies between ASCII white space. A run is a stretch with a smallest period q, of at least six words and four periods, that can't be
    made longer either way; ``runs`` has (start, length, period) of all of them by start and period. ``collapsed`` is the text, its words
    parted by one space, without those that a run has after its first period (null unless ``collapsed_text``), and its SHA-256 is always
    there. With ``alter`` one of ten texts gets a repeated end first (``altered``), as material for tests.

    Null and empty texts and those without words have no runs and collapse to an empty text. One row for each input row, with its id,
    repeated and null ids as they are; further columns are not used. An empty table gives an empty result. Each text is worked on
    where it is, so nothing is shuffled.
    """
    docs = texts_of(docs, id_col, text_col)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            lists = [text.split() for text in binary_values(batch.column("text"))]
            if alter:
                lists = [altered(words, doc) for words, doc in zip(lists, batch.column("id").to_pylist(), strict=True)]
            all_runs = list(_found(lists))
            flat = np.concatenate([*all_runs, np.empty((0, 3), np.int64)])
            offsets = np.cumsum([0, *map(len, all_runs)]).astype(np.int32)
            texts = [b" ".join(collapsed(words, runs)) for words, runs in zip(lists, all_runs, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(words) for words in lists], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind.value_type))),
                pa.array(texts if collapsed_text else [None] * len(texts), pa.binary()).cast(pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ], names=["id", "n_words", "runs", "collapsed", "collapsed_sha256"])
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN),
        T.StructField("collapsed", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
    return docs.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The longest run of an array of them, ties by start and period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)
