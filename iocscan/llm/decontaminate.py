"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words. A window is the set of its shingles
with their offsets; as it has to be contained as a whole, one shingle is a sufficient prefix of
it, and the rarest one in the corpus makes the fewest candidates. A document shingle that equals
a window's prefix gives the only place where the window can lie; the place has to fit into the
document (length and position), and then all words are compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, cut, fold_table, shingle_hashes, signed, small_batches, texts_of, word_hashes

#: Windows that are held by a task at once. A larger benchmark is searched in several blocks.
BLOCK_WINDOWS = 200_000
#: Words in a shingle; windows of fewer words are one shingle.
SHINGLE = 4
#: ASCII letters to lower case, other ASCII signs but digits to a space, all else as it is.
_FOLD = fold_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
_BITS = 22
SPANS = "array<struct<start:long,length:long>>"


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, lower-cased ASCII letters and non-ASCII characters."""
    return text.translate(_FOLD).split()


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, window, n, shingles): the distinct windows of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), binary_values(batch.column("text")), strict=True):
                words = words_of(text)
                width = min(size, len(words))
                for window in {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if width else ():
                    found = signed(shingle_hashes(word_hashes([b" ".join(window)])[0], SHINGLE)).tolist()
                    rows.append((item, b" ".join(window), width, found))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
            ], names=["item", "window", "n", "shingles"])
    return benchmark.mapInArrow(run, "item string, window binary, n long, shingles array<long>")


class _Known:
    """Membership in a set of hashes: a bit table in front of a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.values & np.uint64((1 << _BITS) - 1)] = True

    def places(self, found: np.ndarray) -> np.ndarray:
        if not len(self.values) or not len(found):
            return np.empty(0, np.int64)
        at = np.flatnonzero(self.table[found & np.uint64((1 << _BITS) - 1)])
        near = np.searchsorted(self.values, found[at])
        near[near == len(self.values)] = 0
        return at[self.values[near] == found[at]]


def _exact_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    return shingle_hashes(hashes, width) if len(hashes) >= width else np.empty(0, np.uint64)


def _frequencies(docs: DataFrame, shingles: list[tuple[int, np.ndarray]]) -> DataFrame:
    """(shingle, found): occurrences in the corpus of the given shingles by width."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(width, _Known(values)) for width, values in shared.value]
        for batch in small_batches(batches):
            seen = [np.empty(0, np.uint64)]
            for hashes in word_hashes(binary_values(batch.column("text")), _FOLD):
                for width, table in known:
                    found = _exact_shingles(hashes, width)
                    seen.append(found[table.places(found)])
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["shingle", "found"])
    return docs.select("text").mapInArrow(run, "shingle long, found long").groupBy("shingle").agg(F.sum("found").alias("found"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) joined where they overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _search(docs: DataFrame, prefixes: list[tuple[int, int, bytes, list[str]]], keep_text: bool) -> DataFrame:
    """Adds to (spans, items) what the windows (shingle, offset, window, items) hit in each document."""
    shared = docs.sparkSession.sparkContext.broadcast(prefixes)
    columns = ["id", *["text"] * keep_text, "n_words", "spans", "items"]
    kinds = {"id": "long", "text": "string", "n_words": "long", "spans": SPANS, "items": "array<string>"}
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shingle, widths = defaultdict(list), defaultdict(list)
        for shingle, offset, window, items in shared.value:
            words = window.split(b" ")
            by_shingle[shingle].append((offset, words, items))
            widths[min(len(words), SHINGLE)].append(shingle)
        known = [(w, _Known(np.array(x, np.int64).view(np.uint64))) for w, x in widths.items()]
        for batch in small_batches(batches):
            n_words, all_spans, all_items = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            texts = binary_values(batch.column("text"))
            for text, hashes, (had_spans, had_items) in zip(texts, word_hashes(texts, _FOLD), before, strict=True):
                words: list[bytes] = []
                spans, named = [(s["start"], s["start"] + s["length"]) for s in had_spans], set(had_items)
                for width, table in known:
                    found = _exact_shingles(hashes, width)
                    places = table.places(found).tolist()
                    words = words or (words_of(text) if places else [])
                    for place in places:
                        for offset, window, items in by_shingle[int(found[place:place + 1].view(np.int64)[0])]:
                            start = place - offset
                            end = start + len(window)
                            if start >= 0 and end <= len(words) and words[start:end] == window:
                                spans.append((start, end))
                                named.update(items)
                n_words.append(len(hashes))
                all_spans.append([{"start": a, "length": b - a} for a, b in _merged(spans)])
                all_items.append(sorted(named))
            made = {
                "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(all_spans, pa.list_(span)),
                "items": pa.array(all_items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], names=columns)
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
) -> DataFrame:
    """(id, n_words, spans, items): where windows of benchmark items lie in each document.

    ``spans`` are maximal runs of hit words (start, length), ``items`` the sorted ids, as
    strings, of the items of which a window occurs. A window is ``window`` consecutive words of an
    item; an item of fewer words is one window, one without words or with a null text has none.
    A null document has no words. Items with a null id are searched under the empty name; an id
    that is there twice counts once. One row for each input row, whatever its id; further columns
    are not used. An empty benchmark hits nothing.

    Documents never move: windows are broadcast, ``BLOCK_WINDOWS`` at most at a time, and a larger
    benchmark is searched block by block.
    """
    docs = texts_of(docs, id_col, text_col)
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
        F.col(f"`{item_text_col}`").cast("string").alias("text"))
    windows = cut(_windows(items, window), "windows")
    total = windows.count()
    blocks = -(-total // BLOCK_WINDOWS)
    out = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    if not blocks:
        return _search(out, [], False)
    block_of = F.pmod(F.xxhash64("window"), F.lit(blocks))
    for block in range(blocks):
        here = windows.where(block_of == block)
        # bounded: a block has about BLOCK_WINDOWS windows, each with fewer shingles than words
        rows = here.select(F.least("n", F.lit(SHINGLE)).alias("w"), F.explode("shingles").alias("s")).distinct().collect()
        by_width: dict[int, list[int]] = defaultdict(list)
        for row in rows:
            by_width[row.w].append(row.s)
        found = cut(_frequencies(docs, [(w, np.array(x, np.int64).view(np.uint64)) for w, x in by_width.items()]), "found")
        rarest = (
            here.select("window", "item", F.posexplode("shingles").alias("offset", "shingle"))
            .join(found, "shingle").groupBy("window")
            .agg(F.min(F.struct("found", "shingle", "offset")).alias("p"), F.collect_set("item").alias("items"))
        )
        # a window of which a shingle never occurs cannot occur: the inner join drops only that shingle,
        # so windows with fewer counted shingles than shingles are left out
        whole = here.select("window", F.explode("shingles").alias("shingle")).distinct().join(found, "shingle", "left_anti")
        rarest = rarest.join(whole.select("window").distinct(), "window", "left_anti")
        prefixes = [(r.p.shingle, r.p.offset, bytes(r.window), r["items"]) for r in rarest.collect()]
        out = _search(out, prefixes, block < blocks - 1)
    return out
