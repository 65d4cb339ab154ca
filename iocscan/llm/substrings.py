"""Removal of repeated substrings by column-wise suffix sorting of many documents.

A window of ``length`` bytes has an anchor: the leftmost of its k-mers with the smallest hash. Equal windows
have equal anchors at the same place, so they meet where texts are brought together by anchor. The
stretches of text around one anchor, laid side by side at the anchor, are a collection of documents. It is
sorted column by column from the right: each round inserts one symbol of every document in front of its
suffix, deals the suffixes out by that symbol, which gives the collection's Burrows-Wheeler transform at
the column, and updates the common prefixes of neighbours. A window is repeated if its suffix has
``length`` symbols in common with a neighbour. Symbols and results go through files, column after column.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_VALUES, _INVERSE, _ODD, _powers, binary_values, cut, mix, only_ids, shuffle_count, signed, small_batches, texts_of, without_ids

#: Bytes of a k-mer, and of text that are looked at at a time (a bound on memory; pieces overlap by a window).
KMER, PIECE = 24, 1 << 17
#: Symbols of stretches that are sorted together; the stretches of one anchor are never parted.
BATCH_SYMBOLS = 4 << 20


def anchors(text: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(hash of the anchor, its place, first window, last window) of the runs of windows with one anchor."""
    out = []
    last_window = len(text) - length
    kmer = min(KMER, length)
    wide = length - kmer + 1  # k-mers of a window
    for begin in range(0, last_window + 1, PIECE):
        windows = min(PIECE, last_window + 1 - begin)
        data = np.frombuffer(text, np.uint8, windows + length - 1, begin)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _powers(_ODD, len(data)), out=sums[1:])
        n = len(data) - kmer + 1
        hashes = mix((sums[kmer:] - sums[:-kmer]) * _powers(_INVERSE, n))
        # the place in the low bits: of equal hashes the leftmost is the smallest
        ranked = (hashes & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // wide)
        padded = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = ranked
        padded = padded.reshape(rows, wide)
        before = np.minimum.accumulate(padded, axis=1).ravel()
        after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:windows], before[wide - 1:wide - 1 + windows]) & np.uint64(0xFFFFF)
        ends = np.flatnonzero(least[1:] != least[:-1])
        firsts = np.concatenate([[0], ends + 1])
        lasts = np.concatenate([ends, [windows - 1]])
        places = least[firsts].astype(np.int64)
        out += zip(
            signed(hashes[places]).tolist(), (places + begin).tolist(), (firsts + begin).tolist(), (lasts + begin).tolist(), strict=True)
    return out


_RUN = "anchor long, look long, key string, at long, first long, last long"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of each text; ``look`` is a hash of the stretch of text that the run's windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, keys = [], []
            for text, key in zip(binary_values(batch.column("text")), batch.column("key").to_pylist(), strict=True):
                view = memoryview(text)
                for anchor, at, first, last in anchors(text, length) if len(text) >= length else ():
                    look = xxhash.xxh3_64_intdigest(view[first:last + length], seed=at - first)
                    rows.append((anchor, look - (1 << 63), at, first, last))
                    keys.append(key)
            columns = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[:, 0]), pa.array(columns[:, 1]), pa.array(keys, pa.string()),
                *[pa.array(columns[:, i]) for i in (2, 3, 4)]], names=["anchor", "look", "key", "at", "first", "last"])
    return docs.select("key", "text").mapInArrow(run, _RUN)


def repeated_windows(group: np.ndarray, before: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, length: int) -> list[np.ndarray]:
    """For each document of a collection, which of its windows another document of its group has as well.

    Documents lie one after another in ``symbols``; ``sizes`` are their lengths and ``before`` how many symbols of each lie
    left of the anchor. Columns are counted from the anchor; windows are compared at equal columns.
    """
    n = len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left, right = -before, sizes - before
    low, high = int(left.min()), int(right.max())
    windows = sizes - length + 1
    marks_at = np.concatenate([[0], np.cumsum(windows)])
    marks = np.zeros(int(marks_at[-1]), bool)
    order, common = np.empty(0, np.int64), np.empty(0, np.int32)
    entering = np.argsort(-right, kind="stable")
    group_start = np.searchsorted(group, group)  # documents come sorted by group
    entered = 0
    with tempfile.TemporaryFile() as file:
        # columns one after another in a file, each with the symbols of the documents that reach it
        columns = np.memmap(file, np.uint8, "w+", shape=(high - low, n))
        for i in range(n):
            at = int(left[i]) - low
            columns[at:at + int(sizes[i]), i] = symbols[starts[i]:starts[i] + sizes[i]]
        for column in range(high - 1, low - 1, -1):
            until = entered
            while until < n and right[entering[until]] == column + 1:
                until += 1
            if until > entered:  # documents that end here come in as empty suffixes, the first of their group
                fresh = np.sort(entering[entered:until])
                entered = until
                where = np.searchsorted(group_start[order], group_start[fresh], side="left")
                order = np.insert(order, where, fresh)
                common = np.insert(common, where, 0)
                # what came first in its group now follows an empty suffix
                same = group_start[order[1:]] == group_start[order[:-1]]
                empty = right[order[:-1]] == column + 1
                common[1:][same & empty] = 0
            row = columns[column - low]
            alive = np.flatnonzero(left[order] <= column)
            here = order[alive]
            ranks = group_start[here] * 256 + row[here]
            dealt = np.argsort(ranks, kind="stable")
            old = alive[dealt]
            new = here[dealt]
            ranks = ranks[dealt]
            prefix = np.zeros(len(new), np.int32)
            equal = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
            if len(equal):
                p, q = old[equal - 1] + 1, old[equal]
                least = common[q]
                apart = np.flatnonzero(p < q)
                if len(apart):
                    bounds = np.empty(2 * len(apart), np.int64)
                    bounds[0::2], bounds[1::2] = p[apart], q[apart] + 1
                    least[apart] = np.minimum.reduceat(np.append(common, np.int32(0)), bounds)[0::2]
                prefix[equal] = least + 1
            order, common = new, prefix
            if len(new):
                reached = prefix >= length
                reached[:-1] |= prefix[1:] >= length
                hit = new[reached]
                marks[marks_at[hit] + (column - left[hit])] = True
        del columns
    return np.split(marks, marks_at[1:-1])


def _spans(marks: np.ndarray, length: int) -> list[dict]:
    """Bytes, counted from the first window, that the marked windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b) - 1 + length} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _sorted_collections(stretches: DataFrame, length: int) -> DataFrame:
    """(anchor, look, spans) of stretches (anchor, look, before, bytes), which come in order of anchors."""
    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        marks = repeated_windows(
            np.unique([r[0] for r in rows], return_inverse=True)[1], np.array([r[2] for r in rows]), np.array([len(r[3]) for r in rows]),
            np.frombuffer(b"".join(r[3] for r in rows), np.uint8), length)
        found = [(a, k, _spans(m, length)) for (a, k, _, _), m in zip(rows, marks, strict=True)]
        found = [f for f in found if f[2]]
        return pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.list_(_SPAN))], names=["anchor", "look", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, int, bytes]] = []
        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "look", "before", "bytes")]
            for row in zip(*columns, strict=True):
                if held >= BATCH_SYMBOLS and row[0] != waiting[-1][0]:
                    yield solve(waiting)
                    waiting, held = [], 0
                waiting.append(row)
                held += len(row[3])
        if waiting:
            yield solve(waiting)
    return stretches.mapInArrow(run, "anchor long, look long, spans array<struct<start:long,end:long>>")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("id", text.alias("text"), F.md5(text.cast("binary")).alias("key"))


def _spans_by_text(docs: DataFrame, length: int) -> DataFrame:
    """(key, spans) of the texts (id, text, key) that have repeated windows; spans may overlap."""
    runs = cut(_runs(docs, length), "runs")
    twice = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("look").alias("a"), F.max("look").alias("b")).where("n > 1")
    twice = cut(twice.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "twice")
    met = only_ids(runs, twice.select("anchor"), "anchor")
    # stretches that are equal as a whole are sorted as one; each stands for its place with the smallest key
    looks = cut(met.groupBy("anchor", "look").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("place")), "looks")
    whole = looks.where("n > 1").select(
        "anchor", "look", F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("place.last") - F.col("place.first") + length).alias("end"))).alias("spans"))

    wanted = looks.join(twice.where("mixed").select("anchor"), "anchor", "left_semi")
    lists = cut(wanted.groupBy(F.col("place.key").alias("key")).agg(F.collect_list(F.struct(
        "anchor", "look", (F.col("place.at") - F.col("place.first")).alias("before"), F.col("place.first").alias("first"),
        (F.col("place.last") + length).alias("end"))).alias("parts")), "lists")
    one = only_ids(docs.select("key", "id"), lists.select("key"), "key").groupBy("key").agg(F.min(F.coalesce("id", F.lit(-1))).alias("id"))
    lists = cut(lists.join(one, "key"), "places")
    texts = only_ids(docs, lists.select("key"), "key").withColumn("id", F.coalesce("id", F.lit(-1))).join(lists, ["key", "id"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            rows = [
                (p["anchor"], p["look"], p["before"], text[p["first"]:p["end"]])
                for text, parts in zip(binary_values(batch.column("text")), batch.column("parts").to_pylist(), strict=True) for p in parts]
            yield pa.RecordBatch.from_arrays([
                *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.binary())],
                names=["anchor", "look", "before", "bytes"])
    stretches = texts.select("text", "parts").mapInArrow(slices, "anchor long, look long, before long, bytes binary")
    stretches = stretches.repartition(4 * shuffle_count(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "look")
    parts = _sorted_collections(stretches, length)

    verdicts = cut(whole.union(parts.join(whole, ["anchor", "look"], "left_anti").select("anchor", "look", "spans")), "verdicts")
    found = met.join(verdicts, ["anchor", "look"]).select("key", "first", F.explode("spans").alias("s"))
    return cut(found.groupBy("key").agg(F.collect_set(F.struct(
        (F.col("first") + F.col("s.start")).alias("start"), (F.col("first") + F.col("s.end")).alias("end"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, spans, kept): the bytes of each text outside strings of ``length`` bytes that start anywhere else too.

    ``spans`` are the maximal removed runs (start, end) in bytes of UTF-8, ``kept`` the remaining bytes. Overlapping
    occurrences count, those in the same text too; all is judged on the input. A null text is empty; texts shorter
    than ``length`` lose nothing. Equal texts, repeated rows included, are occurrences of each other, so a
    text that is there twice goes as a whole, both times. One row for each input row; rows with a null id
    are treated like all others. Further columns are not used. An empty table gives an empty result.

    Only texts that have something to remove meet their spans in a shuffle; the others stay where they are.
    """
    docs = _keyed(texts_of(docs, id_col, text_col))
    spans = _spans_by_text(docs, length)
    keys = spans.select("key")
    clean = without_ids(docs, keys, "key").select(
        "id", "text", F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    hit = only_ids(docs, keys, "key").join(spans, "key").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, all_spans, kept = [], [], []
            for text, spans in zip(binary_values(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                merged = _merged(spans)
                bounds = [0, *[x for span in merged for x in span], len(text)]
                sizes.append(len(text))
                all_spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(bounds[0::2], bounds[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"])
    return clean.union(hit).mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
