"""Scores of texts by an n-gram model in an Elias-Fano trie.

The model is a trie of contexts and their successors, split over shards by context, so that it grows with the
corpus and no task holds more than a shard. A shard keeps sorted contexts, Elias-Fano coded pointers to
their successors, the successors as Elias-Fano coded numbers relative to their context, and quantised
smoothed probabilities, in a memory-mapped file. Texts are dealt into chunks; a chunk sends each shard the distinct word pairs
it has, once, with the number of times it has them in texts to learn from. The shard adds these up, builds its trie, and
answers every chunk from it; chunks put the answers together into scores.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import binary_values, cut, mix, shuffle_count, signed, small_batches, sorted_unique, word_hashes

#: Bytes of text in a chunk and for each shard (bounds on what one task holds).
CHUNK_BYTES, SHARD_BYTES = 8 << 20, 12 << 20
#: What is taken off every count of a pair, for words that did not follow the context.
DISCOUNT = 0.8
#: Steps of a halving in which probabilities are kept, and the mark of a pair that was not seen.
_STEPS, _UNSEEN = 1400, 65535
#: The hashes that stand for the begin and the end of a text, and one that is no word's.
_BEGIN, _END, _NONE = np.uint64(0x0B), np.uint64(0x0E), np.uint64(0x0D)
#: Values of an Elias-Fano sequence between two entry points.
_BLOCK = 1024


class EliasFano:
    """A rising sequence of numbers: low bits as they are, high bits in unary, entry points every ``_BLOCK`` values."""

    def __init__(self, values: np.ndarray, file):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low = max(0, (top // max(1, self.n)).bit_length() - 1)
        ones = (values >> np.uint64(self.low)).astype(np.int64) + np.arange(self.n)
        high = np.zeros((int(ones[-1]) + 8) // 8 if self.n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
        low = [np.empty(0, np.uint8)]
        for start in range(0, self.n, _BLOCK * 64):
            part = values[start:start + _BLOCK * 64]
            bits = (part[:, None] >> np.arange(self.low, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        self.entries = mapped(ones[::_BLOCK], file)
        self.firsts = mapped(values[::_BLOCK], file)
        self.high, self.lows = mapped(high, file), mapped(np.concatenate(low), file)

    def block(self, number: int) -> np.ndarray:
        """The values of one block."""
        start, end = number * _BLOCK, min(self.n, (number + 1) * _BLOCK)
        first = int(self.entries[number])
        last = int(self.entries[number + 1]) if number + 1 < len(self.entries) else len(self.high) * 8
        bits = np.unpackbits(self.high[first >> 3:(last + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits) + (first >> 3 << 3)
        ones = ones[np.searchsorted(ones, first):][:end - start]
        high = (ones - np.arange(start, end)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        place = start * self.low
        bits = np.unpackbits(self.lows[place >> 3:(end * self.low + 7) >> 3], bitorder="little")[place & 7:]
        bits = bits[:(end - start) * self.low].reshape(-1, self.low).astype(np.uint64)
        return high | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *[self.block(i) for i in range(len(self.entries))]])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each of ``wanted``, which are sorted; -1 where it isn't there."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        blocks = np.searchsorted(self.firsts, wanted, side="right") - 1
        bounds = np.searchsorted(blocks, np.arange(len(self.entries) + 1))
        for number in np.flatnonzero(bounds[1:] > bounds[:-1]):
            values, some = self.block(int(number)), slice(int(bounds[number]), int(bounds[number + 1]))
            at = np.minimum(np.searchsorted(values, wanted[some]), len(values) - 1)
            out[some] = np.where(values[at] == wanted[some], at + number * _BLOCK, -1)
        return out


def mapped(values: np.ndarray, file) -> np.ndarray:
    """``values`` written to the end of ``file`` and mapped from there."""
    if not len(values):
        return values
    file.seek(0, 2)
    at = file.tell()
    file.write(np.ascontiguousarray(values).tobytes())
    file.flush()
    return np.memmap(file, values.dtype, "r", at, (len(values),))


class Trie:
    """Contexts, their successors and smoothed probabilities of one shard, in a file that goes with it.

    Made from sorted distinct pairs with counts; ``totals`` has the uses of contexts that are spread over shards.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, totals: dict[int, int], discount: float):
        self.file = tempfile.TemporaryFile()
        seen = count > 0
        context, word, count = context[seen], word[seen], count[seen]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        contexts = context[first]
        uses = np.add.reduceat(count, first) if len(first) else np.empty(0, np.int64)
        for c, n in totals.items():
            at = np.searchsorted(contexts, np.uint64(c))
            if at < len(contexts) and contexts[at] == np.uint64(c):
                uses[at] = n
        of_pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        words = sorted_unique(word)
        self.width = max(1, len(words))
        self.contexts = mapped(contexts, self.file)
        self.uses = mapped(uses, self.file)
        self.words = mapped(words, self.file)
        self.pointers = EliasFano(np.append(first, len(context)), self.file)
        relative = np.searchsorted(words, word)
        self.successors = EliasFano(of_pair.astype(np.uint64) * np.uint64(self.width) + relative.astype(np.uint64), self.file)
        part = (count - discount) / np.maximum(uses[of_pair], 1) if len(count) else np.empty(0)
        self.parts = mapped(np.minimum(np.round(-np.log2(np.maximum(part, 1e-30)) * _STEPS), _UNSEEN - 1).astype(np.uint16), self.file)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Quantised probability of each pair, which come sorted; ``_UNSEEN`` where it was not seen."""
        out = np.full(len(context), _UNSEEN, np.uint16)
        if not len(self.contexts):
            return out
        c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        w = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        there = np.flatnonzero((self.contexts[c] == context) & (self.words[w] == word))
        place = self.successors.find(c[there].astype(np.uint64) * np.uint64(self.width) + w[there].astype(np.uint64))
        out[there[place >= 0]] = self.parts[place[place >= 0]]
        return out

    def about(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uses of each context, and its distinct successors in this shard."""
        pointers = self.pointers.all().astype(np.int64)
        c = np.minimum(np.searchsorted(self.contexts, context), max(0, len(self.contexts) - 1))
        there = self.contexts[c] == context if len(self.contexts) else np.zeros(len(context), bool)
        uses, followers = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        uses[there] = self.uses[c[there]]
        followers[there] = pointers[c[there] + 1] - pointers[c[there]]
        return uses, followers


@dataclass
class _Plan:
    shards: int
    chunks: int
    tokens: int
    kinds: int
    texts: int
    spread: dict[int, tuple[int, int]]  # context: (uses, shards that it is spread over)
    discount: float


class _Chunk:
    """Pairs of a chunk: the tokens in order, and the distinct pairs in order of shard, context and word."""

    def __init__(self, texts: list[bytes], learn: np.ndarray, plan: _Plan):
        words = word_hashes(texts)
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(self.sizes)
        self.word = np.full(int(ends[-1]) if len(ends) else 0, _END, np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[ends - 1] = False
        self.word[inner] = np.concatenate([np.empty(0, np.uint64), *words])
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[ends - self.sizes] = _BEGIN
        used = np.repeat(learn, self.sizes)
        # of a spread context every shard that has a part of it is asked, by a filler
        context = [self.context]
        word = [self.word]
        extra = [np.uint64(c) for c in plan.spread]
        for c, (_, over) in plan.spread.items():
            context.append(np.full(over, c, np.uint64))
            word.append(np.full(over, _NONE, np.uint64) + np.arange(over, dtype=np.uint64) * np.uint64(1 << 32))
        context, word = np.concatenate(context), np.concatenate(word)
        used = np.concatenate([used, np.zeros(len(word) - len(used), bool)])
        shard = self._shards(context, word, plan, extra)
        pair = mix(mix(context) + word)
        _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=used, minlength=len(first)).astype(np.int64)
        order = np.lexsort((word[first], context[first], shard[first]))
        self.pair_context, self.pair_word, self.pair_shard = context[first][order], word[first][order], shard[first][order]
        self.pair_count = count[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of_token = rank[inverse[:len(self.word)]]

    @staticmethod
    def _shards(context: np.ndarray, word: np.ndarray, plan: _Plan, extra: list) -> np.ndarray:
        shard = mix(context) % np.uint64(plan.shards)
        for c in extra:
            here = np.flatnonzero(context == c)
            over = np.uint64(plan.spread[int(c)][1])
            own = word[here]
            filler = (own & np.uint64(0xFFFFFFFF)) == _NONE
            part = np.where(filler, own >> np.uint64(32), mix(own) % over)
            shard[here] = (shard[here] + part) % np.uint64(plan.shards)
        return shard.astype(np.int64)

    def blobs(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For each shard: its number, the slice of pairs, and the first pair and the number of pairs of each context."""
        edges = np.flatnonzero(np.concatenate([[True], self.pair_shard[1:] != self.pair_shard[:-1]]))
        for start, end in zip(edges, np.append(edges[1:], len(self.pair_shard)), strict=True):
            own = self.pair_context[start:end]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            yield int(self.pair_shard[start]), slice(int(start), int(end)), first, np.diff(np.append(first, end - start))


def _pack(*arrays: np.ndarray) -> bytes:
    data = b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        size = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _chunk_of(table: pa.Table, plan: _Plan) -> _Chunk:
    return _Chunk(
        [v for c in table.column("text").chunks for v in binary_values(c)],
        np.array(table.column("learn").to_pylist(), bool), plan)


def _asked(chunked: DataFrame, plan: _Plan) -> DataFrame:
    """(shard, chunk, blob): the distinct pairs of each chunk by shard."""
    def run(table: pa.Table) -> pa.Table:
        chunk = _chunk_of(table, plan)
        rows = [
            (shard, _pack(chunk.pair_context[where][first], runs.astype(np.uint32), chunk.pair_word[where], chunk.pair_count[where].astype(np.uint32)))
            for shard, where, first, runs in chunk.blobs()]
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int64()),
            "blob": pa.array([r[1] for r in rows], pa.binary())})
    return chunked.groupBy("chunk").applyInArrow(run, "shard long, chunk long, blob binary")


def _answered(asked: DataFrame, plan: _Plan) -> DataFrame:
    """(chunk, shard, blob): what a shard's trie knows of the pairs and contexts that a chunk asked for."""
    totals = {c: n for c, (n, _) in plan.spread.items()}

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, np.uint64, np.uint32, np.uint64, np.uint32) for b in table.column("blob").to_pylist()]
        context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        word = np.concatenate([p[2] for p in parts])
        count = np.concatenate([p[3] for p in parts]).astype(np.int64)
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        trie = Trie(context[first], word[first], np.add.reduceat(count[order], first), totals, plan.discount)
        distinct = trie.lookup(context[first], word[first])
        known = np.empty(len(order), np.uint16)
        known[order] = distinct[np.cumsum(new) - 1]
        blobs, at = [], 0
        for p in parts:
            uses, followers = trie.about(p[0])
            blobs.append(_pack(uses, followers.astype(np.uint32), known[at:at + len(p[2])]))
            at += len(p[2])
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "blob": pa.array(blobs, pa.binary())})
    return asked.groupBy("shard").applyInArrow(run, "chunk long, shard long, blob binary")


def _scores(chunk: _Chunk, answers: dict[int, bytes], plan: _Plan) -> list[tuple[int, int, float, float]]:
    """(tokens, known tokens, base score, score) of each text of a chunk."""
    seen = np.zeros(len(chunk.pair_context))
    uses, followers = np.zeros(len(chunk.pair_context), np.int64), np.zeros(len(chunk.pair_context), np.int64)
    contexts, their_uses, their_followers = [], [], []
    for shard, where, first, runs in chunk.blobs():
        own_uses, own_followers, known = _unpack(answers[shard], np.int64, np.uint32, np.uint16)
        seen[where] = np.where(known == _UNSEEN, 0.0, 2.0 ** (-known.astype(float) / _STEPS))
        contexts.append(chunk.pair_context[where][first])
        their_uses.append(own_uses)
        their_followers.append(own_followers)
    context = np.concatenate(contexts)
    names, at = np.unique(context, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.maximum.at(total, at, np.concatenate(their_uses))  # a spread context has its whole count everywhere
    for c, (n, _) in plan.spread.items():
        total[names == np.uint64(c)] = n
    after = np.bincount(at, weights=np.concatenate(their_followers), minlength=len(names))
    whole = plan.tokens + 0.5 * (plan.kinds + 1)
    end_count = plan.texts
    place = np.minimum(np.searchsorted(names, chunk.word), len(names) - 1)
    count = np.where(chunk.word == _END, end_count, np.where(names[place] == chunk.word, total[place], 0))
    single = (count + 0.5) / whole
    of_pair = np.searchsorted(names, chunk.pair_context)
    rest = np.where(total[of_pair] > 0, plan.discount * after[of_pair] / np.maximum(total[of_pair], 1), 1.0)
    both = seen[chunk.of_token] + rest[chunk.of_token] * single
    starts = np.cumsum(chunk.sizes) - chunk.sizes
    return list(zip(
        chunk.sizes.tolist(), np.add.reduceat((count > 0).astype(np.int64), starts).tolist(),
        np.add.reduceat(np.log10(single), starts).tolist(), np.add.reduceat(np.log10(both), starts).tolist(), strict=True))


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): uses of each word's hash in the texts to learn from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_inverse=True)
            return names, np.bincount(at, weights=np.concatenate([np.empty(0), *counts]), minlength=len(names)).astype(np.int64)
        for batch in small_batches(batches):
            names, n = np.unique(np.concatenate([np.empty(0, np.uint64), *word_hashes(binary_values(batch.column("text")))]), return_counts=True)
            held.append(names)
            counts.append(n)
            size += len(names)
            if size > 2_000_000:
                names, n = summed()
                held, counts, size = [names], [n], len(names)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(n)], names=["word", "n"])
                    held, counts, size = [], [], 0
        names, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(n)], names=["word", "n"])
    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(
    docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of each text.

    The model learns from the rows where the column expression ``learn`` is true. Tokens are the words, lower-cased
    (ASCII) and split at ASCII white space, and one end for each text. ``base_score`` is from single tokens, with half
    a use added to each and to one unknown; ``score`` from pairs by absolute discounting, backed by the single
    tokens: probabilities of all tokens after a context add up to 1, up to the steps in which they are kept. A null
    text is empty: its only token is the end. One row for each input row, repeated rows and
    null ids as well; further columns are not used. Without rows to learn from all counts are 0.
    """
    spark = docs.sparkSession
    docs = _prepared(docs, learn, id_col, text_col)
    sizes = docs.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.sum(F.col("learn").cast("long")).alias("texts")).first()
    total, texts = sizes.bytes or 0, sizes.texts or 0
    vocabulary = cut(_vocabulary(docs.where("learn")), "vocabulary")
    found = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    tokens, kinds = (found.n or 0) + texts, found.kinds + (1 if texts else 0)
    shards, chunks = max(1, -(-total // SHARD_BYTES)), max(1, -(-total // CHUNK_BYTES))
    # contexts with more uses than an average shard are spread; there are fewer of them than shards
    often = vocabulary.where(F.col("n") > F.lit(max(1, tokens // shards))).collect() if shards > 1 else []
    spread = {int(np.array([r.word], np.int64).view(np.uint64)[0]): int(r.n) for r in often}
    if shards > 1 and texts > tokens // shards:
        spread[int(_BEGIN)] = texts
    plan = _Plan(shards, chunks, tokens, kinds, texts, {
        c: (n, min(shards, 1 + 2 * math.ceil(n * shards / max(1, tokens)))) for c, n in spread.items()}, discount)

    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    chunked = chunked.repartition(max(shuffle_count(spark), min(chunks, 4 * shuffle_count(spark))), "chunk")
    answers = _answered(_asked(chunked, plan), plan)

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        by_shard = dict(zip(told.column("shard").to_pylist(), told.column("blob").to_pylist(), strict=True))
        scores = _scores(_chunk_of(rows, plan), by_shard, plan) if rows.num_rows else []
        return pa.table({
            "id": rows.column("id"), "n_tokens": pa.array([s[0] for s in scores], pa.int64()),
            "n_known": pa.array([s[1] for s in scores], pa.int64()), "train_tokens": pa.array([plan.tokens] * len(scores), pa.int64()),
            "base_score": pa.array([s[2] for s in scores], pa.float64()), "score": pa.array([s[3] for s in scores], pa.float64())})
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _prepared(docs: DataFrame, learn, id_col: str, text_col: str) -> DataFrame:
    """(id, text, learn)"""
    prepare(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"))
