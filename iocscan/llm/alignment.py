"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other.

Both cut the same bytes, so the ends of their tokens are two rising lists. The shorter list drives a galloping search into the longer one: from
the place where the last block of ends was found, steps are doubled until they are past the next block, and its ends are found
by binary search in between. Ends that both lists have part the text into groups; the ranks of neighbouring
ends in the longer list say which tokens a token overlaps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import has_at_most
from .common import BROADCAST_IDS, cut, small_batches, texts_of

#: Ends of the shorter list that are searched at a time.
BLOCK = 256
#: Below this sign both programs for the first vocabulary know the same letters and spaces.
_LATIN = "ɐ"


class ByteTokens:
    """Token ids by a byte-level vocabulary file (``tokenizers``), and the bytes of each token.

    Special tokens in a text are plain text. Latin texts go through the same vocabulary as ranks, if it lies beside the file: same ids, faster.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        # printable signs stand for themselves, the other bytes for signs from 256 on, in order
        signs = {b: b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        signs |= {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in signs)}
        byte_of = {chr(sign): byte for byte, sign in signs.items()}
        size = self.slow.get_vocab_size()
        pieces = [self.slow.id_to_token(i) or "" for i in range(size)]
        self.table = [bytes(byte_of.get(c, 0x3F) for c in piece) for piece in pieces]
        self.fast = None
        if path == public_tokenizers.path("byte_bpe_50k.json"):
            import tiktoken
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [
            self.fast.encode_ordinary(text) if self.fast is not None and max(text, default="") < _LATIN
            else self.slow.encode(text, add_special_tokens=False).ids for text in texts]


class PieceTokens:
    """Token ids by a ``sentencepiece`` model, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def galloping_ranks(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of ``short``, how many of ``long`` are less, and whether it is in ``long``. Both rise."""
    ranks = np.empty(len(short), np.int64)
    at = 0
    for begin in range(0, len(short), BLOCK):
        block = short[begin:begin + BLOCK]
        step = len(block)
        while at + step < len(long) and long[at + step - 1] < block[-1]:
            step *= 2
        ranks[begin:begin + BLOCK] = at + np.searchsorted(long[at:at + step], block)
        at = int(ranks[begin + len(block) - 1])
    common = ranks < len(long)
    common[common] = long[ranks[common]] == short[common]
    return ranks, common


def overlaps(ranks: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the shorter list the first token of the longer one that it overlaps, and their number."""
    first = np.zeros(len(ranks), np.int64)
    first[1:] = ranks[:-1] + common[:-1]
    return first, ranks - first + 1


class Aligner:
    """Aligns the tokens of texts; made once for each task."""

    def __init__(self, byte_path: str, piece_path: str):
        self.sides = ByteTokens(byte_path), PieceTokens(piece_path)
        self.sizes = [np.array([len(x) for x in side.table], np.int64) for side in self.sides]
        n = self.shift = 2 * len(self.sides[0].table)
        # ids as they are written inside and at the end of a group's half
        self.written = [f"{i // 2}{'|' if i % 2 else ','}" for i in range(n)]
        self.written += [f"{i // 2}{';' if i % 2 else ','}" for i in range(2 * len(self.sides[1].table))]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text; none where there is no text or the tokens' bytes differ from a space and the text."""
        there = [i for i, text in enumerate(texts) if text]
        spaced = [" " + texts[i] for i in there]
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        a_table, b_table = (side.table for side in self.sides)
        for i, text, a, b in zip(there, spaced, self.sides[0].ids(spaced), self.sides[1].ids([texts[i] for i in there]), strict=True):
            plain = text.encode()
            if b"".join(map(a_table.__getitem__, a)) == plain and b"".join(map(b_table.__getitem__, b)) == plain:
                found[i] = np.array(a, np.int64), np.array(b, np.int64)
        return found

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """(ids of A, ids of B) of all overlapping occurrences, both as arrays, and the groups as text."""
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, (a, b), strict=True)]
        swapped = len(b) < len(a)
        short, long = (b, a) if swapped else (a, b)
        ranks, common = galloping_ranks(*(ends[::-1] if swapped else ends))
        first, count = overlaps(ranks, common)
        total = int(count.sum())
        left = np.repeat(short, count)
        right = long[np.arange(total) + np.repeat(first - np.cumsum(count) + count, count)]
        cut_short, cut_long = np.flatnonzero(common) + 1, ranks[common] + 1
        cut_a, cut_b = (cut_long, cut_short) if swapped else (cut_short, cut_long)
        # a token's place in the text: after its own side's before it, and the other side's of the groups before
        sizes_a, sizes_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(cut_b - sizes_b, sizes_a)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(cut_a, sizes_b)] = self.shift + 2 * b + last_b
        groups = "".join(map(self.written.__getitem__, order.tolist()))[:-1]
        return (right, left, groups) if swapped else (left, right, groups)


@lru_cache(maxsize=2)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_ALIGNED = (
    "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, uses array<long>")


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, uses): the alignment of each text by itself.

    ``pairs`` are the distinct linked ids, A's times 2 ** 32 plus B's, in order, and ``uses`` how many links of the text they have.
    ``row`` is a number of its own for each row, the same for as long as the input is dealt into the same partitions. See ``token_links``.
    """
    docs = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 1 << 20):
            out: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "sha", "pairs", "uses")}
            for tokens in aligner.tokens(batch.column("text").to_pylist()):
                if tokens is None:
                    values = 0, 0, 0, 0, "", "", np.empty(0, np.int64), np.empty(0, np.int64)
                else:
                    left, right, text = aligner.align(*tokens)
                    pairs, uses = np.unique(left << 32 | right, return_counts=True)
                    values = (
                        len(tokens[0]), len(tokens[1]), text.count(";") + 1, len(left), text,
                        hashlib.sha256(text.encode()).hexdigest(), pairs, uses)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            n = batch.num_rows
            offsets = pa.array(np.cumsum([0, *map(len, out["pairs"])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*out[c], np.empty(0, np.int64)]).astype(np.int64))) for c in ("pairs", "uses")]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), batch.column("id"), *[pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                pa.array(out["groups"] if groups else [None] * n, pa.string()), pa.array(out["sha"], pa.string()), *lists],
                names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "uses"])
            row += n
    return docs.mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): in how many rows of ``align_tokens`` a pair is linked, and whether no pair of its A id is in more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return cut(counts.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best")), "best")


def token_links(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) of each text.

    A space and the text are cut into tokens by the byte-level vocabulary at ``byte_path`` (A) and the model at ``piece_path`` (B, which puts the space there
    itself), special tokens being plain text. Groups are the stretches between places where tokens of both end; ``groups`` lists them as
    ``a1,a2|b1;a3|b2,b3`` (null unless asked for). Links are all occurrences of a token of A and one of B whose bytes overlap. A
    pair of ids counts with the number of texts that have it linked: ``count_sum`` adds that up over a text's links, and ``n_best`` counts the links
    whose pair no other of the same A id beats.

    Null and empty texts, and those whose tokens don't give the bytes back (a U+2581 in the text), have no tokens: all numbers are 0 and
    ``groups`` and its hash are empty. One row for each input row, repeated and null ids as they are; further columns are not used. An empty table gives
    an empty result. Only numbers are shuffled: one row for each pair of a task and each text; the counts of pairs are broadcast if they are few.
    """
    aligned = cut(align_tokens(docs, byte_path, piece_path, id_col=id_col, text_col=text_col, groups=groups), "aligned")
    counts = pair_counts(aligned)
    few = has_at_most(counts, BROADCAST_IDS)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "uses")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.uses").alias("uses"))
    sums = links.join(F.broadcast(counts) if few else counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"), F.sum(F.col("uses") * F.col("n_docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "uses").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"),
        "groups", "groups_sha256")
