import math
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from iocscan.llm import ngrams
from iocscan.llm.ngrams import EliasFano, Trie, score_texts

from .helpers import empty, odd_rows, table, white_words


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (1, 2 ** 40), (1024, 10 ** 6), (5000, 4999), (3000, 2 ** 45), (2049, 3)])
def test_elias_fano_keeps_rising_numbers(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    with tempfile.TemporaryFile() as file:
        coded = EliasFano(values, file)
        assert np.array_equal(coded.all(), values)
        distinct = np.unique(values)
        coded = EliasFano(distinct, file)
        wanted = np.unique(np.concatenate([distinct, rng.integers(0, top, 300).astype(np.uint64)]))
        at = {int(v): i for i, v in enumerate(distinct)}
        assert coded.find(wanted).tolist() == [at.get(int(w), -1) for w in wanted]


def test_trie_answers():
    rng = np.random.default_rng(5)
    counts = Counter(zip(rng.integers(0, 50, 4000).tolist(), rng.integers(0, 300, 4000).tolist(), strict=True))
    pairs = sorted(counts)
    trie = Trie(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64), np.array([counts[p] for p in pairs]), {}, 0.5)
    asked = sorted(set(pairs) | {(int(a), int(b)) for a, b in rng.integers(0, 320, (500, 2))})
    got = trie.lookup(np.array([a for a, _ in asked], np.uint64), np.array([b for _, b in asked], np.uint64))
    uses = Counter(c for c, _ in counts.elements())
    for (c, w), q in zip(asked, got.tolist(), strict=True):
        if (c, w) in counts:
            assert abs(2 ** (-q / ngrams._STEPS) / ((counts[c, w] - 0.5) / uses[c]) - 1) < 0.002
        else:
            assert q == ngrams._UNSEEN
    n, followers = trie.about(np.array([3, 49, 60], np.uint64))
    assert n.tolist() == [uses[3], uses[49], 0] and followers.tolist() == [len({w for c, w in counts if c == x}) for x in (3, 49, 60)]


def brute(rows, learn):
    single, pairs = Counter(), Counter()
    for (_, text), use in zip(rows, learn, strict=True):
        if use:
            w = white_words(text)
            single.update([*w, None])
            pairs.update(zip([0, *w], [*w, None], strict=True))
    uses, followers = Counter(), Counter()
    for (c, _), n in pairs.items():
        uses[c] += n
        followers[c] += 1
    total, kinds, d = sum(single.values()), len(single), ngrams.DISCOUNT
    out = []
    for doc, text in rows:
        w, base, score, known = white_words(text), 0.0, 0.0, 0
        for c, x in zip([0, *w], [*w, None], strict=True):
            p = (single[x] + 0.5) / (total + 0.5 * (kinds + 1))
            known += single[x] > 0
            base += math.log10(p)
            score += math.log10(max(pairs[c, x] - d, 0) / uses[c] + d * followers[c] / uses[c] * p if uses[c] else p)
        out.append((doc, len(w) + 1, known, total, base, score))
    return out


@pytest.mark.parametrize("chunk,shard", [(8 << 20, 12 << 20), (40_000, 60_000)])
def test_same_as_brute_force(spark, monkeypatch, chunk, shard):
    """In one shard, and in several with frequent contexts spread over them."""
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ngrams, "SHARD_BYTES", shard)
    rows = odd_rows()
    found = score_texts(table(spark, rows), F.col("doc_id") % 3 != 0).collect()
    expected = brute(rows, [r[0] is not None and math.fmod(r[0], 3) != 0 for r in rows])
    for got, want in zip(sorted(map(tuple, found), key=str), sorted(expected, key=str), strict=True):
        assert got[:4] == want[:4]
        assert got[4] == pytest.approx(want[4], rel=1e-9) and abs(got[5] - want[5]) < 1.2e-4 * want[1] + 1e-6


def test_nothing_to_learn_from(spark):
    found = score_texts(table(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted(map(tuple, found)) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert score_texts(empty(spark), F.lit(True)).collect() == []
