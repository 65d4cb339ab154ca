import random
from collections import Counter

import numpy as np
import pytest

from iocscan.llm import substrings
from iocscan.llm.substrings import anchors, remove_repeats, repeated_windows

from .helpers import empty, odd_rows, table


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                covered[p:p + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(covered), np.uint8).astype(np.int8), [0]])))
        spans = tuple(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((doc, len(b), spans, bytes(x for x, m in zip(b, covered, strict=True) if not m)))
    return sorted(out, key=str)


def flat(rows):
    return sorted(((r.id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in rows), key=str)


def small_texts(seed, letters="ab", n=40):
    """Texts of few letters, with shared passages, so that strings repeat in every way."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 90))) for _ in range(6)]
    return [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice(letters) for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(6))))
            for i in range(n)]


@pytest.mark.parametrize("letters,length", [("ab", 30), ("a", 12), ("aé漢", 40), ("abcdefgh", 5)])
def test_same_as_brute_force(spark, monkeypatch, letters, length):
    monkeypatch.setattr(substrings, "PIECE", 64)
    monkeypatch.setattr(substrings, "BATCH_SYMBOLS", 2000)
    rows = small_texts(3, letters)
    assert flat(remove_repeats(table(spark, rows), length=length).collect()) == brute(rows, length)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 50_000]
    rows += [(900 + i, "shared " * 80 + f"own {i} " * 20) for i in range(30)]
    assert flat(remove_repeats(table(spark, rows)).collect()) == brute(rows, 400)
    assert remove_repeats(empty(spark)).collect() == []


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(8)
    passage = bytes(rng.randrange(97, 100) for _ in range(900))
    one = bytes(rng.randrange(97, 100) for _ in range(333)) + passage
    two = passage + bytes(rng.randrange(97, 100) for _ in range(100))

    def by_window(text):
        return {p: (h, at - p) for h, at, first, last in anchors(text, 400) for p in range(first, last + 1)}
    a, b = by_window(one), by_window(two)
    assert sorted(a) == list(range(len(one) - 399))
    assert all(a[333 + p] == b[p] for p in range(501))


def test_columns_against_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        group = np.sort(rng.integers(0, 3, n))
        sizes = rng.integers(10, 40, n)
        before = np.array([int(rng.integers(0, s)) for s in sizes])
        parts = [rng.integers(0, 2, s).astype(np.uint8) for s in sizes]
        got = repeated_windows(group, before, sizes, np.concatenate(parts), 6)
        for i in range(n):
            for p in range(int(sizes[i]) - 5):
                same = any(
                    j != i and group[j] == group[i] and 0 <= (q := p - before[i] + before[j]) <= sizes[j] - 6
                    and np.array_equal(parts[i][p:p + 6], parts[j][q:q + 6]) for j in range(n))
                assert got[i][p] == same


def test_passages_of_over_fifty_words_on_both_sides_of_the_length(spark):
    """Passages of 51 words or more that documents share: what has 400 bytes goes from both, what is shorter stays, and clean documents lose nothing."""
    rng = random.Random(51)

    def words(n, low, high):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(low, high))) for _ in range(n))
    passages = [words(51 + i % 12, 4, 8) if i % 2 else words(60 + i % 30, 6, 10) for i in range(40)]
    rows = []
    for i, passage in enumerate(passages):
        for k in range(2 + i % 3):
            rows.append((10 * i + k, f"{words(30, 3, 9)} {passage} {words(25, 3, 9)}"))
    clean = [(1_000 + i, words(120, 3, 9)) for i in range(40)]
    found = {r.id: r for r in remove_repeats(table(spark, rows + clean)).collect()}
    longer = [i for i, p in enumerate(passages) if len(p) >= 400]
    assert 10 < len(longer) < 35 and min(map(len, passages)) < 400
    for doc, text in rows:
        removed = sum(s.end - s.start for s in found[doc].spans)
        assert removed >= len(passages[doc // 10]) if doc // 10 in longer else removed in (0, *range(400, 410))
        assert found[doc].n_bytes == len(text)
    assert all(not found[doc].spans and bytes(found[doc].kept).decode() == text for doc, text in clean)
    assert flat(found.values()) == brute(rows + clean, 400)


def test_one_passage_in_a_third_of_all_documents(spark, monkeypatch):
    """The hot anchor case: stretches that reach into each document's own text, with a small bound on what is sorted together."""
    monkeypatch.setattr(substrings, "BATCH_SYMBOLS", 2_000)
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10 ** 6)}" for _ in range(70))
    rows = [(i, " ".join([f"a{rng.randrange(10 ** 6)}"] * 1 + [f"b{i}x{j}" for j in range(12)] + ([passage] if i % 3 == 0 else []) + [f"c{i}x{j}" for j in range(9)]))
            for i in range(600)]
    assert flat(remove_repeats(table(spark, rows)).collect()) == brute(rows, 400)
