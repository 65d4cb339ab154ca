import numpy as np
import pytest

from iocscan.llm import jaccard
from iocscan.llm.jaccard import shingle_sets, similar_documents, sketch

from .helpers import edited, empty, odd_rows, sentence, table, white_words


def brute(rows, size, percent):
    """{row number: component} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = white_words(text)
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = {}
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.setdefault(doc, set()).add((len(sets[i]), min(ids) if ids and sets[i] else doc))
    return out


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_same_as_all_pairs(spark, size, percent):
    rows = odd_rows()
    found = similar_documents(table(spark, rows), size=size, percent=percent).collect()
    assert len(found) == len(rows)
    expected = brute(rows, size, percent)
    got = {}
    for r in found:
        got.setdefault(r.id, set()).add((r.n_shingles, r.component))
    # a null id is named by its group, or by nothing
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in expected.items() if k is not None}


def test_chain_without_a_centre(spark):
    """Each text is linked to the next only: the group must still hold together."""
    text, rows = sentence(40, 200), []
    for i in range(30):
        rows.append((i, text))
        text = edited(text, 900 + i, 2)
    got = {r.id: r.component for r in similar_documents(table(spark, rows, clash=False), size=3, percent=90).collect()}
    assert got == {k: next(iter(v))[1] for k, v in brute(rows, 3, 90).items()}


def test_empty(spark):
    assert similar_documents(empty(spark)).collect() == []


def test_sketch_never_overstates_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 60, 700):
        one = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        two = np.concatenate([one[: n - n // 10], rng.integers(0, 2 ** 63, n // 8, dtype=np.uint64)])
        for words in (1, 4, 16):
            distance = int(np.bitwise_count(sketch(one, words) ^ sketch(two, words)).sum())
            assert distance <= len(np.setxor1d(one, two))


def test_linked_sizes_share_a_band():
    ends = jaccard._bands(90)
    for a in range(1, 3000):
        b = a * 100 // 90
        i, j = (int(np.searchsorted(ends, x, side="right")) - 1 for x in (a, b))
        assert j - i <= 1


def test_words_are_cut_at_ascii_white_space_only():
    sets = shingle_sets(["A b c".encode(), "a B c".encode(), "a b c".encode()], 2)
    assert np.array_equal(sets[0], sets[1]) and len(sets[2]) == 2
