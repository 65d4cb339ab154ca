import hashlib
import random
import zlib

import pytest

from iocscan.llm import runs
from iocscan.llm.runs import altered, longest_run, periodic_runs

from .helpers import empty, odd_rows, table


def brute(words):
    """All maximal stretches with a period, each with its smallest one."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def words_of(text):
    return (text or "").encode().split()


def repetitive(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        kinds = rng.choice([1, 2, 2, 3, 5, 30])
        words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            period = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 14))]
            stretch = period * rng.randrange(1, 9)
            at = rng.randrange(len(words) + 1)
            words[at:at] = stretch[:len(stretch) - rng.randrange(len(period))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(words * (rng.randrange(1, 8) if rng.random() < 0.1 else 1))))
    return out


def flat(rows):
    return {(r.id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in rows}


@pytest.mark.parametrize("batch", [1, 300, 1 << 17])
def test_same_as_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(runs, "BATCH_WORDS", batch)
    rows = repetitive(batch, 250)
    expected = set()
    for doc, text in rows:
        words = words_of(text)
        found = brute(words)
        expected.add((doc, len(words), tuple(found), b" ".join(kept(words, found)).decode()))
    assert sum(len(e[2]) for e in expected) > 200
    # the module's own setting reaches the tasks only where they run in this process
    got = {(doc, len(words_of(text)), tuple(map(tuple, r.tolist()))) for (doc, text), r in zip(
        rows, runs._found([words_of(t) for _, t in rows]), strict=True)}
    assert got == {e[:3] for e in expected}
    assert flat(periodic_runs(table(spark, rows)).collect()) == expected


def test_odd_rows(spark):
    rows = odd_rows() + [(600, "la " * 5), (601, "la " * 6), (602, "a b " * 3 + "a"), (603, "a b " * 4), (604, "    " * 9), (605, "x y z " * 4_000)]
    found = periodic_runs(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.id: r for r in found}
    for doc, text in rows:
        if doc is not None and len(text or "") < 20_000:
            words = words_of(text)
            assert [tuple(x) for x in by_id[doc].runs] == brute(words)
            assert by_id[doc].collapsed_sha256 == hashlib.sha256(b" ".join(kept(words, brute(words)))).hexdigest()
    assert [tuple(x) for x in by_id[25].runs] == [(0, 3000, 1)] and by_id[25].collapsed == "a"
    assert [tuple(x) for x in by_id[605].runs] == [(0, 12_000, 3)] and by_id[605].collapsed == "x y z"
    assert by_id[600].runs == [] and len(by_id[601].runs) == 1 and by_id[602].runs == [] and len(by_id[603].runs) == 1
    assert by_id[16].collapsed == "" and by_id[16].runs == [] and by_id[16].n_words == 0
    assert sum(r.id is None for r in found) == 2
    assert periodic_runs(empty(spark)).collect() == []


def test_longest_run_and_ties(spark):
    text = "a " * 8 + "b c " * 4 + "x " * 8 + "end"
    row = periodic_runs(table(spark, [(1, text), (2, "no runs")])).select("id", longest_run("runs").alias("best")).collect()
    best = {r.id: r.best for r in row}
    assert (best[1].start, best[1].length, best[1].period) == (0, 8, 1) and best[2] is None


def test_query_alters_one_text_of_ten(spark, tmp_path):
    from iocscan.llm.queries import op13
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i % 90))) for i in range(300)] + [(900, None), (901, "")]
    table(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op13(spark, str(tmp_path)).collect()}
    changed = 0
    for doc, text in rows:
        words = words_of(text)
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert altered(words_of(text), doc) == words
        expected, row = brute(words), found[doc]
        best = max(expected, key=lambda r: (r[1], -r[0], -r[2])) if expected else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(expected), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if expected else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in expected).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(kept(words, expected))).hexdigest()
    assert changed > 15 and sum(r.n_runs for r in found.values()) > 5
