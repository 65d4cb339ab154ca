import math
import re
from collections import Counter

import pytest
import regex
import xxhash

from iocscan.llm.qualityrules import bucket_weights, quality_rules

from .helpers import edited, empty, odd_rows, sentence, table

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def xx(*parts):
    """Spark's xxhash64: each value with the hash of those before it as seed."""
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def grams(text, buckets):
    found = regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N} \t\n\x0b\f\r]+", (text or "").lower())
    return [xx(t) % buckets for t in found] + [xx(a, b) % buckets for a, b in zip(found, found[1:], strict=False)]


def base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def corpus():
    rows = odd_rows()[:13] + odd_rows()[15:]
    rows += [(300 + i, f"{sentence(700 + i, 30)}\n" * (i % 4) + sentence(900 + i, 5 + i)) for i in range(60)]
    rows += [(400 + i, " ".join(f"w{i * j % 400}&&&" for j in range(40))) for i in range(12)]
    rows += [(500, "line one\n\n \nline one\nline two # * | <b>\nline one"), (501, "a b c d e f a b c d e g h i j k l"), (502, "x " * 30)]
    return rows + [(503, " ".join(f"u{i}" for i in range(9))), (504, " ".join(f"u{i}" for i in range(10))), (505, "\x0bé ü \x1f")]


def test_weights_and_scores_same_as_brute_force(spark):
    rows, buckets, smoothing = corpus(), 500, 300.0
    trusted = [r[0] for r in rows if r[0] is not None and (300 <= r[0] < 400 or r[0] < 300 and r[0] % 3 == 0)]
    everything, good = Counter(), Counter()
    for doc, text in rows:
        everything.update(grams(text, buckets))
        if doc in trusted:
            good.update(grams(text, buckets))
    n, m = sum(everything.values()), sum(good.values())
    expected = [
        math.log((good[b] + smoothing * everything[b] / n) / (m + smoothing) * n / everything[b]) if everything[b] else 0.0 for b in range(buckets)]
    ids = spark.createDataFrame([(d,) for d in [*trusted, trusted[0], None]], "doc_id long")
    weights = bucket_weights(table(spark, rows), ids, buckets=buckets, smoothing=smoothing)
    assert weights == pytest.approx(expected, abs=1e-9)

    found = quality_rules(table(spark, rows), weights).collect()
    assert len(found) == len(rows)
    by_row = Counter((r.id, *(r[c] for c in BASE), round(r.log_ratio, 9)) for r in found)
    assert by_row == Counter(
        (doc, *base(text), round(sum(expected[b] for b in grams(text, buckets)) / max(1, len(grams(text, buckets))), 9)) for doc, text in rows)
    assert all(r.kept == (not r.base_failed and r.log_ratio >= -0.1) for r in found)
    assert len({r.kept for r in found}) == 2


def test_very_long_text(spark):
    rows = [(1, sentence(3, 60_000, 5_000)), (2, edited(sentence(3, 60_000, 5_000), 7, 200)), (3, "no " * 40_000)]
    found = {r.id: r for r in quality_rules(table(spark, rows), [0.0] * 8).collect()}
    for doc, text in rows:
        assert tuple(found[doc][c] for c in BASE) == base(text)


def test_without_rows_or_trust(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert bucket_weights(empty(spark), none, buckets=4) == [0.0] * 4
    assert bucket_weights(table(spark, corpus()), none, buckets=4) == [0.0] * 4
    assert quality_rules(empty(spark), [0.0] * 4).collect() == []


def test_query(spark, tmp_path):
    from iocscan.llm.queries import op11
    rows = corpus()
    table(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(not 400 <= d < 412), 0) for d, _ in rows if d is not None], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    found = op11(spark, str(tmp_path))
    assert found.columns == ["doc_id", *BASE, "log_ratio", "kept"]
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    rows_found = found.collect()
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in rows_found) == Counter((d, *base(t)) for d, t in rows)
    assert {r.kept for r in rows_found if 400 <= (r.doc_id or 0) < 412} == {False}
    assert {r.kept for r in rows_found if 200 <= (r.doc_id or 0) < 220} == {True}
