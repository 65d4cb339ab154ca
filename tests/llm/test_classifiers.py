import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from iocscan.llm import quality, toxicity
from iocscan.llm.quality import coordinate_descent, indicators, learn_quality, score_quality
from iocscan.llm.toxicity import Lexicon, fold, learn_lexicon, matches, score_toxicity

from .helpers import empty, odd_rows, sentence, table


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_folding():
    assert fold("You 1d10t! ІDІОТ $tup1d") == " you idiot idiot stupid "
    assert fold("ｉｄｉｏｔ ídiot i​diot") == " idiot idiot idiot "
    assert fold("in 2024 there were 15") == " in there were "
    assert fold("") == "  "


def test_matches_and_exceptions():
    lexicon = Lexicon({" trash ": 2.0, " idio": 3.0, " idiotic ": 4.0}, [" trash can "], (1.0, 0.0, 0.0))
    made = lexicon.automaton()
    assert [w for _, w in matches(fold("Trash, idiot idiotic ashtrash trash can"), made)] == [2.0, 3.0, 4.0]
    assert matches(fold("anything"), Lexicon({}, [], (0, 0, 0)).automaton()) == []


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(spark, name):
    folder = "/root/testdata/sf0.01"
    from iocscan.llm.queries import QUERIES
    query = {"toxic": "op8_toxicity", "quality": "op9_quality_classifier"}[name]
    rows = QUERIES[query](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and auc([(r.score, r[name]) for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if name == "toxic" else 0.5)) for r in rows)


def test_labels_of_held_out_rows_play_no_part(spark):
    rows = [(i, sentence(i, 40) + (" vile" * 5 if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").where(~toxicity.held_out(F.col("doc_id")))
    turned = df.withColumn("label", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("label")).otherwise(F.col("label")))
    assert learn_lexicon(df) == learn_lexicon(turned)
    assert " vile " in learn_lexicon(df).weights


def test_odd_rows(spark):
    random.seed(1)
    rows = [(i, t, random.choice([0, 1, None])) for i, t in odd_rows()]
    labelled = table(spark, rows, "doc_id long, text string, mark int")
    docs = table(spark, odd_rows())
    for learn, score, column in ((learn_lexicon, score_toxicity, "toxicity"), (learn_quality, score_quality, "quality")):
        for source in (labelled, labelled.where("mark = 1"), labelled.where("mark = 0"), labelled.where("mark > 5")):
            found = score(docs, learn(source, label_col="mark"))
            assert found.columns == [*docs.columns, column]
            scores = {}
            for r in found.select("text", column).collect():
                assert 0 <= r[1] <= 1 and scores.setdefault(r[0] or "", r[1]) == r[1]
        assert score(empty(spark), learn(labelled, label_col="mark")).collect() == []


def test_sample_bound_keeps_learning(spark):
    rows = [(i, sentence(i, 30) + (" rotten rotten" if i % 2 else ""), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert " rotten " in learn_lexicon(df, sample_rows=150).weights


def test_coordinate_descent_reaches_the_optimum():
    """No single dual variable can be moved to a better value any more."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    labels = np.array([int(r.min() < 4) for r in rows])
    scale = rng.normal(size=quality.DIMENSIONS)
    weights, bias = coordinate_descent(rows, labels, scale, rounds=3000)
    y = np.where(labels == 1, 1, -1)

    def loss(w, b):
        margins = np.array([w[r] @ (scale[r] / np.sqrt(len(r))) for r in rows]) + b
        share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
        return 0.5 * (w @ w + b * b) + (np.maximum(0, 1 - y * margins) / (2 * share)).sum()
    w = np.zeros(quality.DIMENSIONS)
    used = np.unique(np.concatenate(rows))
    w[used] = weights[used] / scale[used]
    best = loss(w, bias)
    for _ in range(200):
        step = np.zeros(quality.DIMENSIONS)
        step[used] = rng.normal(size=len(used)) * 10.0 ** rng.uniform(-4, -1)
        assert loss(w + step, bias + rng.normal() * 1e-3) >= best - 1e-3


def test_indicators_see_shape_and_repeats():
    calm, loud, again = indicators([b"this is a text", b"THIS IS!! A TEXT!!", b"this this this this"])
    assert len(set(loud) - set(calm)) > 3 and len(set(again) - set(calm)) > 2
    assert [len(x) for x in indicators([b"", b" \n"])] == [0, 0]


def brute_lexicon(rows):
    """Entries and their weights from plain counts of all terms of all rows (text, label)."""
    texts, uses, words = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    for text, label in rows:
        found = toxicity._terms(fold(text))
        texts[label].update(found.keys())
        uses[label].update(found)
        words[label] += len(re.split(r"\s+", text))
    total = Counter(label for _, label in rows)
    ranked = []
    for term, n in texts[1].items():
        m = texts[0][term]
        rate = (n + m) / len(rows)
        gain = n * math.log(n / (rate * total[1])) + (m * math.log(m / (rate * total[0])) if m else 0.0)
        weight = math.log((uses[1][term] + 0.5) / (words[1] + 1)) - math.log((uses[0][term] + 0.5) / (words[0] + 1))
        if n >= 5 and gain > 8 and weight > 1.5:
            ranked.append((-round(gain, 9), -len(term), term, weight))
    chosen = {}
    for _, _, term, weight in sorted(ranked):
        if not any(term.startswith(other) or other.startswith(term) for other in chosen):
            chosen[term] = weight
    return chosen


def test_entries_equal_brute_force_and_have_no_cap(spark):
    rng = random.Random(6)
    bad = ["".join(rng.choice("bcdfgjklmnpqrstvwxz") for _ in range(9)) for _ in range(2_600)]
    rows = [(sentence(i, 30), 0) for i in range(400)]
    rows += [(" ".join([sentence(900 + i, 5), *(bad[(26 * i + k) % len(bad)] for k in range(130))]), 1) for i in range(500)]
    rows += [("vile words " + sentence(5000 + i, 20), int(i % 3 > 0)) for i in range(90)]
    expected = brute_lexicon(rows)
    found = learn_lexicon(spark.createDataFrame(rows, "text string, label int")).weights
    assert len(expected) > 2_000
    assert found.keys() == expected.keys()
    assert all(abs(found[t] - w) < 1e-9 for t, w in expected.items())
