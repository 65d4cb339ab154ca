"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: words, pairs of words, and runs of word shapes. Every
indicator is scaled by the logarithm of how much more of its class's texts have it (the log-count ratio of naive
Bayes), and a linear model with hinge loss is fitted to that by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import binary_values, fold_table, mix, shingle_hashes, small_batches, sorted_unique, word_hashes

#: Labelled rows that the model is fitted on at most; a sample by the text's hash where there are more.
SAMPLE_ROWS = 10_000
#: Indicators are numbered by hash.
DIMENSIONS = 1 << 18
#: Shapes in a row that make an indicator, at most.
SHAPES = 4
_WHITE_ONLY = bytes(0x20 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
#: Capital letters, small letters (with all non-ASCII signs) and digits by one sign each; others as they are.
_SHAPE = bytes(
    0x20 if c in b" \t\n\x0b\x0c\r" else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39
    else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else c for c in range(256))


def _runs(shaped: bytes) -> bytes:
    """Shapes without repeats of a sign: ``AAa..`` as ``Aa.``."""
    data = np.frombuffer(shaped, np.uint8)
    if len(data) < 2:
        return shaped
    keep = np.empty(len(data), bool)
    keep[0] = True
    np.not_equal(data[1:], data[:-1], out=keep[1:])
    return data[keep].tobytes()


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct indicator numbers of each text."""
    exact = word_hashes(texts, _WHITE_ONLY)
    shapes = word_hashes([_runs(t.translate(_SHAPE)) for t in texts], _WHITE_ONLY)
    folded = word_hashes(texts, fold_table("".join(chr(c) for c in range(128) if not chr(c).isalnum())))
    out = []
    for words, shape, plain in zip(exact, shapes, folded, strict=True):
        same = (words[1:] == words[:-1]).astype(np.uint64) + np.uint64(1)
        kinds = [plain, mix(shingle_hashes(plain, 2) ^ np.uint64(1))]
        kinds += [mix(shingle_hashes(shape, n) ^ np.uint64(10 + n)) for n in range(1, SHAPES + 1)]
        kinds += [mix(shingle_hashes(same, n) ^ np.uint64(20 + n)) for n in range(1, SHAPES + 1)]
        numbers = sorted_unique((np.concatenate(kinds) >> np.uint64(64 - 18)).astype(np.int32))
        out.append(numbers)
    return out


@dataclass
class Model:
    """Weights by indicator, and the line from margins to log-odds."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float]

    def margin(self, numbers: np.ndarray) -> float:
        if not len(numbers):
            return self.bias
        return float(self.weights[numbers].sum()) / float(np.sqrt(len(numbers))) + self.bias

    def score(self, numbers: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.margin(numbers) + self.curve[1], -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = []
    for label in (1, 0):
        mine = [r for r, y in zip(rows, labels, strict=True) if y == label]
        found = np.bincount(np.concatenate(mine), minlength=DIMENSIONS) if mine else np.zeros(DIMENSIONS)
        counts.append((found + alpha) / (len(mine) + 2 * alpha))
    return np.log(counts[0] / counts[1])


def coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, *, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear hinge-loss model on rows of scaled indicators, by dual coordinate descent.

    Row i is ``scale`` at its indicators, divided by the root of their number; the bias is one more indicator. One dual
    variable between 0 and its class's cost belongs to each row; each step sets one of them to its best value.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([np.mean(y > 0), np.mean(y < 0)])
    most = np.where(y > 0, cost / (2 * max(share[0], 1e-9)), cost / (2 * max(share[1], 1e-9)))
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(DIMENSIONS), 0.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            better = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            step = (better - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = better
                largest = max(largest, abs(step) * norms[i])
        if largest < 1e-3:
            break
    return w * scale, bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of labelled rows; margins are turned into scores by a fifth of the rows that the fit for it leaves out."""
    from .toxicity import logistic_fit

    if len(set(labels.tolist())) < 2:
        sure = 3.0 if len(labels) and labels[0] == 1 else -3.0
        return Model(np.zeros(DIMENSIONS), 0.0, (1.0, sure if len(labels) else 0.0))
    fold = np.arange(len(rows)) % 5 == 4
    first = [r for r, out in zip(rows, fold, strict=True) if not out]
    scale = log_count_ratios(first, labels[~fold])
    trial = Model(*coordinate_descent(first, labels[~fold], scale), (1.0, 0.0))
    margins = np.array([[trial.margin(r)] for r, out in zip(rows, fold, strict=True) if out])
    slope, constant = logistic_fit(margins, labels[fold], ridge=1e-2) if len(margins) else (1.0, 0.0)
    scale = log_count_ratios(rows, labels)
    return Model(*coordinate_descent(rows, labels, scale), (max(float(slope), 1e-3), float(constant)))


def learn_quality(docs: DataFrame, *, text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows (label 1: good), about ``sample_rows`` of them at most, chosen by the text's hash.

    Rows with a null label are not learned from; a null text is empty. The indicators of the sample, and only those,
    come to one place to be fitted. With labels of one kind only all texts get one score; without any, 0.5.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    total = rows.count()
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(total)) < sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = indicators(binary_values(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "numbers"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = sorted((n or b"", y) for b in batches for n, y in zip(b.column("numbers").to_pylist(), b.column("label").to_pylist(), strict=True))
        labelled.sort(key=lambda r: hash_of(r[0]))
        model = fit([np.frombuffer(n, np.int32) for n, _ in labelled], np.array([y for _, y in labelled], np.int64))
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([
            pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([model.weights[used].tobytes()], pa.binary()),
            pa.array([[model.bias, *model.curve]], pa.list_(pa.float64()))], names=["used", "weights", "line"])

    def hash_of(numbers: bytes) -> int:
        return int(mix(np.array([len(numbers) * 31 + sum(numbers[:64])], np.uint64))[0])
    found = rows.mapInArrow(run, "label int, numbers binary").repartition(1)
    row = found.mapInArrow(train, "used binary, weights binary, line array<double>").first()
    weights = np.zeros(DIMENSIONS)
    weights[np.frombuffer(row.used, np.int32)] = np.frombuffer(row.weights)
    return Model(weights, row.line[0], (row.line[1], row.line[2]))


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1, higher where the text is likelier to be good.

    Null and empty texts get the score of a text without indicators. All rows and other columns stay; a column
    that is called ``name`` is replaced. Texts are read whole.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            scores: list[float] = []
            for start in range(0, len(series), 200):
                some = [(t or "").encode() for t in series.iloc[start:start + 200]]
                scores += [shared.value.score(n) for n in indicators(some)]
            yield pd.Series(scores, dtype="float64")
    return docs.withColumn(name, score(F.col(f"`{text_col}`").cast("string")))
