"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: homoglyphs become the letters they look like, and digits and signs inside words
the letters they stand for. The lexicon holds whole words and beginnings of words, each with the logarithm of how
much more often it comes in toxic than in other texts. Weights of matches are summed, those inside an
exception phrase left out, and normalised by the number of words; a logistic curve makes a score of that.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import small_batches

#: Labelled rows that are learned from at most; a sample by hash where there are more.
SAMPLE_ROWS = 20_000
#: Least number of toxic texts with an entry, and of other texts with an exception phrase.
LEAST_TEXTS = 5
#: How much an entry must tell about texts at least (log-likelihood ratio), and its least weight.
LEAST_GAIN, LEAST_WEIGHT = 8.0, 1.5
#: Lengths of word beginnings that can be entries.
BEGINNINGS = range(3, 9)

# --- fixed values: letters that look alike, and signs that stand for letters ---
#: Cyrillic and Greek letters by the Latin letter they look like.
_LOOKALIKES = {
    "a": "аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ⅼӏ",
    "m": "мⅿ", "n": "ոη", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω",
    "x": "хχ", "y": "уγ", "z": "ᴢζ"}
#: Digits and signs that stand for a letter within a word.
_STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# --- end of fixed values ---

_SAME = {ord(sign): letter for letter, signs in _LOOKALIKES.items() for sign in signs}


class _Folding(dict):
    """Translation of single characters, found out as they come: letters lower-cased, the rest to a space."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        if "！" <= sign <= "～" or "𝐀" <= sign <= "𝟿":
            sign = unicodedata.normalize("NFKC", sign)
        if unicodedata.combining(sign[0]) or sign in "­​‌‍⁠":
            folded = ""
        elif sign in _STAND_INS or sign in "'’":
            folded = sign
        elif sign.isalpha():
            folded = "".join(_SAME.get(ord(c), c) for c in sign.lower())
        else:
            folded = " "
        self[code] = folded
        return folded


_FOLDING = _Folding()
_LETTERS = {ord(sign): letter for sign, letter in _STAND_INS.items()} | {ord("'"): "", ord("’"): ""}


def fold(text: str) -> str:
    """Folded words of a text, one space between them and around all."""
    words = []
    for word in text.translate(_FOLDING).split():
        if not word.isalpha():
            core = word.strip("'’").rstrip("@$")
            if not any(map(str.isalpha, core)):
                continue  # a number
            word = core.translate(_LETTERS)
        words.append(word)
    return f" {' '.join(words)} "


@dataclass
class Lexicon:
    """Entries (" word " or " beginning") with weights, phrases (" two words "), and the logistic curve."""

    weights: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        if len(made):
            made.make_automaton()
        return made


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """(place of the word, weight) of the entries that match, but for words inside an exception phrase."""
    if not len(automaton):
        return []
    found: dict[int, tuple[int, float]] = {}
    excepted: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excepted.append((start, end))
        elif start not in found or found[start][0] < length:
            found[start] = (length, weight)  # the longest entry of a word counts
    for start, end in excepted:
        for at in range(start, end):
            found.pop(at, None)
    return [(at, weight) for at, (_, weight) in found.items()]


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Weight of the matches per word, on a root scale, and how much weight there is at all."""
    total = sum(weight for _, weight in matches(folded, automaton))
    words = max(1, folded.count(" ") - 1)
    return math.sqrt(max(0.0, total) / words), math.log1p(max(0.0, total))


def _terms(folded: str) -> Counter[str]:
    counts: Counter[str] = Counter()
    for word, n in Counter(folded.split()).items():
        counts[f" {word} "] += n
        for length in BEGINNINGS:
            if length < len(word):
                counts[f" {word[:length]}"] += n
    return counts


def _counted(rows: DataFrame) -> DataFrame:
    """(term, texts, uses) over the folded texts of ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, uses = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                for term, n in _terms(fold(text or "")).items():
                    texts[term] += 1
                    uses[term] += n
            yield pa.RecordBatch.from_arrays([
                pa.array(list(texts), pa.string()), pa.array(list(texts.values()), pa.int64()),
                pa.array([uses[t] for t in texts], pa.int64())], names=["term", "texts", "uses"])
    counted = rows.select("text").mapInArrow(run, "term string, texts long, uses long")
    return counted.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("uses").alias("uses"))


def telling_terms(bad: DataFrame, good: DataFrame, texts: tuple[int, int], words: tuple[int, int]) -> DataFrame:
    """(term, gain, weight) of the terms (term, texts, uses) of toxic texts that tell enough, all of them.

    ``gain`` is the log-likelihood ratio of how many texts of two kinds have the term, ``weight`` the log ratio of its uses. ``texts``
    and ``words`` are how many there are, of toxic and of other texts.
    """
    both = bad.select("term", F.col("texts").alias("n"), F.col("uses").alias("u")).join(
        good.select("term", F.col("texts").alias("m"), F.col("uses").alias("v")), "term", "left").fillna(0, ["m", "v"])
    rate = (F.col("n") + F.col("m")) / float(texts[0] + texts[1])
    gain = sum(
        F.col(c) * F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-9)) / (rate * float(total))) for c, total in zip("nm", texts, strict=True))
    weight = F.log((F.col("u") + 0.5) / float(words[0] + 1)) - F.log((F.col("v") + 0.5) / float(words[1] + 1))
    return both.select("term", gain.alias("gain"), weight.alias("weight")).where((F.col("weight") > LEAST_WEIGHT) & (F.col("gain") > LEAST_GAIN))


def choose_entries(terms: list[tuple[str, float, float]]) -> dict[str, float]:
    """Weights of the chosen ones among terms (term, gain, weight).

    Terms are taken by how much they tell; one that begins, or is begun by, a chosen one is left out, so a
    word matches one entry. Of equally telling ones the longest is taken.
    """
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, term, weight in sorted((-round(gain, 9), -len(term), term, weight) for term, gain, weight in terms):
        starts = {term[:i] for i in range(2, len(term))}
        if term in begun or any(s in chosen for s in starts):
            continue
        chosen[term] = weight
        begun |= starts
    return chosen


def _phrases(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(term, toxic, texts): two-word phrases that contain a match."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in small_batches(batches):
            counts: Counter[tuple[str, int]] = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                folded, own = fold(text or ""), set()
                for at, _ in matches(folded, automaton):
                    end = folded.index(" ", at + 1)
                    before = folded.rfind(" ", 0, at) if at else -1
                    after = folded.find(" ", end + 1)
                    if before >= 0:
                        own.add(folded[before:end + 1])
                    if after >= 0:
                        own.add(folded[at:after + 1])
                counts.update((phrase, toxic) for phrase in own)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "texts"])
    return rows.mapInArrow(run, "term string, toxic int, texts long")


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(label, a, b): the features of labelled rows."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in small_batches(batches):
            found = [features(fold(t or ""), automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())],
                names=["label", "a", "b"])
    return rows.mapInArrow(run, "label int, a double, b double")


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients, the constant last, of a logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(rows: DataFrame, *, text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from labelled rows (label 1: toxic), at most about ``sample_rows`` of them, chosen by the text's hash.

    Rows with a null label are not learned from; a null text is empty. Without toxic rows the lexicon is empty. All terms and
    phrases that tell enough are taken; each occurs in ``LEAST_TEXTS`` texts of the sample, so ``sample_rows`` bounds their number.
    """
    prepare(rows.sparkSession)
    rows = rows.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    total = rows.count()
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(total)) < sample_rows)
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    sizes = {r.label: (r.texts, r.words) for r in rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(words).alias("words")).collect()}
    if 1 not in sizes:
        return Lexicon({}, [], (0.0, 0.0, -6.0))
    bad, good = sizes[1], sizes.get(0, (1, 1))
    found = telling_terms(
        _counted(rows.where("label = 1")).where(F.col("texts") >= LEAST_TEXTS), _counted(rows.where("label = 0")), (bad[0], good[0]), (bad[1], good[1]))
    weights = choose_entries([(r.term, r.gain, r.weight) for r in found.collect()])
    lexicon = Lexicon(weights, [], (0.0, 0.0, -6.0))
    counts = _phrases(rows, lexicon).groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("good"))
    # a phrase that comes in other texts at least as often, text for text, as in toxic ones
    kept = counts.where((F.col("good") >= LEAST_TEXTS) & (F.col("bad") == 0))
    lexicon.exceptions = sorted(r.term for r in kept.collect())
    measured = _measured(rows, lexicon).toPandas()
    fitted = logistic_fit(measured[["a", "b"]].to_numpy(), measured["label"].to_numpy())
    lexicon.curve = (float(fitted[0]), float(fitted[1]), float(fitted[2]))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1, higher where the text is likelier to be toxic.

    Null and empty texts are scored as texts without matches. All rows and other columns stay as they are; a
    column that is called ``name`` is replaced. Texts are read whole.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = shared.value.automaton()
        a, b, c = shared.value.curve
        for series in texts:
            found = [features(fold(t or ""), automaton) for t in series]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c)))) for x, y in found], dtype="float64")
    return docs.withColumn(name, score(F.col(f"`{text_col}`").cast("string")))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents at most that may be learned from, chosen by the id's hash.

    Labels are sampled before they meet the texts, so what is broadcast has a bound and texts don't move. An id with
    several labels counts with the largest one; held-out ids and null labels are left out.
    """
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), label.alias("label")).where(~held_out(F.col("__id")) & F.col("label").isin(0, 1))
    known = known.groupBy("__id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(total)) < rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(F.broadcast(known), "__id").select("text", "label")


def held_out(id_column: Column, folds: int = 3) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text leaves 1 when divided by ``folds``."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds == 1
