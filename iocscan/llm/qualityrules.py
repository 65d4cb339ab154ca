"""Quality rules: simple counts of a text, and how much more its n-grams look like trusted texts than like the whole corpus.

Single tokens and pairs of neighbours are hashed into a fixed number of buckets. Two multinomials over the buckets, one of trusted texts and one of
all texts, give each bucket a log-likelihood ratio; a text's score is the mean over its n-grams, and the same threshold holds for every text.
Built-in expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Buckets of n-grams: the weights are an array of this size, whatever the corpus.
BUCKETS = 10_000
#: Trusted texts that are counted at most, about (their ids are broadcast, 8 bytes each). The corpus is always counted whole.
TRUSTED_ROWS = 1_000_000
#: Pseudo-counts that the trusted multinomial takes from the corpus.
SMOOTHING = 10_000.0
#: Mean log ratio (natural) of an n-gram from which a text is kept. Ordinary texts are near 0 or above.
THRESHOLD = -0.1
#: Words below which a text fails, and the share of words in repeated windows, in percent, above which it does.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words in a window.
WINDOW = 5
_SPACE = r"\x20\x09-\x0D"
_SYMBOLS = r"[#*$%&|<>]"
#: A token: letters and digits, or other signs, without white space.
_TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and of other signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets))


def _gram_rows(docs: DataFrame, *kept: str, buckets: int) -> DataFrame:
    """``kept`` and the ``bucket`` of each token and each pair of neighbours."""
    rows = docs.select(*kept, tokens(F.col("text")).alias("t"))
    rows = rows.select(*kept, F.explode(F.arrays_zip("t", F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("n"))).alias("p"))
    pair = F.when(F.col("p.n").isNotNull(), _bucket(F.col("p.t"), F.col("p.n"), buckets=buckets))
    rows = rows.select(*kept, F.explode(F.array(_bucket(F.col("p.t"), buckets=buckets), pair)).alias("bucket"))
    return rows.where(F.col("bucket").isNotNull())


def bucket_weights(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING,
    trusted_rows: int = TRUSTED_ROWS,
) -> list[float]:
    """For each bucket the log of how much likelier its n-grams are in trusted texts than in all texts.

    ``trusted`` has the ids (``id_col``) of trusted texts; repeated and null ones don't matter. All texts are counted for the corpus, the trusted ones
    among them too; of more than ``trusted_rows`` trusted ids about so many are taken, chosen by their hash. The trusted multinomial is smoothed towards
    that of the corpus, so a bucket without a trusted n-gram has a finite weight. A bucket without any n-gram has weight 0, and so have all if no text is trusted.
    """
    docs = texts_of(docs, id_col, text_col)
    ids = trusted.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct()
    total = ids.count()
    if total > trusted_rows:
        ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(total)) < trusted_rows)
    flagged = docs.join(F.broadcast(ids.withColumn("trusted", F.lit(1))), "id", "left")
    counts = _gram_rows(flagged, "trusted", buckets=buckets).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count("trusted").alias("n_trusted")).collect()
    everything, all_trusted = sum(c.n for c in counts), sum(c.n_trusted for c in counts)
    out = [0.0] * buckets
    for c in counts if all_trusted else ():
        share = c.n / everything
        out[c.bucket] = math.log((c.n_trusted + smoothing * share) / (all_trusted + smoothing) / share)
    return out


def _mean_ratio(t: Column, weights: Column, buckets: int) -> Column:
    """Mean weight of the n-grams of a column of tokens; 0 without tokens."""
    n = F.size(t)
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda total, i: total + F.get(weights, _bucket(F.get(t, i), buckets=buckets).cast("int"))
        + F.when(i + 1 < n, F.get(weights, _bucket(F.get(t, i), F.get(t, i + 1), buckets=buckets).cast("int"))).otherwise(0.0))
    return F.when(n > 0, total / (2 * n - 1)).otherwise(0.0)


def _repeated_words(ordered: Column) -> Column:
    """Words in windows that occur twice; ``ordered`` has (window, place) in order, null if all windows differ."""
    again = F.filter(ordered, lambda x, k: (F.get(ordered, k + 1)["h"] == x["h"]) | (F.get(ordered, k - 1)["h"] == x["h"]))
    # in order of places each window adds the words that the one before doesn't have
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return F.coalesce(covered, F.lit(0).cast("long"))


def quality_rules(
    docs: DataFrame, weights: list[float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept) of each text.

    Words are what lies between ASCII white space, ``word_chars`` their code points. ``n_dup_lines`` are lines with a word that equal an earlier one,
    ``n_repeat_words`` the words in windows of five that occur twice or more in the text. A text fails with fewer than ten words or more
    than a fifth of them repeated. ``log_ratio`` is the mean of ``weights`` (``bucket_weights``) over the text's n-grams; a text is kept if it
    doesn't fail and its ratio is ``threshold`` or more.

    Null and empty texts have no words and fail. One row for each input row, with its id, repeated and null ids as they are; further
    columns are not used. An empty table gives an empty result. Nothing is shuffled.
    """
    buckets = len(weights)
    weight = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # a constant
    docs = texts_of(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = docs.select(
        "id", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{_SPACE}]+")).alias("words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(f"[{_SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
        tokens(F.col("text")).alias("tokens"))
    kept = ["id", "word_chars", "n_symbols", "n_words", "n_dup_lines", "log_ratio"]
    rows = rows.select(
        "id", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _mean_ratio(F.col("tokens"), weight, buckets).alias("log_ratio"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = F.when(
        F.size("hashes") > WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + j) for j in range(WINDOW)])))
    rows = rows.select(*kept, windows.alias("windows"))
    # most texts repeat no window, and only the others are put in order
    ordered = F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*kept, ordered.alias("ordered"))
    rows = rows.select(*kept, _repeated_words(F.col("ordered")).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "log_ratio",
        (~failed & (F.col("log_ratio") >= threshold)).alias("kept"))
