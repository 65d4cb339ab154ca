"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            return run(prepare(spark), folder)

        QUERIES[name] = prepared
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_ngram_jaccard_join", oracles.JACCARD)
def op1(spark, folder):
    from .jaccard import similar_documents
    found = similar_documents(_table(spark, folder, "documents"), size=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@_query("op2_benchmark_decontamination", oracles.DECONTAMINATION)
def op2(spark, folder):
    from .decontaminate import contaminated_spans
    found = contaminated_spans(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@_query("op3_best_fit_packing")
def op3(spark, folder):
    import public_tokenizers

    from .packing import pack_documents
    packed = pack_documents(_table(spark, folder, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"), "offset")


@_query("op5_html_extraction")
def op5(spark, folder):
    from .htmltext import extract_main_text
    found = extract_main_text(_table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query("op4_document_fingerprints")
def op4(spark, folder):
    from .fingerprints import as_text, fingerprints, resemblance, with_next
    docs = _table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(fingerprints(docs), ["text", "sketch"])
    n_chars = F.char_length("text")
    third = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - third), F.substring(F.col("next.text"), F.lit(1), third))
    docs = docs.select("id", "sketch", F.col("next.sketch").alias("next_sketch"), n_chars.cast("long").alias("n_chars"), edited.alias("edited"))
    docs = fingerprints(docs, "edited", name="edited_sketch")
    return docs.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def _labelled(spark, folder, label, rows):
    """Documents with a label that may be learned from."""
    from .toxicity import labelled_sample
    return labelled_sample(_table(spark, folder, "documents"), _table(spark, folder, "labels"), label, rows=rows)


def _scored(docs, name, least):
    from .toxicity import held_out
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"),
        (F.col(name) >= least).cast("int").alias("predicted"))


@_query("op8_toxicity")
def op8(spark, folder):
    from .toxicity import SAMPLE_ROWS, learn_lexicon, score_toxicity
    lexicon = learn_lexicon(_labelled(spark, folder, "toxic", SAMPLE_ROWS))
    return _scored(score_toxicity(_table(spark, folder, "documents").select("doc_id", "text"), lexicon), "toxicity", 0.7)


@_query("op9_quality_classifier")
def op9(spark, folder):
    from .quality import SAMPLE_ROWS, learn_quality, score_quality
    model = learn_quality(_labelled(spark, folder, "quality", SAMPLE_ROWS))
    return _scored(score_quality(_table(spark, folder, "documents").select("doc_id", "text"), model), "quality", 0.5)


@_query("op10_suffix_array_dedup", oracles.REPEATS)
def op10(spark, folder):
    from .substrings import remove_repeats
    found = remove_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@_query("op7_lm_scoring")
def op7(spark, folder):
    from .ngrams import score_texts
    from .toxicity import held_out
    kept_back = held_out(F.col("doc_id"), 5)
    found = score_texts(_table(spark, folder, "documents"), ~kept_back)
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), 5).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


@_query("op6_line_dedup")
def op6(spark, folder):
    from .lines import deduplicate_lines
    found = deduplicate_lines(_table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", "n_kept", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"))


@_query("op13_periodic_run_detection", oracles.RUNS)
def op13(spark, folder):
    from .runs import longest_run, periodic_runs
    found = periodic_runs(_table(spark, folder, "documents"), alter=True, collapsed_text=False)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = longest_run(F.col("runs"))
    return found.select("id", "n_words", "runs", "collapsed_sha256", lines.alias("lines"), best.alias("best")).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


@_query("op11_quality_rules")
def op11(spark, folder):
    from .qualityrules import bucket_weights, quality_rules
    docs = _table(spark, folder, "documents")
    weights = bucket_weights(docs, _table(spark, folder, "labels").where("quality = 1"))
    return quality_rules(docs, weights).select(F.col("id").alias("doc_id"), *[
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"])


@_query("op12_cross_tokenizer_alignment")
def op12(spark, folder):
    import public_tokenizers

    from .alignment import token_links
    found = token_links(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=False)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
