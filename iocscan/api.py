"""The scan: artifacts and indicator lists in, findings and errors out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from iocscan.functions.content import file_type
from iocscan.functions.names import WELL_KNOWN_NAMES, basename
from iocscan.functions.patterns import checked_name_patterns
from iocscan.operators import content as rules_on
from iocscan.operators import digests, names, units as scan_units
from iocscan.operators.detectors import Detector
from iocscan.operators.expand import expand, whole_units
from iocscan.operators.findings import COLUMNS, exploded, finding, positions_where
from iocscan.operators.leaves import DEPTH
from iocscan.operators.rules import RuleSet
from iocscan.schemas import FINDING, HASH, SCAN_ERROR, YARA
from iocscan.session import prepare
from iocscan.sources.files import CHUNK_BYTES, OVERLAP_BYTES, digest_files, list_files, read_files, task_count, with_file_types
from iocscan.sources.iocs import filename_patterns as pattern_list, hash_iocs, hash_list, known_names as name_table, pattern_table
from iocscan.sources.rulefiles import load_rules

_ERROR = SCAN_ERROR.fieldNames()


@dataclass
class ScanResult:
    """``findings`` (``schemas.FINDING``) and ``errors`` (``schemas.SCAN_ERROR``), both lazy.

    The listing of a file tree, and what one reading gives for both, are kept until ``release`` is called.
    """

    findings: DataFrame
    errors: DataFrame
    kept: Sequence[DataFrame] = ()

    def release(self) -> None:
        for frame in self.kept:
            frame.unpersist()


def _union(parts: list[DataFrame], spark: SparkSession, schema) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _errors(rows: DataFrame, path: str, scanner: str, stage: str, message: str) -> DataFrame:
    return rows.where(F.col(message).isNotNull()).select(
        F.col(path).alias("path"), F.lit(scanner).alias("scanner"), F.lit(stage).alias("stage"),
        F.col(message).alias("message"),
    ).select(*_ERROR)


def one_pass(
    artifacts: DataFrame,
    rules: RuleSet | None = None,
    patterns: Sequence[tuple[str, str]] = (),
    watched: Sequence[str] = (),
    hashes: digests.HashList | None = None,
    rule_route: Column | None = None,
    with_errors: bool = False,
) -> DataFrame:
    """Findings of all row-local detectors in a single scan of the artifacts.

    Content rules, name detectors and digests are evaluated side by side on each
    row, so the content is read once however many detectors are on. ``hashes`` must
    be small enough to broadcast. ``rule_route`` restricts the content rules to
    the artifacts that are scanned as they are. ``with_errors``: artifacts have an ``error``; where it is set there is one row with it in
    ``message`` and nothing else, and findings have no message.
    """
    # Every possible finding has a number: rules, then names, then digests. The
    # pass over the content yields the numbers that apply to a row.
    scanners, labels = ([YARA] * len(rules.rules), [r.rule_id for r in rules.rules]) if rules else ([], [])
    tests = []
    for scanner, label, test in names.name_tests(patterns, watched):
        tests.append((len(labels), test))
        scanners.append(scanner)
        labels.append(label)
    algorithms = hashes.algorithms if hashes is not None else []
    first_digest = len(labels)
    scanners += [HASH] * len(algorithms)
    numbers = F.concat(
        positions_where(tests), F.array(*[F.lit(first_digest + i) for i in range(len(algorithms))]).cast("array<int>")
    )
    shown = F.array(*digests.shown_digests(algorithms, F.col("content"))).cast("array<string>")
    message = F.col("error") if with_errors else F.lit(None).cast("string")
    if rules is None:
        rows = artifacts.select("path", "basename", shown.alias("_digests"), numbers.alias("_numbers"), message.alias("message"))
    else:
        scanned = scan_units.with_externals(artifacts)
        raw = F.lit(True) if rule_route is None else rule_route
        # content that is scanned in another way is not searched here
        searched = F.col("content") if rule_route is None else F.when(raw, F.col("content"))
        units = scanned.select(
            *[c for c in scanned.columns if c != "content"], searched.alias("content"),
            shown.alias("_digests"), numbers.alias("_others"), raw.alias("_raw"), message.alias("message"),
        )
        hits = rules_on.unit_hits(
            units, rules, keep=["path", "basename", "_digests", "_others", "_raw", "message"], arrow=False
        )
        by_rules = F.when(F.col("_raw"), F.col("rules")).otherwise(F.array().cast("array<int>"))
        rows = hits.select("path", "basename", "_digests", F.concat(by_rules, "_others").alias("_numbers"), "message")
    number = F.greatest("_number", F.lit(0))
    is_digest = number >= first_digest
    numbers = F.when(F.col("message").isNull(), F.col("_numbers")).otherwise(F.array(F.lit(-1))) if with_errors else F.col("_numbers")
    findings = exploded(rows, numbers, "_number", "path", "basename", "_digests", "message").select(
        finding(
            F.lit(scanners)[number],
            F.when(is_digest, F.col("_digests")[number - first_digest]).otherwise(F.lit(labels or [""])[number]),
            F.col("path"), F.when(is_digest, F.col("basename")).otherwise(F.col("path")),
        ).alias("f"), *(["message"] if with_errors else [])
    ).select("f.*", *(["message"] if with_errors else []))
    if hashes is None:
        return findings
    # digests stay only if they are in the list
    listed = hashes.table.select(F.concat_ws(":", "algo", "digest").alias("_digest"), F.lit(True).alias("_listed"))
    stays = (F.col("scanner") != HASH) | F.col("_listed")
    return (
        findings.withColumn("_digest", F.when(F.col("scanner") == HASH, F.col("rule_name")))
        .join(F.broadcast(listed), "_digest", "left")
        .where(stays | F.col("message").isNotNull() if with_errors else stays)
        .select(*COLUMNS, *(["message"] if with_errors else []))
    )


def scan(
    artifacts: DataFrame | str,
    *,
    rules: RuleSet | str | None = None,
    filename_patterns: Iterable[str] | DataFrame = (),
    known_names: bool | Iterable[str] | DataFrame = False,
    hashes: Iterable[str] | DataFrame = (),
    exclude: str | None = None,
    expand_archives: bool = False,
    max_unit_bytes: int | None = None,
    records: DataFrame | None = None,
    registry_values: DataFrame | None = None,
    json_depth: int = DEPTH,
    details: bool = False,
    rule_timeout_s: float | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    rule_shard_strings: int | None = None,
    detectors: Sequence[Detector] = (),
) -> ScanResult:
    """Match artifacts against indicators.

    ``artifacts`` is a table with ``path`` and ``content`` (and, if known,
    ``owner``), or the root of a file tree. ``rules`` is a rule set or the path of
    rule files. ``records`` and ``registry_values`` are further sources for the
    rules; event logs and hives among the artifacts are then not scanned as raw
    bytes if their rows are there. With ``details`` every finding of a rule lists
    the matches of its strings. Rule sets of more than ``rule_shard_strings`` strings (``rules.MAX_RULE_STRINGS``) are searched in
    several passes of so many each, with the same findings.

    Nothing is left out unless a limit is given: ``max_unit_bytes`` ends decoded content there, and
    ``rule_timeout_s`` gives up the search of a unit, which is then reported and has no findings of rules.
    """
    spark = artifacts.sparkSession if isinstance(artifacts, DataFrame) else SparkSession.active()
    prepare(spark)
    found: list[DataFrame] = []
    errors: list[DataFrame] = []

    if isinstance(rules, str):
        rules, rejected = load_rules(spark, rules)
        errors.append(_errors(rejected, "rule_file", YARA, "rules", "message"))
    if rules is not None and not rules.rules:
        rules = None
    many_patterns = None
    if not isinstance(filename_patterns, DataFrame):
        filename_patterns = list(filename_patterns)
    if isinstance(filename_patterns, DataFrame) or len(filename_patterns) > names.INLINE_PATTERNS:
        many_patterns, filename_patterns = pattern_table(spark, filename_patterns), ()
    patterns = pattern_list(spark, filename_patterns)
    excluded = None if exclude is None else checked_name_patterns(spark, [exclude])[0]
    watched: Sequence[str] = ()
    watch_table = None
    if isinstance(known_names, DataFrame):
        watched = names.known_name_list(spark, known_names)
        watch_table = known_names if watched is None else None
        watched = watched or ()
    elif known_names:
        given = WELL_KNOWN_NAMES if known_names is True else list(known_names)
        watched, watch_table = (given, None) if len(given) <= names.INLINE_NAMES else ((), name_table(spark, given))
    iocs: DataFrame | None = None
    if isinstance(hashes, DataFrame):
        iocs = hashes if {"algo", "digest"} <= set(hashes.columns) else hash_iocs(hashes)
    elif hashes := list(hashes):
        iocs = hash_list(spark, hashes)
    listed = None if iocs is None else digests.HashList.of(iocs)
    small_iocs = listed if listed is not None and listed.small else None

    kept: list[DataFrame] = []
    tasks = None

    def read_ok(files: DataFrame) -> DataFrame:
        return read_files(files, chunk_bytes, tasks=tasks).where(F.col("error").isNull()).drop("error")

    def take(outcomes: DataFrame, scanner: str, stage: str, path: str = "artifact_path") -> None:
        """Findings and errors of one evaluation."""
        outcomes = outcomes.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(outcomes)
        found.append(outcomes.where(F.col("message").isNull()).select(*COLUMNS))
        errors.append(_errors(outcomes, path, scanner, stage, "message"))

    listing = None
    if isinstance(artifacts, str):
        listing = names.exclude_names(list_files(spark, artifacts), excluded)
        if rules is not None:
            listing = with_file_types(listing)
        # walked once; a lost block is walked again
        listing = listing.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(listing)
        tasks = task_count(listing)
        errors.append(_errors(listing, "path", "", "walk", "error"))
        # a name is tested whether or not its file can be read
        name_rows = listing = listing.where(F.col("error").isNull())
        if rules is not None:
            errors.append(_errors(listing, "path", "", "read", "head_error"))
            listing = listing.where(F.col("head_error").isNull()).drop("head_error")
        large = listing.where(F.col("length") > chunk_bytes)
        table = read_ok(listing)
    else:
        table = artifacts if "basename" in artifacts.columns else artifacts.select(
            "*", basename(F.col("path")).alias("basename")
        )
        table = names.exclude_names(table, excluded)
        if rules is not None and "filetype" not in table.columns:
            table = table.select("*", file_type(F.col("content")).alias("filetype"))
        name_rows = table

    plain = scan_units.is_plain(expand_archives, records is not None, registry_values is not None)
    uncovered = None
    if rules is not None and registry_values is not None:
        # hives without values of their own are scanned as raw bytes
        hives, few = scan_units.covered_hives(registry_values)
        is_rest = (F.col("filetype") == "reg") & F.col("_covered").isNull()
        if listing is not None:
            listing = listing.join(F.broadcast(hives) if few else hives, "path", "left")
            large, table = listing.where(F.col("length") > chunk_bytes), read_ok(listing)
            plain = plain | is_rest
        elif few:
            table = table.join(F.broadcast(hives), "path", "left")
            plain = plain | is_rest
        else:
            # all hives are scanned, and the findings of the covered ones dropped: content never moves
            uncovered = hives
    native = rules is not None and not rules_on.uses_arrow(rules) and not details and rule_timeout_s is None
    by_content = native or small_iocs is not None
    if listing is not None:
        if by_content:
            tagged = read_files(listing, chunk_bytes, tasks=tasks)
            take(one_pass(tagged, rules if native else None, (), (), small_iocs, plain if native else None, with_errors=True), "", "read")
        elif rules is not None or listed is not None or detectors:
            errors.append(_errors(read_files(listing, chunk_bytes, tasks=tasks), "path", "", "read", "error"))
        if patterns or watched:
            found.append(one_pass(name_rows, None, patterns, watched))
    elif patterns or watched or by_content:
        found.append(one_pass(
            table, rules if native else None, patterns, watched, small_iocs, plain if native else None))
    if many_patterns is not None:
        found.append(names.pattern_findings(name_rows, many_patterns))
    if watch_table is not None:
        found.append(names.near_misses(name_rows, watch_table))
    if listed is not None and not listed.small:
        found.append(digests.hash_findings(table, listed))
    if listed is not None and listing is not None:
        streamed = digest_files(large, listed.algorithms, tasks)
        errors.append(_errors(streamed, "path", HASH, "read", "error"))
        found.append(digests.hash_findings(streamed.where(F.col("error").isNull()), listed))

    if rules is not None:
        sources = [] if native else [table.where(plain)]
        pieces_of = None if listing is None else large.where(plain)
        sources = [scan_units.raw_units(scan_units.with_externals(t)) for t in sources]
        pieces = []
        # matches without a bound may be as long as a large piece
        overlap = rules.overlap(OVERLAP_BYTES, max(chunk_bytes, CHUNK_BYTES))
        if expand_archives:
            packed = (table if listing is None else listing).where(F.col("filetype").isin(*scan_units.PACKED))
            expanded = expand(scan_units.with_externals(packed), max_unit_bytes, chunk_bytes, overlap)
            cut = F.when(F.col("truncated"), "not decoded beyond the limit that was given")
            flawed = expanded.select("found_in_file", F.coalesce("error", cut).alias("error")).distinct()
            errors.append(_errors(flawed, "found_in_file", YARA, "expand", "error"))
            expanded = expanded.where(F.col("error").isNull()).drop("error")
            sources.append(whole_units(expanded))
            pieces.append(expanded.where(F.col("chunk_start").isNotNull()))
        if records is not None:
            leaf_units, unread = scan_units.record_units(records, json_depth, rules)
            errors.append(_errors(unread, "file", YARA, "records", "message"))
            sources.append(leaf_units)
        if registry_values is not None:
            sources.append(scan_units.registry_units(registry_values))
        if pieces_of is not None:
            read = read_files(pieces_of, chunk_bytes, overlap, chunked=True, tasks=tasks)
            errors.append(_errors(read, "path", YARA, "read", "error"))
            pieces.append(scan_units.chunk_units(read.where(F.col("error").isNull())))
        tagged = rule_timeout_s is not None and not details
        search = rules_on.rule_findings_with_matches if details else rules_on.rule_findings
        shards = rules.shards(rule_shard_strings)
        for source in sources:
            for shard in shards:
                if tagged:
                    take(rules_on.rule_outcomes(source, shard, rule_timeout_s), YARA, "match", "found_in_file")
                else:
                    found.append(search(source, shard, rule_timeout_s))
        if uncovered is not None:
            rest = scan_units.raw_units(scan_units.with_externals(table.where(F.col("filetype") == "reg")))
            for shard in shards:
                found.append(search(rest, shard, rule_timeout_s).join(
                    uncovered.select(F.col("path").alias("artifact_path")), "artifact_path", "left_anti").select(*COLUMNS))
            if details:
                sources.append(rest)
        search = rules_on.chunked_findings_with_matches if details else rules_on.rule_findings
        for piece in pieces:
            for shard in shards:
                if tagged:
                    take(rules_on.rule_outcomes(piece, shard, rule_timeout_s), YARA, "match", "found_in_file")
                else:
                    found.append(search(piece, shard, rule_timeout_s))
        if rule_timeout_s is not None:
            # matches are collected from content, which is not kept: with details late units are found in a search of their own
            for source in [*sources, *pieces] if details else [rest] if uncovered is not None else []:
                late = rules_on.unit_hits(source, rules, keep=["found_in_file"], deadline_s=rule_timeout_s)
                errors.append(_errors(late, "found_in_file", YARA, "match", "error"))
    for detector in detectors:
        found.append(detector.detect(table).select(*COLUMNS))
        if listing is None:
            continue
        name = getattr(detector, "name", type(detector).__name__)
        if hasattr(detector, "detect_pieces"):
            read = read_files(large, chunk_bytes, detector.overlap_bytes, chunked=True, tasks=tasks)
            errors.append(_errors(read, "path", name, "read", "error"))
            found.append(detector.detect_pieces(read.where(F.col("error").isNull())).select(*COLUMNS))
        else:
            unseen = F.lit(f"larger than {chunk_bytes} bytes, and the detector takes whole files")
            errors.append(_errors(large.select("path", unseen.alias("message")), "path", name, "detect", "message"))
    return ScanResult(_union(found, spark, FINDING), _union(errors, spark, SCAN_ERROR), kept)
