import bz2
import gzip
import io
import lzma
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from iocscan.api import scan
from iocscan.operators import units
from iocscan.operators.content import chunked_findings_with_matches, rule_findings, rule_findings_with_matches, string_matches
from iocscan.operators.expand import expand
from iocscan.operators.leaves import string_leaves
from iocscan.operators.rules import RuleError, RuleSet
from iocscan.operators.units import artifacts_from, chunk_units, raw_units, record_units, registry_units, with_externals
from iocscan.sources import files as files_module
from iocscan.sources.files import digest_files, list_files, read_files
from iocscan.sources.rulefiles import load_rules, parse_rules

WORLD = 'rule world {\n  strings:\n    $world = "world"\n    $lorem = "ipsum"\n  condition:\n    any of them\n}\n'


def test_no_file_is_lost(spark, odd_files):
    for partitions in (1, 100):
        rows = list_files(spark, str(odd_files), partitions).collect()
        assert {r.basename for r in rows} == {"empty", ".bashrc", "_tmp", "with space.tar.gz", "deep.bin"}
        assert len(rows) == 5 and all(r.error is None and r.owner for r in rows)
    content = {r.basename: bytes(r.content) for r in read_files(list_files(spark, str(odd_files))).collect()}
    assert content == {"empty": b"", ".bashrc": b"x", "_tmp": b"y", "with space.tar.gz": b"z", "deep.bin": b"\xff\x00\xfe"}


def test_single_file_and_missing_root(spark, odd_files):
    assert [r.basename for r in list_files(spark, str(odd_files / "_tmp")).collect()] == ["_tmp"]
    missing = list_files(spark, str(odd_files / "nothing")).collect()
    assert len(missing) == 1 and missing[0].error


def test_names_that_are_not_utf8_are_reported(spark, tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"bad\xff"), "wb") as f:
        f.write(b"x")
    rows = scan(str(tmp_path), filename_patterns=["x"]).errors.collect()
    assert [r.stage for r in rows] == ["walk"]


def test_unreadable_files_are_reported(spark, tmp_path):
    (tmp_path / "gone").write_bytes(b"x")
    listing = list_files(spark, str(tmp_path)).collect()
    frame = spark.createDataFrame(listing, list_files(spark, str(tmp_path)).schema)
    (tmp_path / "gone").unlink()
    assert read_files(frame).first().error and digest_files(frame, ["MD5"]).first().error


def names(found):
    return {r.found_in_file for r in found.findings.collect()}


def test_filename_patterns_on_files(spark, evidence):
    at = lambda *n: {f"{evidence}/{x}" for x in n}
    assert names(scan(evidence, filename_patterns=["^sample2.txt$"])) == at("sample2.txt")
    assert names(scan(evidence, filename_patterns=["sample1"])) == at(
        "sample1.txt", "sample1.txt.gz", "sample1.txt.xz", "sample1.txt.bz2"
    )
    assert names(scan(evidence, filename_patterns=[r"\.txt$"])) == at("sample1.txt", "sample2.txt")


@pytest.mark.parametrize("details", [False, True])
def test_rules_on_files(spark, evidence, tmp_path, details):
    (tmp_path / "sample1.yar").write_text(WORLD)
    rules = str(tmp_path / "sample1.yar")
    raw = names(scan(evidence, rules=rules, details=details))
    assert raw >= {f"{evidence}/{x}" for x in ("sample.zip", "sample1.txt", "sample1.txt.xz")}
    opened = scan(evidence, rules=rules, expand_archives=True, details=details)
    assert names(opened) == {
        f"{evidence}/{x}" for x in ("sample.zip:sample1.txt", "sample1.txt", "sample1.txt.bz2", "sample1.txt.gz", "sample1.txt.xz")
    }
    inner = [r for r in opened.findings.collect() if ":" in r.found_in_file]
    assert [r.contained_file for r in inner] == ["sample1.txt"]
    assert opened.errors.count() == 0


def test_chunks_give_the_same_as_whole_files(spark, tmp_path):
    rng = random.Random(3)
    for i in range(4):
        (tmp_path / f"f{i}").write_bytes(bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 400))))
    rules = RuleSet.define(
        ("any", {"$a": "abc", "$b": "/a[bc]{2,4}a/", "$c": "zzz"}, "any of them"),
        ("count", {"$a": "ab"}, "#a > 10"), ("second", {"$a": "ca"}, "@a[2] > 20 and $a in (30..60)"),
        ("none", {"$a": "zz"}, "not $a"), ("at", {"$a": "/[ab]/"}, "$a at 64"),
    )
    listing = list_files(spark, str(tmp_path))
    whole = raw_units(with_externals(read_files(listing)))
    key = ["rule_name", "found_in_file", "string_id", "offset", F.hex("data")]
    expected = {tuple(r) for r in string_matches(rule_findings_with_matches(whole, rules)).select(*key).collect()}
    verdicts = {(r.rule_name, r.found_in_file) for r in rule_findings(whole, rules).collect()}
    for size in (7, 64, 1000):
        pieces = chunk_units(read_files(listing, size, overlap_bytes=6, chunked=True))
        found = chunked_findings_with_matches(pieces, rules)
        rows = [tuple(r) for r in string_matches(found).select(*key).collect()]
        assert set(rows) == expected and len(rows) == len(expected)
        first = [(r.rule_name, r.found_in_file) for r in found.where("part < 2").collect()]
        assert sorted(first) == sorted(verdicts)
        assert {(r.rule_name, r.found_in_file) for r in rule_findings(pieces, rules).collect()} == verdicts
    matched = {(file, string) for rule, file, string, *_ in expected if rule == "any"}
    for r in chunked_findings_with_matches(pieces, rules).where("part = 1 and rule_name = 'any'").collect():
        assert [s.identifier for s in r.strings] == [
            x for x in ("$a", "$b", "$c") if (r.found_in_file, x) not in matched
        ]


def test_scan_with_large_files(spark, evidence):
    rules = RuleSet.define(("world", {"$a": "world", "$b": "ipsum"}, "any of them"))
    for details in (False, True):
        found = scan(evidence, rules=rules, details=details, chunk_bytes=11)
        assert f"{evidence}/sample1.txt" in names(found)


def packed_files(spark, *files):
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    return with_externals(artifacts_from(table, F.col("path"), F.col("content")))


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def test_expansion_edge_cases(spark):
    broken = bytearray(zipped(good=b"fine", bad=b"spoilt-data"))
    at = broken.index(b"spoilt-data")
    broken[at] ^= 0xFF
    rows = expand(packed_files(
        spark,
        ("/two.gz", gzip.compress(b"first") + gzip.compress(b"second")),
        ("/cut.gz", gzip.compress(b"some data")[:-6]),
        ("/empty.bz2", bz2.compress(b"")),
        ("/nested.zip", zipped(**{"in.zip": zipped(x=b"deep")})),
        ("/broken.zip", bytes(broken)),
        ("/no.zip", b"PK\x03\x04nothing"),
    )).collect()
    seen = {r.found_in_file: (None if r.content is None else bytes(r.content), r.error is not None) for r in rows if r.found_in_file != "/cut.gz"}
    assert seen["/two.gz"] == (b"firstsecond", False)
    # what was decoded before the data broke off is searched as well
    assert {(bytes(r.content or b""), r.error is not None) for r in rows if r.found_in_file == "/cut.gz"} == {(b"some data", False), (b"", True)}
    assert seen["/no.zip"] == (None, True)
    assert seen["/empty.bz2"] == (b"", False)
    assert seen["/nested.zip:in.zip"][0].startswith(b"PK")
    assert seen["/broken.zip:good"] == (b"fine", False) and seen["/broken.zip:bad"] == (None, True)
    assert len(seen) == 6


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_all_streams_and_large_units(spark, pack):
    """Concatenated streams with padding, decoded in pieces: a match over a stream's end and negations are found once."""
    first, second = b"a" * 4000 + b"ev", b"il" + b"b" * 4000
    kind = {gzip.compress: "gz", bz2.compress: "bz2", lzma.compress: "xz"}[pack]
    files = spark.createDataFrame([(f"/x.{kind}", pack(first) + pack(second) + b"\0" * 16)], "path string, content binary")
    rules = RuleSet.define(
        ("evil", {"$a": "evil"}, "#a == 1 and @a == 4000"), ("end", {"$a": "/b$/"}, "#a == 1"), ("none", {"$a": "evil"}, "not $a"),
        ("size", {"$a": "evil"}, "filesize == 8004"))
    for chunk in (500, 1 << 20):
        found = scan(files, rules=rules, expand_archives=True, chunk_bytes=chunk)
        assert sorted(r.rule_name for r in found.findings.collect()) == ["end", "evil", "size"]
        assert found.errors.count() == 0


def test_pieces_see_long_matches_and_the_true_end(spark, tmp_path):
    (tmp_path / "long").write_bytes(b"x" * 3000 + b"evilbbb" + b"y" * 200_000 + b"Z" + b"w" * 3000)
    (tmp_path / "end").write_bytes(b"x" * 1500 + b"evilbbb")
    rules = RuleSet.define(("end", {"$a": "/evilb+$/"}, "$a"), ("far", {"$a": "/evilb+y{200000}Z/"}, "$a"))
    results = [
        sorted((r.rule_name, os.path.basename(r.found_in_file)) for r in scan(str(tmp_path), rules=rules, chunk_bytes=size).findings.collect())
        for size in (1000, 1503, 1 << 26)]
    assert results == [[("end", "end"), ("far", "long")]] * 3


def test_names_of_files_that_cannot_be_read(spark, tmp_path, monkeypatch):
    """A finding of a name does not depend on the content, with any other detector on."""
    (tmp_path / "svchost.ex").write_bytes(b"x")
    (tmp_path / "plain").write_bytes(b"x")
    rules = RuleSet.define(("r", {"$a": "never"}, "$a"))
    listed = files_module.list_files
    gone = F.concat(F.col("path"), F.lit(".gone"))  # as if the file went away after it was listed
    monkeypatch.setattr("iocscan.api.list_files", lambda *a: listed(*a).withColumn("path", F.when(F.col("basename") == "svchost.ex", gone).otherwise(F.col("path"))))
    for options in ({}, {"rules": rules}, {"hashes": ["0" * 32]}, {"rules": rules, "hashes": ["0" * 32], "details": True}):
        found = scan(str(tmp_path), filename_patterns=["^svc"], known_names=True, **options)
        assert sorted(r.scanner for r in found.findings.collect()) == ["Filename", "Levenshtein"]
        if options:
            assert found.errors.count() >= 1


def test_a_covered_hive_is_left_out_without_moving_content(spark, monkeypatch):
    monkeypatch.setattr("iocscan.operators.units.BROADCAST_PATHS", 0)
    files = spark.createDataFrame([("/a", b"regf evil"), ("/b", b"regf evil"), ("/c", b"evil")], "path string, content binary")
    values = spark.createDataFrame([("/a", "/k", "v", "string", "fine", None, None)], "hive string, key_path string, value_name string, value_type string, s string, b binary, multi array<string>")
    found = scan(files, rules=RuleSet.define(("r", {"$a": "evil"}, "$a")), registry_values=values)
    assert sorted(r.found_in_file for r in found.findings.collect()) == ["/b", "/c"]
    plan = found.findings._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert "Exchange" not in line or "content" not in line


def test_conditions_are_not_run(spark):
    for condition in ("$a or #a > 9**9**9", "$a == == 1", "$a + ", "#a > 1 < 3", "(" * 300 + "$a" + ")" * 300):
        with pytest.raises(RuleError):
            RuleSet.define(("r", {"$a": "x"}, condition))


def test_large_archives_are_shared_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as archive:
        for i in range(600):
            archive.writestr(f"m{i}", f"member {i}")
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04nothing")
    rules = RuleSet.define(("r", {"$a": "member 5"}, "$a"))
    found = scan(str(tmp_path), rules=rules, expand_archives=True)
    hit = [r.contained_file for r in found.findings.collect()]
    assert sorted(hit) == sorted(f"m{i}" for i in range(600) if str(i).startswith("5"))
    assert [os.path.basename(r.path) for r in found.errors.collect()] == ["bad.zip"]


def test_budget(spark):
    rows = expand(packed_files(spark, ("/a.gz", gzip.compress(b"x" * 50_000))), max_unit_bytes=100).collect()
    assert bytes(rows[0].content) == b"x" * 100 and rows[0].truncated


def test_leaves(spark):
    texts = ['"bare"', "{}", "null", "7", '[[["deep"]]]', '{"key":{"x":[]}}', "{bad", '{"a":[[[["too deep"]]]]}', '{"a":"x","b":["x"]}']
    records = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, record_id long, data string")
    leaves, errors = string_leaves(records, 4)
    assert sorted((r.record_id, r.leaf) for r in leaves.collect()) == [(0, "bare"), (4, "deep"), (7, "too deep"), (8, "x"), (8, "x")]
    assert sorted(r.record_id for r in errors.collect()) == [6]


def test_strings_in_two_leaves_do_not_add_up(spark):
    records = spark.createDataFrame(
        [("f", 1, '{"a":"one","b":"two"}'), ("f", 2, '{"a":"one two"}'), ("f", 3, '{"one two":1}')],
        "file string, record_id long, data string",
    )
    rules = RuleSet.define(("both", {"$a": "one", "$b": "two"}, "all of them"))
    leaves, _ = record_units(records, 4, rules)
    assert [r.value_data for r in rule_findings(leaves, rules).collect()] == ['{"a":"one two"}']


def test_registry_units(spark):
    values = spark.createDataFrame([
        ("/h", "/k", "n", "string", "OneDrive.exe", None, None), ("/h", "/k", "b", "binary", None, bytearray(b"OneDrive.exe"), None),
        ("/h", "/k", "m", "multi", None, None, ["x", "OneDrive.exe"]), ("/h", "/OneDrive.exe", "d", "number", None, None, None),
    ], "hive string, key_path string, value_name string, value_type string, s string, b binary, multi array<string>")
    rules = RuleSet.define(("drive", {"$a": "OneDrive.exe"}, "any of them"))
    found = rule_findings(registry_units(values), rules).collect()
    assert sorted(r.value_data for r in found) == [
        "/k/@b = '<binary data>'", "/k/@m = 'OneDrive.exe'", "/k/@n = 'OneDrive.exe'",
    ]


def test_hives_without_values_are_scanned_raw(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame(
        [("/h1", bytearray(b"regf secret")), ("/h2", bytearray(b"regf secret"))], "path string, content binary"
    )
    values = spark.createDataFrame(
        [("/h1", "/k", "n", "string", "none", None, None)],
        "hive string, key_path string, value_name string, value_type string, s string, b binary, multi array<string>",
    )
    rules = RuleSet.define(("r", {"$a": "secret"}, "$a"))
    assert names(scan(table, rules=rules)) == {"/h1", "/h2"}
    for details in (False, True):
        for limit in (10, 0):
            monkeypatch.setattr(units, "BROADCAST_PATHS", limit)
            assert names(scan(table, rules=rules, registry_values=values, details=details)) == {"/h2"}
    for name in ("h1", "h2"):
        (tmp_path / name).write_bytes(b"regf secret")
    own = values.withColumn("hive", F.lit(f"{tmp_path}/h1"))
    for size in (4, 1000):
        found = scan(str(tmp_path), rules=rules, registry_values=own, chunk_bytes=size)
        assert names(found) == {f"{tmp_path}/h2"}
        found.release()


def test_rule_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.YAR").write_text(WORLD)
    (tmp_path / "b.yara").write_text('rule b { strings: $a = "}" // }\n condition: /* { */ $a }')
    (tmp_path / "bad.yar").write_text('import "pe"\nrule c { condition: pe.x }')
    (tmp_path / "latin.yar").write_bytes(b'rule d { strings: $a = "\xff" condition: $a }')
    (tmp_path / "no.txt").write_text(WORLD)
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as archive:
        archive.writestr("x/w.yar", WORLD.replace("world {", "packed {"))
        archive.writestr("x/readme", "no rule")
    rules, rejected = load_rules(spark, str(tmp_path))
    assert sorted(r.rule_id for r in rules.rules) == ["b", "world"]
    assert sorted(os.path.basename(r.rule_file) for r in rejected.collect()) == ["bad.yar", "latin.yar"]
    rules, rejected = load_rules(spark, str(tmp_path / "pack.zip"))
    assert [r.rule_id for r in rules.rules] == ["packed"] and rejected.count() == 0
    rules, rejected = load_rules(spark, str(tmp_path / "no.txt"))
    assert rules.rules == [] and rejected.count() == 1
    (tmp_path / "again.yar").write_text(WORLD)
    with pytest.raises(ValueError, match="duplicate"):
        load_rules(spark, str(tmp_path))


def test_rule_text():
    rules, strings = parse_rules('''
        private rule a : tag1 tag2 {
            meta: author = "x { y"
            strings:
                $ = "plain \\x41\\n" nocase wide
                $ = { 4D 5A ?? [2-4] (90 | 91) }
                $re = /ab\\/c[0-9]+/i fullword
            condition: any of them and filesize < 2MB }
        rule b { condition: a and filename matches /x\\/y$/ }
    ''', "f")
    assert [(r.rule_id, r.private, r.rule_file) for r in rules] == [("a", True, "f"), ("b", False, "f")]
    assert [(s.string_id, s.kind, s.nocase, s.wide, s.fullword) for s in strings] == [
        ("$", "text", True, True, False), ("$", "hex", False, False, False), ("$re", "regex", False, False, True),
    ]
