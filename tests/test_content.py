import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from iocscan.api import scan
from iocscan.operators.content import (
    may_match, rule_findings, rule_findings_with_matches, string_matches, unit_hits,
)
from iocscan.operators.rules import RuleError, RuleSet
from iocscan.operators.units import artifacts_from, raw_units, with_externals

STRINGS = {
    "$l1": "ab", "$l2": "aa", "$l3": "a", "$l4": "é", "$x": "/a[b ]+/", "$h": "{ C3 A9 ?? }", "$h2": "{ FF [0-2] 00 }",
    "$h3": "{ 61 ( 62 | 20 58 ) }", "$r": r"/\xff$/", "$r2": "/^a./s", "$w": r"/\ba/", "$i": "/AB/i", "$g": "/(ab|a)+b/",
}
FORMS = ("${}", "#{} > 1", "@{} < 5", "@{}[2] > 6", "${} at 2", "${} in (1..4)", "${} in (3..filesize)", "not ${}")


def units(spark, contents, name="/d/{}"):
    rows = [(name.format(i), bytearray(c)) for i, c in enumerate(contents)]
    table = spark.createDataFrame(rows, "path string, content binary")
    return raw_units(with_externals(artifacts_from(table, F.col("path"), F.col("content"))))


def hits(frame):
    rows = [(r.rule_name, r.found_in_file) for r in frame.select("rule_name", "found_in_file").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_both_strategies_equal_brute_force(spark):
    rng = random.Random(7)
    alphabet = [b"a", b"b", b"\xff", b"\x00", "é".encode(), b" ", b"X", b"AB"]
    contents = [b"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(250)] + [b"aaa", b""]
    rules = RuleSet.define(*[
        (f"{n[1:]}_{j}", {n: v}, form.format(n[1:])) for n, v in STRINGS.items() for j, form in enumerate(FORMS)
    ])
    first = {r.rule_id.rsplit("_", 1)[0]: r.strings[0] for r in rules.rules}
    expected = set()
    for i, data in enumerate(contents):
        for name, s in first.items():
            body = b"|".join(map(re.escape, s.literals)) if s.literals else s.python.encode("latin-1")
            at = [m.start() for m in re.finditer(b"(?=(" + body + b"))", data)]
            values = (
                bool(at), len(at) > 1, bool(at) and at[0] < 5, len(at) > 1 and at[1] > 6, 2 in at,
                any(1 <= x <= 4 for x in at), any(x >= 3 for x in at), not at,
            )
            expected |= {(f"{name}_{j}", f"/d/{i}") for j, ok in enumerate(values) if ok}
    frame = units(spark, contents)
    assert hits(rule_findings(frame, rules, arrow=False)) == expected
    assert hits(rule_findings(frame, rules, arrow=True)) == expected
    assert hits(rule_findings_with_matches(frame, rules)) == expected


def matches(frame):
    return sorted((r.found_in_file, r.string_id, r.offset, bytes(r.data)) for r in string_matches(frame).collect())


def test_offsets_are_bytes_and_overlap(spark):
    rules = RuleSet.define(("r", {"$a": "aa", "$b": "é", "$c": "/[x]+/"}, "any of them"))
    frame = units(spark, [b"aaa", "éaé".encode(), b"\xff\x00xx", b"none"])
    assert matches(rule_findings_with_matches(frame, rules)) == [
        ("/d/0", "$a", 0, b"aa"), ("/d/0", "$a", 1, b"aa"),
        ("/d/1", "$b", 0, b"\xc3\xa9"), ("/d/1", "$b", 3, b"\xc3\xa9"),
        ("/d/2", "$c", 2, b"xx"), ("/d/2", "$c", 3, b"x"),
    ]


def test_strings_without_a_match_are_kept(spark):
    rules = RuleSet.define(("r", {"$a": "x", "$b": "y"}, "any of them"))
    row = rule_findings_with_matches(units(spark, [b"x"]), rules).first()
    assert [(s.identifier, len(s.matches)) for s in row.strings] == [("$a", 1), ("$b", 0)]


def rows_of(spark, rule_text):
    from iocscan.sources.rulefiles import parse_rules
    return RuleSet.from_rows(*parse_rules(rule_text))


@pytest.mark.parametrize("options, content, hit", [
    ("nocase", b"xHELLOx", True), ("", b"xHELLOx", False), ("fullword", b"a hello.", True), ("fullword", b"ahello.", False),
    ("fullword", b"hello", True), ("wide", b"h\0e\0l\0l\0o\0", True), ("wide", b"hello", False), ("wide ascii", b"hello", True),
    ("wide nocase", b"H\0E\0L\0L\0O\0", True), ("nocase fullword", b"1HELLO", False), ("wide fullword", b"x\0h\0e\0l\0l\0o\0", False),
])
def test_string_options(spark, options, content, hit):
    rules = rows_of(spark, f'rule r {{ strings: $a = "hello" {options} condition: $a }}')
    frame = units(spark, [content])
    for arrow in (False, True):
        assert (hits(rule_findings(frame, rules, arrow=arrow)) != set()) is hit


@pytest.mark.parametrize("condition, expected", [
    ('filename == "0.exe"', {0}), ('extension == "exe"', {0, 1, 2}), ('filename matches /^[01]/', {0, 1}),
    ('filepath contains "/d/"', {0, 1, 2}), ('filename iequals "1.EXE" and $a', {1}), ('filetype == "zip"', set()),
    ('md5 == "-" and owner == "-"', {0, 1, 2}), ("filesize == 1", {0}), ("filesize > 1 and (filesize < 1KB or false)", {1, 2}),
    ("0x1 < #a", {2}), ("2 of them", {1, 2}), ("all of ($a*)", {0, 1, 2}), ("none of ($b)", {0}), ("#a - 1 > 0", {2}),
    ("@b[1] < 9 and not $b at 9", {1, 2}), ("not (@b[5] < 3)", set()),
])
def test_conditions(spark, condition, expected):
    rules = RuleSet.define(("r", {"$a": "x", "$b": "y"}, condition))
    frame = units(spark, [b"x", b"xy", b"xyx"], "/d/{}.exe")
    for arrow in (False, True):
        assert hits(rule_findings(frame, rules, arrow=arrow)) == {("r", f"/d/{i}.exe") for i in expected}


def test_names_of_atoms_in_quoted_text_stay(spark):
    rules = RuleSet.define(("r", {"$a": "x"}, '$a and filename == "p_0"'))
    frame = units(spark, [b"x"], "/d/p_{}")
    assert hits(rule_findings(frame, rules, arrow=True)) == {("r", "/d/p_0")}


def test_earlier_and_private_rules(spark):
    rules = rows_of(spark, """
        private rule first { strings: $a = "x" condition: $a }
        rule second { strings: $a = "y" condition: first and $a }
    """)
    for arrow in (False, True):
        assert hits(rule_findings(units(spark, [b"x", b"xy", b"y"]), rules, arrow=arrow)) == {("second", "/d/1")}


@pytest.mark.parametrize("condition", ["uint16(0) == 1", "$b", "any of", "$a and and $a", "pe.entry", "for any i in (1) : ($a)"])
def test_unsupported_conditions(condition):
    with pytest.raises(RuleError):
        RuleSet.define(("r", {"$a": "x"}, condition))


def test_duplicate_rules_fail():
    with pytest.raises(ValueError, match="duplicate"):
        RuleSet.define(("r", {"$a": "x"}, "$a"), ("r", {"$a": "y"}, "$a"))


@pytest.mark.parametrize("condition, needs", [
    ("$a", True), ("any of them", True), ("not $a", False), ("$a and filesize < 10", True), ("$a or filesize < 10", False),
    ("#a > 0", True), ("#a >= 0", False), ('$a and filename == "x"', True), ('filename == "x"', False), ("none of them", False),
])
def test_rules_that_need_a_match(condition, needs):
    assert RuleSet.define(("r", {"$a": "x"}, condition)).needs_match is needs


def test_pretest_is_never_too_strict(spark):
    rules = RuleSet.define(("r", {"$a": "the", "$b": "/q[0-9]+x/"}, "any of them"))
    texts = [("the",), ("q12x",), ("nothing",), ('{"a":"t\\u0068e"}',)]
    kept = spark.createDataFrame(texts, "t string").where(may_match(rules, F.col("t"))).collect()
    assert [r.t for r in kept] == [texts[0][0], texts[1][0], texts[3][0]]
    assert may_match(RuleSet.define(("r", {"$a": "x"}, "not $a")), F.col("t")) is None


def test_empty_and_missing_content(spark):
    table = spark.createDataFrame([("/d/0", None), ("/d/1", bytearray())], "path string, content binary")
    rules = RuleSet.define(("no", {"$a": "x"}, "not $a"), ("yes", {"$a": "x"}, "$a"))
    frame = raw_units(with_externals(artifacts_from(table, F.col("path"), F.col("content"))))
    for arrow in (False, True):
        assert hits(rule_findings(frame, rules, arrow=arrow)) == {("no", "/d/1")}


def test_many_rules_in_one_pass(spark):
    rules = RuleSet.define(*[(f"r{i}", {"$a": f"word{i:04d}", "$b": f"other{i}!"}, "any of them" if i % 2 else "all of them")
                             for i in range(400)])
    contents = [b"word0001 word0002", b"word0002 other2!", b"other399!", b""]
    assert hits(rule_findings(units(spark, contents), rules)) == {("r1", "/d/0"), ("r2", "/d/1"), ("r399", "/d/2")}


def test_overrun_is_reported(spark):
    rules = RuleSet.define(("r", {"$a": "/(a|b)+c/", "$b": "/(a|b)+d/"}, "any of them"))
    frame = units(spark, [b"ab" * 50 + b"c"])
    rows = unit_hits(frame, rules, deadline_s=-1).collect()
    assert len(rows) == 1 and rows[0].error is not None and rows[0].rules == []
    table = spark.createDataFrame([("/d/0", bytearray(b"abc"))], "path string, content binary")
    assert scan(table, rules=rules, rule_timeout_s=-1).errors.count() == 1


def test_no_verdict_on_a_unit_that_was_not_searched(spark):
    """Neither strategy may take a late search for one that found nothing."""
    table = spark.createDataFrame([("/d/0", bytearray(b"evil"))], "path string, content binary")
    for rules in (RuleSet.define(("clean", {"$a": "evil"}, "not $a")), RuleSet.define(("clean", {"$a": "/(e|v)+il/"}, "not $a"))):
        found = scan(table, rules=rules, rule_timeout_s=-1)
        assert found.findings.collect() == [] and found.errors.count() == 1
        assert scan(table, rules=rules).errors.collect() == []


def test_repeated_groups_on_long_texts(spark):
    """Java would run out of stack here; such rules are searched in Python."""
    rules = RuleSet.define(("r", {"$a": "/x(a|b)+c/"}, "any of them"))
    assert hits(rule_findings(units(spark, [b"x" + b"ab" * 200_000 + b"c"]), rules)) == {("r", "/d/0")}


def test_rule_sets_of_any_size(spark):
    """Sets of bounded size find what the whole set finds; rules stay with those they name, private ones too."""
    rows = []
    for i in range(12):
        rows += [(f"base{i}", f"f{i}", "$a", i % 2 == 0), (f"on{i}", f"f{i}", f"base{i} and not $b", False), (f"free{i}", f"f{i}", "#a > 1", False)]
    rules = [Row(rule_id=r, rule_file=f, condition=c, private=p) for r, f, c, p in rows]
    flags = {"nocase": False, "wide": False, "ascii": False, "fullword": False}
    strings = [
        Row(rule_id=f"{kind}{i}", string_id=name, kind="text", value=value, **flags)
        for i in range(12) for kind, name, value in (("base", "$a", f"word{i} "), ("on", "$b", f"stop{i}"), ("free", "$a", f"d{i} "))]
    whole = RuleSet.from_rows(rules, strings)
    texts = [" ".join(f"word{(i * j) % 12} stop{(i + j) % 20}" for j in range(1 + i % 7)) + " " for i in range(80)]
    table = spark.createDataFrame([(f"/{i}", t.encode()) for i, t in enumerate(texts)], "path string, content binary")
    expected = sorted((r.rule_name, r.found_in_file) for r in scan(table, rules=whole).findings.collect())
    assert len(expected) > 50
    for most in (9, 1000):
        shards = whole.shards(most)
        assert sum(len(s.rules) for s in shards) == 36 and all(len(s.strings) <= most for s in shards)
        assert len(shards) == 1 if most == 1000 else len(shards) > 1
        for options in ({}, {"details": True}):
            found = scan(table, rules=whole, rule_shard_strings=most, **options).findings
            assert sorted((r.rule_name, r.found_in_file) for r in found.select("rule_name", "found_in_file").collect()) == expected
