"""What is found does not depend on whether a file is read whole or in pieces."""

import json

import pytest

from iocscan import scan
from iocscan.operators.detectors import BytesDetector, PieceDetector
from iocscan.operators.rules import RuleSet
from iocscan.sinks.render import csv_lines, json_lines, text_lines

RULES = (
    ("ab", {"$b": "evil", "$a": "/b[ad]{2,3}/", "$never": "zzzz"}, "$a or $b"), ("not", {"$x": "qqqq"}, "not $x"),
    ("bare", {}, "filesize > 3"), ("both", {"$a": "evil", "$b": "bad"}, "all of them"))


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "one").write_bytes(b"evil bad " * 300 + b"badd evil")
    (tmp_path / "two").write_bytes(b"nothing at all " * 100)
    (tmp_path / "three").write_bytes(b"evil")
    return str(tmp_path)


@pytest.mark.parametrize("size", [64, 700])
def test_sinks_give_the_same(spark, tree, size):
    whole, parts = (scan(tree, rules=RuleSet.define(*RULES), details=True, chunk_bytes=n) for n in (1 << 26, size))
    assert parts.findings.where("part = 2").count() > 3
    for render in (json_lines, lambda f: text_lines(f, details=True), lambda f: csv_lines(f, details=True)):
        one, two = (sorted(map(str, render(x.findings).collect())) for x in (whole, parts))
        assert one == two and one
    objects = [json.loads(r.value) for r in json_lines(parts.findings).collect()]
    assert len(objects) == whole.findings.count()
    counts = [{s["identifier"]: len(s["matches"]) for s in o["04_strings"]} for o in objects if o["02_suspicious_file"].endswith("one")]
    assert {"$b": 301, "$a": 301, "$never": 0} in counts
    for x in (whole, parts):
        x.release()


def test_equal_findings_stay_apart(spark):
    table = spark.createDataFrame([("/a", bytearray(b"evil"))] * 3, "path string, content binary")
    found = scan(table, rules=RuleSet.define(RULES[0]), details=True).findings
    assert json_lines(found).count() == 3
    assert "Exchange" not in json_lines(found)._jdf.queryExecution().executedPlan().toString()


def test_json_without_strings_is_refused(spark):
    table = spark.createDataFrame([("/a", bytearray(b"evil"))], "path string, content binary")
    with pytest.raises(Exception, match="details=True"):
        json_lines(scan(table, rules=RuleSet.define(RULES[0])).findings).collect()


def count_of(word):
    """Occurrences of a word, those over a border too: each piece sees the word's length less one behind it."""
    def of_piece(piece):
        seen = piece.data[piece.lead:piece.lead + piece.length + len(word) - 1]
        return seen.count(word)
    return PieceDetector("Count", of_piece, lambda a, b: a + b, lambda n: [("often", str(n))] if n > 100 else [], overlap_bytes=len(word) - 1)


def test_detectors_see_files_of_any_size(spark, tree):
    expected = {("often", f"{tree}/one", "301")}
    for size in (1 << 26, 700, 50):
        result = scan(tree, detectors=[count_of(b"evil")], chunk_bytes=size)
        assert {(r.rule_name, r.found_in_file, r.value_data) for r in result.findings.collect()} == expected
        assert result.errors.count() == 0
        result.release()


def test_files_that_a_detector_cannot_see_are_reported(spark, tree):
    detector = BytesDetector("Mine", lambda data: [("r", str(len(data)))])
    result = scan(tree, detectors=[detector], chunk_bytes=1000)
    assert [r.found_in_file for r in result.findings.collect()] == [f"{tree}/three"]
    assert sorted((r.path, r.scanner, r.stage) for r in result.errors.collect()) == [(f"{tree}/one", "Mine", "detect"), (f"{tree}/two", "Mine", "detect")]
