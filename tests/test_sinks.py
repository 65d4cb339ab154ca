import csv
import glob
import json

from pyspark.sql import functions as F

from iocscan.api import scan
from iocscan.functions.content import escape_bytes, file_type
from iocscan.operators.detectors import BytesDetector
from iocscan.operators.rules import RuleSet
from iocscan.sinks.render import csv_lines, json_lines, suspicious_files, text_lines
from iocscan.sinks.write import write_csv, write_json, write_text
from iocscan.streaming.scan_stream import scan_stream, write_stream

RULES = RuleSet.define(("r1", {"$a": "b c", "$b": "zz"}, "any of them"))


def result(spark, details=True):
    table = spark.createDataFrame([("/d/lsas.exe", bytearray(b"a b c")), ('/d/q",\nx', bytearray(b"b c"))], "path string, content binary")
    return scan(table, rules=RULES, filename_patterns=["q"], known_names=True,
                hashes=["e6a65c3b01c87ea2f31134e3345a2c67"], details=details).findings


def test_escape(spark):
    everything = bytes(range(256))
    row = spark.createDataFrame([(bytearray(everything), bytearray())], "a binary, b binary").select(
        escape_bytes(F.col("a")).alias("a"), escape_bytes(F.col("b")).alias("b")
    ).first()
    assert row.b == ""
    assert row.a == "".join(chr(b) if 0x21 <= b <= 0x7E else f"\\{b:02x}" for b in everything)


def test_file_types(spark):
    heads = {"gz": b"\x1f\x8b", "bz2": b"BZh", "xz": b"\xfd7zXZ\0", "zip": b"PK\x03\x04", "evtx": b"ElfFile\0", "reg": b"regf", "raw": b"regx"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()] + [("raw", None), ("raw", bytearray())], "k string, c binary")
    assert rows.where(file_type(F.col("c")) != F.col("k")).count() == 0


def test_csv(spark, tmp_path):
    write_csv(result(spark), str(tmp_path / "o"), details=True)
    rows = []
    for part in glob.glob(str(tmp_path / "o" / "*.csv")):
        with open(part, newline="") as f:
            rows += [tuple(r.values()) for r in csv.DictReader(f)]
    assert sorted(rows) == sorted([
        ("Yara", "r1", "/d/lsas.exe", "$a at offset 2: b\\20c"), ("Yara", "r1", "/d/lsas.exe", "$b"),
        ("Yara", "r1", '/d/q",\nx', "$a at offset 0: b\\20c"), ("Yara", "r1", '/d/q",\nx', "$b"),
        ("Levenshtein", "lsass.exe", "/d/lsas.exe", ""), ("Filename", "q", '/d/q",\nx', ""),
    ])


def test_csv_without_details(spark):
    for details in (False, True):
        lines = csv_lines(result(spark, details)).collect()
        assert sorted((r.scanner_name, r.details) for r in lines) == [("Filename", ""), ("Levenshtein", ""), ("Yara", ""), ("Yara", "")]


def test_json(spark, tmp_path):
    write_json(result(spark), str(tmp_path / "o"))
    seen = []
    for part in glob.glob(str(tmp_path / "o" / "*.txt")):
        with open(part) as f:
            seen += [json.loads(line) for line in f.read().splitlines()]
    assert {
        "01_scanner": "yara", "02_suspicious_file": "/d/lsas.exe", "03_value": None,
        "04_strings": [{"identifier": "$a", "matches": [{"offset": 2, "data": "b\\20c"}]}, {"identifier": "$b", "matches": []}],
        "05_contained_file": None,
    } in seen
    assert {"01_scanner": "levenshtein", "02_suspicious_file": "/d/lsas.exe", "03_original_name": "lsass.exe"} in seen
    assert {"01_scanner": "filename", "02_suspicious_file": '/d/q",\nx', "03_pattern": "q"} in seen
    assert len(seen) == 4


def test_text(spark, tmp_path):
    write_text(result(spark), str(tmp_path / "o"), details=True)
    lines = [r.value for r in text_lines(result(spark), details=True).collect()]
    assert "Yara: r1 /d/lsas.exe\n  $a has the following matches:\n    0x00000002: b\\20c\n  $b matches" in lines
    assert "the name of the file /d/lsas.exe is very similar to lsass.exe" in lines
    assert "the name of '/d/q\",\nx' matches the pattern /q/" in lines
    assert "Yara: r1 /d/lsas.exe" in [r.value for r in text_lines(result(spark)).collect()]


def test_values_are_shown(spark):
    records = spark.createDataFrame([("/l", 1, '{"a":"b c"}')], "file string, record_id long, data string")
    empty = spark.createDataFrame([], "path string, content binary")
    found = scan(empty, rules=RULES, records=records, details=True).findings
    assert sorted(r.details for r in csv_lines(found, details=True).collect()) == [
        '$a at offset 0: b\\20c in ({"a":"b c"})', '$b in {"a":"b c"}',
    ]
    text = text_lines(found, details=True).first().value
    assert """  $a has the following matches in '{"a":"b c"}':""" in text and """  '{"a":"b c"}' matches to $b""" in text


def test_equal_lines_of_one_finding_once(spark):
    from iocscan.sources.rulefiles import parse_rules
    rules = RuleSet.from_rows(*parse_rules('rule r { strings: $ = "x" $ = "x" condition: any of them }'))
    table = spark.createDataFrame([("/a", bytearray(b"x"))], "path string, content binary")
    assert csv_lines(scan(table, rules=rules, details=True).findings, details=True).count() == 1


def test_own_detector(spark):
    table = spark.createDataFrame([("/a", bytearray(b"x")), ("/b", bytearray(b""))], "path string, content binary")
    found = scan(table, detectors=[BytesDetector("Mine", lambda d: [("r", str(len(d)))] if d else [])]).findings
    assert [(r.scanner, r.rule_name, r.found_in_file, r.value_data) for r in found.collect()] == [("Mine", "r", "/a", "1")]
    assert suspicious_files(found).count() == 1
    assert csv_lines(found).first().scanner_name == "Mine" and json.loads(json_lines(found).first().value)["01_scanner"] == "mine"
    assert text_lines(found).first().value == "Mine: r /a"


def test_stream_with_hashes(spark, tmp_path):
    table = spark.createDataFrame([("/d/a", "a", bytearray(b"hello, jan"))], "path string, basename string, content binary")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    found = scan_stream(stream, rules=RULES, filename_patterns=["a"], hashes=["e6a65c3b01c87ea2f31134e3345a2c67"])
    write_stream(found, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.scanner for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Filename", "Hash"]
