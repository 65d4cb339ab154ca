import hashlib

import pytest
from pyspark.sql import functions as F

from iocscan.api import scan
from iocscan.operators import digests
from iocscan.operators.digests import HashList
from iocscan.sources.iocs import hash_list


def test_kinds_duplicates_and_case(spark):
    md5, sha1, sha256 = (hashlib.new(n, b"x").hexdigest() for n in ("md5", "sha1", "sha256"))
    rows = hash_list(spark, [md5.upper(), md5, sha1, sha256]).collect()
    assert {(r.algo, r.digest) for r in rows} == {("MD5", md5), ("SHA1", sha1), ("SHA256", sha256)} and len(rows) == 3


@pytest.mark.parametrize("bad", ["abc", "zz" * 16, "ab" * 17, "", "ab" * 16 + "\n", " " + "a" * 31])
def test_bad_hashes_fail(spark, bad):
    with pytest.raises(Exception, match="invalid hash"):
        hash_list(spark, ["ab" * 16, bad]).collect()


def test_only_needed_digests(spark):
    hashes = HashList.of(hash_list(spark, ["ab" * 20]))
    assert hashes.algorithms == ["SHA1"] and hashes.small


def test_large_list_gives_the_same_with_a_hot_digest(spark):
    rows = [(f"/d/{i}", f"{i}", bytearray(b"" if i % 3 else str(i % 7).encode())) for i in range(300)]
    files = spark.createDataFrame(rows, "path string, basename string, content binary")
    iocs = hash_list(spark, [hashlib.md5(b"").hexdigest(), hashlib.sha256(b"3").hexdigest(), "00" * 20])
    small = digests.hash_findings(files, HashList.of(iocs))
    large = digests.hash_findings(files, HashList.of(iocs, broadcast_limit=0))
    key = ["rule_name", "artifact_path", "found_in_file"]
    expected = [
        (f"{a}:{h}", r[0], r[1]) for r in rows for a, h in (
            ("MD5", hashlib.md5(r[2]).hexdigest()), ("SHA256", hashlib.sha256(r[2]).hexdigest()),
        ) if h in (hashlib.md5(b"").hexdigest(), hashlib.sha256(b"3").hexdigest())
    ]
    assert sorted(map(tuple, small.select(*key).collect())) == sorted(expected)
    assert sorted(map(tuple, large.select(*key).collect())) == sorted(expected)


@pytest.mark.parametrize("digest", [
    "e6a65c3b01c87ea2f31134e3345a2c67",
    "47b76fed75208dffbba1a44296ae2ecf5f670c59",
    "49bd6f1ad0ddd3763d1ce074b00804fd2d84433d90fbda287e62c38327cb67b7",
])
def test_files_by_digest(spark, evidence, digest):
    found = scan(evidence, hashes=[digest]).findings.collect()
    assert [(r.found_in_file, r.artifact_path) for r in found] == [("sample2.txt", f"{evidence}/sample2.txt")]


def test_large_files_are_hashed_as_a_stream(spark, evidence):
    digest = hashlib.md5(b"hello, jan").hexdigest()
    found = scan(evidence, hashes=[digest], filename_patterns=["2"], chunk_bytes=4).findings
    assert {(r.scanner, r.found_in_file) for r in found.collect()} == {
        ("Hash", "sample2.txt"), ("Filename", f"{evidence}/sample2.txt"), ("Filename", f"{evidence}/sample1.txt.bz2"),
    }
