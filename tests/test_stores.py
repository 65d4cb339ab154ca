"""Evidence that is named by a URI gives what a plain path gives."""

import os

import pytest
from pyarrow import fs

from iocscan import scan
from iocscan.operators.rules import RuleSet
from iocscan.sources import files as files_module
from iocscan.sources import stores
from iocscan.sources.files import ListingReader, digest_files, list_files, read_files, task_count
from iocscan.sources.stores import Mount, Store, on_mount, store_of


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a" / ".deep").mkdir(parents=True)
    (tmp_path / "one file.txt").write_bytes(b"evil one")
    (tmp_path / "a" / "_two").write_bytes(b"")
    (tmp_path / "a" / ".deep" / "svchost.ex").write_bytes(b"x" * 5000 + b"evil" + b"y" * 5000)
    return tmp_path


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_file_uri_is_the_plain_path(spark, tree):
    assert on_mount(f"file://{tree}") == on_mount(f"file:{tree}") == on_mount(str(tree)) == str(tree)
    assert on_mount("file://host/a%20b") == "/a b" and on_mount("hdfs://n/a") == "hdfs://n/a"
    plain, uri = list_files(spark, str(tree)), list_files(spark, f"file://{tree}")
    assert rows(plain) == rows(uri) and plain.count() == 3
    rules = RuleSet.define(("r", {"$a": "evil"}, "$a"))
    for options in ({}, {"chunk_bytes": 1000}, {"details": True}):
        one, two = (scan(p, rules=rules, known_names=True, hashes=["d41d8cd98f00b204e9800998ecf8427e"], **options) for p in (str(tree), f"file://{tree}"))
        assert sorted(map(str, one.findings.collect())) == sorted(map(str, two.findings.collect())) and one.findings.count() == 4
        assert two.errors.count() == 0
        one.release()
        two.release()


def test_store_by_pyarrow_gives_the_same(spark, tree, monkeypatch):
    """The same folder through a ``pyarrow`` file system, in the workers too."""
    expected = scan(str(tree), rules=RuleSet.define(("r", {"$a": "evil"}, "$a")), known_names=True)
    plain = {(r.scanner, r.rule_name, r.found_in_file) for r in expected.findings.collect()}
    digests = {(r.path, r.digest_sha256) for r in digest_files(list_files(spark, str(tree)), ["SHA256"]).collect()}
    monkeypatch.setattr(files_module, "on_mount", lambda path: path)
    listing = list_files(spark, f"file://{tree}", 3)
    assert {(r.path, r.length, r.owner, r.error) for r in listing.collect()} == {
        (f"file://{p}", os.path.getsize(p), None, None) for p in map(str, (tree / "one file.txt", tree / "a" / "_two", tree / "a" / ".deep" / "svchost.ex"))}
    assert {(r.path.removeprefix("file://"), r.digest_sha256) for r in digest_files(listing, ["SHA256"]).collect()} == digests
    for size in (1000, 1 << 26):
        found = scan(f"file://{tree}", rules=RuleSet.define(("r", {"$a": "evil"}, "$a")), known_names=True, chunk_bytes=size)
        assert {(r.scanner, r.rule_name, r.found_in_file.removeprefix("file://")) for r in found.findings.collect()} == plain
        assert found.errors.count() == 0
    missing = list_files(spark, f"file://{tree}/nothing").collect()
    assert len(missing) == 1 and missing[0].error
    gone = spark.createDataFrame([(f"file://{tree}/gone", "gone", 5, 1, None, None)], listing.schema)
    assert read_files(gone).first().error and digest_files(gone, ["MD5"]).first().error


def test_own_scheme(tree, monkeypatch):
    monkeypatch.setattr(stores, "_OWN", {})
    stores.register("vault", lambda uri: (fs.SubTreeFileSystem(str(tree), fs.LocalFileSystem()), ""))
    store = store_of("vault://case7/a/_two")
    assert isinstance(store, Store) and isinstance(store_of("/a://b"), Mount) and isinstance(store_of("/plain"), Mount)
    reader = ListingReader("vault://case7/", 2)
    found = {row[0] for part in reader.partitions() for row in reader.read(part)}
    assert found == {"vault://case7/one file.txt", "vault://case7/a/_two", "vault://case7/a/.deep/svchost.ex"}
    store.write("vault://case7/new/deep/file", b"abc")
    with store.open("vault://case7/new/deep/file") as stream:
        stream.seek(1)
        assert stream.read() == b"bc"
    assert (tree / "new" / "deep" / "file").read_bytes() == b"abc"
    stores._connected.cache_clear()


def test_content_is_read_once_for_findings_and_errors(spark, tree):
    """Errors come from the rows of the same reading: no second content read in either plan."""
    os.chmod(tree / "one file.txt", 0)
    (tree / "gone").write_bytes(b"evil")
    result = scan(str(tree), rules=RuleSet.define(("r", {"$a": "evil"}, "$a")), hashes=["d41d8cd98f00b204e9800998ecf8427e"])
    (tree / "gone").unlink()
    assert [r.path for r in result.errors.where("stage = 'read' and message like '%No such file%'").collect()][-1:] == [str(tree / "gone")]
    assert {r.found_in_file for r in result.findings.collect()} >= {str(tree / "a" / ".deep" / "svchost.ex")}
    readers = []
    for frame in (result.findings, result.errors):
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        readers.append(text.count("InMemoryRelation"))
        assert text.count("chunk_start") == 0 or "InMemoryRelation" in text
    assert all(readers)
    result.release()


def test_tasks_go_with_bytes(spark, monkeypatch):
    listing = spark.createDataFrame([("/a", 10 ** 12), ("/b", 5)], "path string, length long")
    cores = 4 * spark.sparkContext.defaultParallelism
    assert task_count(listing) == -(-(10 ** 12 + 5) // files_module.TASK_BYTES) and task_count(listing.where("path = '/b'")) == cores
    monkeypatch.setattr(files_module, "MOST_TASKS", 100)
    assert task_count(listing) == 100 and task_count(listing.limit(0)) == cores
