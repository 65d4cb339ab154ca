import bz2
import gzip
import lzma
import os
import zipfile

import pytest
from pyspark.sql import SparkSession

from iocscan.session import prepare


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def evidence(tmp_path_factory):
    """Two text files, the first one also packed in every supported way."""
    root = tmp_path_factory.mktemp("evidence")
    first, second = b"hello, world", b"hello, jan"
    (root / "sample1.txt").write_bytes(first)
    (root / "sample2.txt").write_bytes(second)
    (root / "sample1.txt.gz").write_bytes(gzip.compress(first, mtime=0))
    (root / "sample1.txt.bz2").write_bytes(bz2.compress(first))
    (root / "sample1.txt.xz").write_bytes(lzma.compress(first))
    with zipfile.ZipFile(root / "sample.zip", "w") as archive:
        archive.writestr("inner/", b"")
        archive.writestr("sample1.txt", first)
    return str(root)


@pytest.fixture
def odd_files(tmp_path):
    """Files that are easily lost: empty, hidden, underscored, linked, deep."""
    deep = tmp_path / "a" / ".hidden" / "_dir"
    deep.mkdir(parents=True)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".bashrc").write_bytes(b"x")
    (tmp_path / "_tmp").write_bytes(b"y")
    (tmp_path / "with space.tar.gz").write_bytes(b"z")
    (deep / "deep.bin").write_bytes(b"\xff\x00\xfe")
    os.symlink(tmp_path / "_tmp", tmp_path / "link")
    os.symlink(tmp_path / "a", tmp_path / "linked_dir")
    return tmp_path
