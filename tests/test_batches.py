"""What leaves a task at once has a bounded size, and work of one partition is spread."""

import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from iocscan.operators.expand import expand
from iocscan.plans import inputs
from iocscan.sources import files as file_source

MOST = 4 * 1024 * 1024


class Plan:
    """Stands for a table, and gives the function that its batches would go through."""

    def __init__(self, columns=(), schema=None):
        self.columns, self.schema = list(columns), schema

    def select(self, *columns):
        return self

    drop = select

    def mapInArrow(self, run, schema):
        return run


def _sizes(batches):
    return [sum(len(x) for x in b.column("content").to_pylist()) for b in batches]


def test_expanded_units_leave_in_small_batches(spark):
    names = ["path", "filename", "filepath", "extension", "filetype", "md5", "owner"]
    rows = [dict.fromkeys(names, "-") | {"path": f"/{i}", "filetype": "gz", "content": gzip.compress(bytes(1024 * 1024))} for i in range(24)]
    out = list(expand(Plan([*names, "content"]))([pa.RecordBatch.from_pylist(rows)]))
    assert sum(_sizes(out)) == 24 * 1024 * 1024 and max(_sizes(out)) <= MOST
    assert [p for b in out for p in b.column("artifact_path").to_pylist()] == [f"/{i}" for i in range(24)]


@pytest.mark.parametrize("streams", [1, 3])
def test_packed_documents_leave_in_small_batches(spark, monkeypatch, streams):
    monkeypatch.setattr(inputs, "table", lambda *_: Plan())
    run = inputs.packed(spark, "", ("raw", "gz"), streams)
    rows = [{
        "doc_id": i, "n_chars": 1, "path": f"/packed/{i}", "basename": str(i), "kind": "gz" if i == 5 else "raw",
        "text": f"{i % 10}" * 700_000, "source": "s"} for i in range(20)]
    out = list(run([pa.RecordBatch.from_pylist(rows)]))
    assert len(out) > 1 and max(_sizes(out)) <= MOST
    got = {r["doc_id"]: r for b in out for r in b.to_pylist()}
    assert list(got) == list(range(20)) and got[7]["path"] == "/packed/7"
    # with more streams, raw parts are put together again
    assert all(got[r["doc_id"]]["content"] == r["text"].encode() for r in rows if r["kind"] == "raw")
    assert gzip.decompress(got[5]["content"]) == rows[5]["text"].encode()


def test_files_leave_in_small_batches(spark, tmp_path, monkeypatch):
    listing = file_source.list_files(spark, str(tmp_path))
    fields = listing.select("path", "length", F.lit(0).cast("long").alias("chunk_start")).schema
    monkeypatch.setattr(file_source, "_pieces", lambda *_: Plan(schema=fields))
    rows = []
    for i in range(600):
        (tmp_path / str(i)).write_bytes(bytes([i % 256]) * 40_000)
        rows.append({"path": str(tmp_path / str(i)), "length": 40_000, "chunk_start": 0})
    out = list(file_source.read_files(Plan(), chunked=True)([pa.RecordBatch.from_pylist(rows)]))
    assert max(_sizes(out)) <= MOST
    assert [r["content"] for b in out for r in b.to_pylist()] == [bytes([i % 256]) * 40_000 for i in range(600)]
