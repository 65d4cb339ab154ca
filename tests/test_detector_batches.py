"""Findings of detectors leave a task in batches of bounded size."""

import pyarrow as pa
from tests.test_batches import Plan

from iocscan.operators.detectors import PieceDetector


class Bare(PieceDetector):
    def _findings(self, hits):
        return hits


def _every_byte(state):
    return [("byte", i) for i in range(state)]


def test_findings_leave_in_small_batches():
    detector = Bare("Every", lambda piece: len(piece.own), lambda a, b: a + b, _every_byte)
    batch = pa.RecordBatch.from_pylist([{"path": "/a", "content": bytes(3000)}, {"path": "/b", "content": None}, {"path": "/c", "content": bytes(2500)}])
    out = list(detector.detect(Plan())([batch]))
    assert max(b.num_rows for b in out) <= 2000
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [("/a", "byte", str(i)) for i in range(3000)] + [("/c", "byte", str(i)) for i in range(2500)]


def test_states_of_pieces(spark):
    detector = PieceDetector("Own", lambda piece: piece.own, lambda a, b: a + b, lambda s: [("all", s.decode())])
    rows = [("/a", 2, 1, 2, 5, b"bcd"), ("/a", 0, 0, 2, 5, b"abc"), ("/a", 4, 1, 1, 5, b"de"), ("/b", 0, 0, 0, 0, b"")]
    pieces = spark.createDataFrame(rows, "path string, chunk_start long, chunk_lead long, chunk_length long, filesize long, content binary")
    found = {(r.found_in_file, r.value_data) for r in detector.detect_pieces(pieces).collect()}
    assert found == {("/a", "abcde"), ("/b", "")}
