"""The extension point: detectors of one's own."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from iocscan.operators.findings import COLUMNS, finding


_FOUND = "path string, rule_name string, value string"
_FOUND_ARROW = pa.schema([(c, pa.string()) for c in ("path", "rule_name", "value")])
#: Findings that leave a task at once.
_FLUSH_ROWS = 2000


def _values(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The rows of a batch, one at a time as Python objects: a batch may have 64 MB of content."""
    for row in zip(*(batch.column(c) for c in columns)):
        yield tuple(x.as_py() for x in row)


def _batches(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    rows = []

    def taken():
        return pa.RecordBatch.from_arrays(
            [pa.array([None if x is None else str(x) for x in column], pa.string()) for column in zip(*rows)], schema=_FOUND_ARROW)
    for row in found:
        rows.append(row)
        if len(rows) >= _FLUSH_ROWS:
            yield taken()
            rows = []
    if rows:
        yield taken()


@runtime_checkable
class Detector(Protocol):
    """Anything with ``detect``: artifacts in, findings (``schemas.FINDING``) out.

    Artifacts have ``path``, ``basename`` and ``content``; columns that are not
    used are not read. Files above the size of a piece come only to detectors that also have
    ``detect_pieces`` (and ``overlap_bytes``, what they want to see on both sides of a piece); for others such files are reported as errors.
    """

    def detect(self, artifacts: DataFrame) -> DataFrame: ...


class ExpressionDetector:
    """A detector given as column expressions: where ``condition`` holds there is a finding."""

    def __init__(self, name: str, condition: Column, rule_name: Column, value: Column | None = None):
        self.name, self.condition, self.rule_name, self.value = name, condition, rule_name, value

    def detect(self, artifacts: DataFrame) -> DataFrame:
        hits = artifacts.where(self.condition)
        return hits.select(
            finding(self.name, self.rule_name, F.col("path"), F.col("path"), self.value).alias("f")
        ).select("f.*").select(*COLUMNS)


class BytesDetector:
    """A detector given as a Python function of the content, run in Arrow batches.

    ``search(data)`` yields ``(rule_name, value)`` for every finding in one file.
    """

    def __init__(self, name: str, search: Callable):
        self.name, self.search = name, search

    def detect(self, artifacts: DataFrame) -> DataFrame:
        search = self.search

        def run(batches):
            yield from _batches(
                (path, rule, value)
                for batch in batches
                for path, data in _values(batch, "path", "content")
                if data is not None
                for rule, value in search(data)
            )

        hits = artifacts.select("path", "content").mapInArrow(run, _FOUND)
        return hits.select(
            finding(self.name, F.col("rule_name"), F.col("path"), F.col("path"), F.col("value")).alias("f")
        ).select("f.*").select(*COLUMNS)


@dataclass(frozen=True)
class Piece:
    """A stretch of a file: its own bytes are ``data[lead:lead + length]`` and begin at ``start`` in the file of ``filesize`` bytes."""

    data: bytes
    start: int
    lead: int
    length: int
    filesize: int

    @property
    def own(self) -> bytes:
        return self.data[self.lead:self.lead + self.length]


class PieceDetector:
    """A detector of files of any size: a state for each piece, merged in order of the file, and findings from the state of the whole.

    ``of_piece(piece)`` gives a state, ``merge(left, right)`` the state of two neighbours together, and ``finish(state)`` yields
    ``(rule_name, value)`` for every finding. States are small and can be pickled. A file that is read whole is one piece, so its size
    changes nothing. Only states are shuffled.
    """

    def __init__(
        self, name: str, of_piece: Callable[[Piece], Any], merge: Callable[[Any, Any], Any], finish: Callable, overlap_bytes: int = 0,
    ):
        self.name, self.of_piece, self.merge, self.finish, self.overlap_bytes = name, of_piece, merge, finish, overlap_bytes

    def _findings(self, hits: DataFrame) -> DataFrame:
        return hits.select(
            finding(self.name, F.col("rule_name"), F.col("path"), F.col("path"), F.col("value")).alias("f")
        ).select("f.*").select(*COLUMNS)

    def detect(self, artifacts: DataFrame) -> DataFrame:
        of_piece, finish = self.of_piece, self.finish

        def run(batches):
            yield from _batches(
                (path, rule, value) for batch in batches
                for path, data in _values(batch, "path", "content") if data is not None
                for rule, value in finish(of_piece(Piece(data, 0, 0, len(data), len(data)))))
        return self._findings(artifacts.select("path", "content").mapInArrow(run, _FOUND))

    def detect_pieces(self, pieces: DataFrame) -> DataFrame:
        """``pieces`` as ``sources.files.read_files`` makes them, without those in error."""
        of_piece, merge, finish = self.of_piece, self.merge, self.finish

        columns = ("path", "chunk_start", "chunk_lead", "chunk_length", "filesize", "content")

        def states(batches):
            for batch in batches:
                made = [
                    (path, start, pickle.dumps(of_piece(Piece(data, start, lead, length, size))))
                    for path, start, lead, length, size, data in _values(batch, *columns)]
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.binary()))], names=["path", "place", "state"])

        def combined(table):
            table = table.sort_by("place")
            whole = reduce(merge, (pickle.loads(s.as_py()) for s in table.column("state")))
            path = table.column("path")[0].as_py()
            return pa.Table.from_batches(_batches((path, rule, value) for rule, value in finish(whole)), schema=_FOUND_ARROW)
        made = pieces.select(*columns).mapInArrow(states, "path string, place long, state binary")
        return self._findings(made.groupBy("path").applyInArrow(combined, _FOUND))
