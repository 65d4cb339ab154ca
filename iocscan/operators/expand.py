"""Expansion of compressed artifacts into scan units."""

from __future__ import annotations

import bz2
import io
import lzma
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from iocscan.schemas import UNIT
from iocscan.sources.files import CHUNK_BYTES, FLUSH_BYTES, OVERLAP_BYTES
from iocscan.sources.stores import store_of

_STEP = 1024 * 1024
#: Entries of one archive that one task reads at a time, and parts into which an archive is shared out at most:
#: every part reads the directory, so their number must not grow with it.
MEMBERS_PER_SHARE, MOST_SHARES = 256, 64

#: Where a piece lies in its unit.
PLACE = ("chunk_start", "chunk_lead", "chunk_length", "filesize")

EXPANDED = T.StructType([
    *UNIT.fields, *[T.StructField(n, T.LongType()) for n in PLACE],
    T.StructField("error", T.StringType()),
])


def _decoder(kind: str):
    if kind == "gz":
        return zlib.decompressobj(31)
    return bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(lzma.FORMAT_XZ)


def decoded(kind: str, stream) -> Iterator[bytes]:
    """The content of a gz, bz2 or xz file in steps of bounded size, over all streams in it.

    Zeros after the last stream are padding; anything else there is an error, raised after all content was given out.
    """
    decoder, pending, begun = _decoder(kind), b"", False
    while True:
        if decoder.eof:
            pending = decoder.unused_data
            decoder, begun = _decoder(kind), False
        if not begun:
            # padding between streams, and whatever remains after the last
            while True:
                pending = pending.lstrip(b"\0")
                if pending:
                    break
                pending = stream.read(_STEP)
                if not pending:
                    return
            begun = True
        elif kind == "gz":
            pending = decoder.unconsumed_tail or stream.read(_STEP)
        else:
            pending = stream.read(_STEP) if decoder.needs_input else b""
            if not pending and not decoder.needs_input:
                piece = decoder.decompress(b"", _STEP)
                if piece:
                    yield piece
                continue
        if not pending:
            raise EOFError(f"{kind} data ends too early")
        piece = decoder.decompress(pending, _STEP)
        pending = b""
        if piece:
            yield piece


def _steps(stream) -> Iterator[bytes]:
    while piece := stream.read(_STEP):
        yield piece


def _regular(info: zipfile.ZipInfo) -> bool:
    return not info.is_dir() and (info.external_attr >> 16) & 0o170000 in (0, 0o100000)


def _held(steps: Iterator[bytes], limit: int) -> tuple[bytes, bool, str | None]:
    """Up to ``limit`` bytes, whether there are more, and what broke off the decoding."""
    out, size = [], 0
    try:
        for piece in steps:
            out.append(piece)
            size += len(piece)
            if size > limit:
                return b"".join(out)[:limit], True, None
    except Exception as error:
        return b"".join(out), False, f"{type(error).__name__}: {error}"
    return b"".join(out), False, None


def _contents(steps: Callable[[], Iterator[bytes]], budget: int | None, chunk: int, overlap: int) -> Iterator[dict]:
    """Content of one unit: a row, or overlapping pieces where it has more than ``chunk`` bytes.

    What was decoded before an error is a unit as well; the error comes as a row of its own.
    """
    data, more, error = _held(steps(), min(chunk, budget) if budget else chunk)
    if not more or (budget and budget <= chunk):
        if data or not error:
            yield {"content": data, "truncated": more}
        if error:
            yield {"error": error}
        return
    # decoded again and again rather than held: once for the length, once for the pieces
    total = 0
    try:
        for piece in steps():
            total += len(piece)
            if budget and total >= budget:
                break
    except Exception as broken:
        error = f"{type(broken).__name__}: {broken}"
    cut = bool(budget) and total > budget
    total = min(total, budget) if budget else total
    source, held, base, start = steps(), b"", 0, 0
    while start < total:
        lead, own = min(start, overlap), min(chunk, total - start)
        until = min(start + own + overlap, total)
        parts, size = [held], len(held)
        while base + size < until:
            piece = next(source)
            parts.append(piece)
            size += len(piece)
        held = b"".join(parts)[start - lead - base:]
        base = start - lead
        yield {
            "content": held[:until - base], "truncated": cut, "chunk_start": start, "chunk_lead": lead, "chunk_length": own,
            "filesize": total}
        start += own
    if error:
        yield {"error": error}


def _units_of(row: dict, budget: int | None, chunk: int, overlap: int) -> Iterator[dict]:
    base = {
        "artifact_path": row["path"], "found_in_file": row["path"], "unit_id": row["path"],
        "unit_kind": row["filetype"],
        **{c: row[c] for c in ("filename", "filepath", "extension", "filetype", "md5", "owner")},
    }
    content = row.get("content")

    def opened():
        return io.BytesIO(content) if content is not None else store_of(row["path"]).open(row["path"])

    def member(info: zipfile.ZipInfo) -> Iterator[bytes]:
        with archive.open(info) as stream:
            yield from _steps(stream)

    def whole() -> Iterator[bytes]:
        with opened() as stream:
            yield from decoded(row["filetype"], stream)

    try:
        if row["filetype"] != "zip":
            for part in _contents(whole, budget, chunk, overlap):
                yield {**base, **part}
            return
        with opened() as stream, zipfile.ZipFile(stream) as archive:
            for info in archive.infolist()[row.get("member_first") or 0:row.get("member_end")]:
                if not _regular(info):
                    continue
                shown = f"{row['path']}:{info.filename}"
                for part in _contents(lambda: member(info), budget, chunk, overlap):  # noqa: B023 - used up at once
                    yield {
                        **base, "unit_kind": "member", "found_in_file": shown, "unit_id": shown,
                        "filename": info.filename, "contained_file": info.filename, **part,
                    }
    except Exception as error:
        yield {**base, "error": f"{type(error).__name__}: {error}"}


def whole_units(expanded: DataFrame) -> DataFrame:
    """The units that came in one row."""
    return expanded.where(F.col("chunk_start").isNull()).drop(*PLACE)


def expand(
    artifacts: DataFrame, max_unit_bytes: int | None = None, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES,
) -> DataFrame:
    """The units in gz, bz2 and xz artifacts and in the regular members of zip archives.

    All streams of a file are decoded. A unit of more than ``chunk_bytes`` comes in overlapping pieces, as large files do (see
    ``sources.files``); other rows have no ``chunk_start``. Only a ``max_unit_bytes`` given by the caller leaves content out, and marks
    the unit as ``truncated``. Rows with an ``error`` have no content; what was decoded before it is in a row of its own.
    Archives inside archives are not opened. Units leave in batches of bounded size, so an archive
    with any number of members is streamed. Without a ``content`` column the
    file is opened by its path, and a large archive is shared out among tasks.
    """
    arrow = to_arrow_schema(EXPANDED)
    names = EXPANDED.fieldNames()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names], schema=arrow
        )

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                for unit in _units_of(row, max_unit_bytes, chunk_bytes, overlap_bytes):
                    rows.append(unit)
                    size += len(unit.get("content") or b"") + 256
                    if size >= FLUSH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    columns = ["path", "filename", "filepath", "extension", "filetype", "md5", "owner"]
    if "content" in artifacts.columns:
        return artifacts.select(*columns, "content").mapInArrow(run, EXPANDED)
    return _shares(artifacts.select(*columns)).mapInArrow(run, EXPANDED)


def _shares(files: DataFrame) -> DataFrame:
    """One row per stream and per share of the entries of an archive, spread over the tasks."""
    schema = T.StructType([
        *files.schema.fields, T.StructField("member_first", T.LongType()), T.StructField("member_end", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                entries = 0
                if row["filetype"] == "zip":
                    try:
                        with zipfile.ZipFile(row["path"]) as archive:
                            entries = len(archive.infolist())
                    except Exception:  # reported when the archive is expanded
                        entries = 0
                each = max(MEMBERS_PER_SHARE, -(-entries // MOST_SHARES))
                out += [
                    {**row, "member_first": at, "member_end": at + each} for at in range(0, max(entries, 1), each)
                ]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    spread = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.mapInArrow(run, schema).repartition(spread)
