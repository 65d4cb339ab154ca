"""Evidence files on a file system that all executors can see, or in a store named by a URI (``stores``).

Spark's own binary file source leaves out dot-files, files that begin with an
underscore and empty files, and follows links; none of that is acceptable for
evidence. Here a listing source gives one row per regular file, and the content
is read in a second step whose tasks are balanced by bytes, because only the
listing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from iocscan.functions.content import MAGIC
from iocscan.functions.names import basename
from iocscan.session import prepare
from iocscan.sources.stores import _shown, on_mount, store_of

LISTED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("modified", T.LongType()),
    T.StructField("owner", T.StringType()),
    T.StructField("error", T.StringType()),
])

#: Files above this size are read in several pieces.
CHUNK_BYTES = 64 * 1024 * 1024
#: Content of about so many bytes leaves a task at once; rows of more leave one by one.
FLUSH_BYTES = 2 * 1024 * 1024
#: Bytes of files that a task reads, about, and tasks of a scan at most.
TASK_BYTES, MOST_TASKS = 256 * 1024 * 1024, 1_000_000
#: Bytes read on both sides of a piece; no match may be longer.
OVERLAP_BYTES = 64 * 1024


class Subtree(InputPartition):
    """A directory; with ``deep``, everything below it too."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.wanted = root, partitions

    def partitions(self) -> list[InputPartition]:
        """Open directories from the top until there are enough to share out."""
        store = store_of(self.root)
        if not store.is_folder(self.root):
            return [Subtree(self.root, False)]
        done: list[InputPartition] = []
        front = [self.root]
        while front and len(front) + len(done) < self.wanted:
            folder = front.pop(0)
            done.append(Subtree(folder, False))
            try:
                front += store.folders(folder)
            except OSError:
                continue  # reported by the task that lists the folder
        return done + [Subtree(folder, True) for folder in front]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        store = store_of(partition.folder)
        if not store.is_folder(partition.folder):
            row = store.row(partition.folder)
            if row is not None:
                yield row
            return
        pending = [partition.folder]
        while pending:
            folder = pending.pop()
            try:
                for path, row in store.entries(folder):
                    if row is not None:
                        yield row
                    elif partition.deep:
                        pending.append(path)
            except OSError as error:
                yield _shown(folder), None, None, None, str(error)


class FileListing(DataSource):
    """``spark.read.format("file_listing").option("path", root)``."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> T.StructType:
        return LISTED

    def reader(self, schema: T.StructType) -> ListingReader:
        return ListingReader(self.options.get("path", "/"), int(self.options.get("partitions", 64)))


def list_files(spark: SparkSession, path: str = "/", partitions: int | None = None) -> DataFrame:
    """``path, basename, length, modified, owner, error`` of all regular files below ``path``, a path or a URI.

    Paths come out as they would be opened: plain ones below a plain path or a ``file:`` URI, URIs below any other, where ``owner`` is null.
    """
    prepare(spark)
    spark.dataSource.register(FileListing)
    path = on_mount(path)
    wanted = partitions or 4 * spark.sparkContext.defaultParallelism
    listed = spark.read.format("file_listing").option("path", path).option("partitions", wanted).load()
    return listed.select("path", basename(F.col("path")).alias("basename"), "length", "modified", "owner", "error")


def task_count(listing: DataFrame) -> int:
    """Tasks that read all files of a listing: one for about ``TASK_BYTES``, and at least four for each core."""
    cores = 4 * listing.sparkSession.sparkContext.defaultParallelism
    total = listing.agg(F.sum("length")).first()[0] or 0
    return max(cores, min(-(-total // TASK_BYTES), MOST_TASKS))


def _pieces(listing: DataFrame, chunk_bytes: int, tasks: int | None) -> DataFrame:
    """One row per piece of each readable file, spread evenly over the tasks."""
    starts = F.sequence(
        F.lit(0).cast("long"),
        F.greatest(F.col("length") - 1, F.lit(0).cast("long")),
        F.lit(chunk_bytes).cast("long"),
    )
    spread = tasks or listing.sparkSession.sparkContext.defaultParallelism * 4
    return (
        listing.where(F.col("error").isNull())
        .select("*", F.explode(starts).alias("chunk_start"))
        .repartition(spread)
    )


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, some of them at a time as Python objects."""
    for first in range(0, batch.num_rows, 256):
        yield from batch.slice(first, 256).to_pylist()


_READ = [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]


def read_files(
    listing: DataFrame, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES,
    chunked: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Add ``content``; a file that cannot be read has ``error`` instead.

    With ``chunked`` there is one row per piece, with ``chunk_start``,
    ``chunk_length`` (the piece itself), ``chunk_lead`` (overlap before it) and
    ``filesize``; without, files of more than ``chunk_bytes`` are left to it. ``tasks``: see ``task_count``.
    """
    if chunked:
        pieces = _pieces(listing, chunk_bytes, tasks)
    else:
        pieces = _pieces(listing.where(F.col("length") <= chunk_bytes), chunk_bytes, tasks)
    kept = [f for f in pieces.schema.fields if f.name not in ("error", "content")]
    extra = [
        T.StructField("chunk_lead", T.LongType()), T.StructField("chunk_length", T.LongType()),
        T.StructField("filesize", T.LongType()),
    ] if chunked else []
    schema = T.StructType([*kept, *extra, *_READ])
    arrow = to_arrow_schema(schema)

    def one(row: dict) -> dict:
        start = row["chunk_start"]
        lead = min(start, overlap_bytes) if chunked else 0
        own = min(chunk_bytes, max(row["length"] - start, 0))
        try:
            with store_of(row["path"]).open(row["path"]) as stream:
                stream.seek(start - lead)
                row["content"] = stream.read(lead + own + (overlap_bytes if chunked else 0))
        except OSError as error:
            row["error"] = str(error)
        row.update(chunk_lead=lead, chunk_length=own, filesize=row["length"])
        return row

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for row in _rows(batch):
                rows.append(one({**row, "content": None, "error": None}))
                size += len(rows[-1]["content"] or b"") + 256
                if size >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    read = pieces.mapInArrow(run, schema)
    return read if chunked else read.drop("chunk_start")


def digest_files(listing: DataFrame, algos: list[str], tasks: int | None = None) -> DataFrame:
    """Digests of whole files of any size, read as a stream: ``digest_md5`` and so on."""
    names = [f"digest_{a.lower()}" for a in algos]
    kept = [f for f in listing.schema.fields if f.name != "error"]
    schema = T.StructType([
        *kept, *[T.StructField(n, T.StringType()) for n in names], T.StructField("error", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                hashers = {n: hashlib.new(n.removeprefix("digest_")) for n in names}
                try:
                    with store_of(row["path"]).open(row["path"]) as stream:
                        while piece := stream.read(1 << 20):
                            for hasher in hashers.values():
                                hasher.update(piece)
                    row.update({n: h.hexdigest() for n, h in hashers.items()}, error=None)
                except OSError as error:
                    row["error"] = str(error)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spread = tasks or listing.sparkSession.sparkContext.defaultParallelism * 4
    return listing.where(F.col("error").isNull()).repartition(spread).mapInArrow(run, schema)


def with_file_types(listing: DataFrame) -> DataFrame:
    """Add ``filetype`` from the first bytes of each file, without reading the rest, and ``head_error``."""
    schema = T.StructType([
        *listing.schema.fields, T.StructField("filetype", T.StringType()), T.StructField("head_error", T.StringType())])
    arrow = to_arrow_schema(schema)
    prefixes = {name: bytes.fromhex(code) for name, code in MAGIC.items()}
    longest = max(map(len, prefixes.values()))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["filetype"], row["head_error"] = "raw", None
                if row["error"] is None:
                    try:
                        with store_of(row["path"]).open(row["path"]) as stream:
                            head = stream.read(longest)
                        row["filetype"] = next((n for n, p in prefixes.items() if head.startswith(p)), "raw")
                    except OSError as error:
                        row["head_error"] = str(error)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # paths only: a flat folder is listed by one task, but its files are opened by all
    spread = listing.sparkSession.sparkContext.defaultParallelism * 4
    return listing.repartition(spread).mapInArrow(run, schema)
