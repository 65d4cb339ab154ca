"""Inputs of the registered queries, derived from the given tables.

Each input comes as a DataFrame and as the same definition in ANSI SQL for the
comparison run.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from iocscan.functions.names import WELL_KNOWN_NAMES
from iocscan.operators.units import artifacts_from
from iocscan.session import work_folder
from iocscan.sources.files import FLUSH_BYTES
from iocscan.sources.stores import on_mount, store_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- artifacts: documents as files -------------------------------------------

def evidence_path() -> Column:
    """A path for each document: planted names, near misses of them, and ordinary names."""
    base = """element_at(array('svchost.exe', 'explorer.exe', 'iexplore.exe', 'lsass.exe', 'chrome.exe', 'csrss.exe',
        'firefox.exe', 'winlogon.exe'), int(doc_id % 8) + 1)"""
    return F.expr(f"""
        concat('/evidence/', source, '/', lang, '/', doc_id, '/', CASE floor(doc_id / 8) % 7
            WHEN 0 THEN {base} WHEN 1 THEN concat('0', substr({base}, 2))
            WHEN 2 THEN substr({base}, 1, length({base}) - 1) WHEN 3 THEN concat({base}, 'x')
            WHEN 4 THEN concat('00', substr({base}, 3)) WHEN 5 THEN replace({base}, 'r.exe', '.exe')
            ELSE concat('doc_', doc_id, '.txt') END)""")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, basename, content``; only the columns in use are read."""
    return artifacts_from(table(spark, folder, "documents"), evidence_path(), F.col("text"))


def file_tree(spark: SparkSession, folder: str) -> str:
    """The documents written as files below a fresh shared folder, which is returned."""
    root = on_mount(work_folder(spark, "tree"))

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                store_of(root).write(root + path.as_py(), content.as_py())
            yield batch.select(["path"])
    artifacts(spark, folder).select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


ARTIFACTS = """
based AS (
  SELECT *, CASE doc_id % 8 WHEN 0 THEN 'svchost.exe' WHEN 1 THEN 'explorer.exe' WHEN 2 THEN 'iexplore.exe'
      WHEN 3 THEN 'lsass.exe' WHEN 4 THEN 'chrome.exe' WHEN 5 THEN 'csrss.exe' WHEN 6 THEN 'firefox.exe'
      ELSE 'winlogon.exe' END AS base, CAST(floor(doc_id / 8.0) AS BIGINT) % 7 AS form
  FROM documents),
named AS (
  SELECT *, CASE form WHEN 0 THEN base WHEN 1 THEN concat('0', substr(base, 2))
      WHEN 2 THEN substr(base, 1, length(base) - 1) WHEN 3 THEN concat(base, 'x')
      WHEN 4 THEN concat('00', substr(base, 3)) WHEN 5 THEN replace(base, 'r.exe', '.exe')
      ELSE concat('doc_', CAST(doc_id AS VARCHAR), '.txt') END AS basename
  FROM based),
artifacts AS (
  SELECT doc_id, text, basename,
         concat('/evidence/', source, '/', lang, '/', CAST(doc_id AS VARCHAR), '/', basename) AS path
  FROM named)
"""

# --- indicators --------------------------------------------------------------

PATTERNS = ("^expl", "x$", "[.]txt$")

PATTERN_ROWS = "patterns(pattern) AS (VALUES ('^expl'), ('x$'), ('[.]txt$'))"

KNOWN_ROWS = """
known8(known) AS (VALUES ('svchost.exe'), ('explorer.exe'), ('iexplore.exe'), ('lsass.exe'), ('chrome.exe'),
  ('csrss.exe'), ('firefox.exe'), ('winlogon.exe'))
"""


#: Patterns with and without a literal, for each document and each customer.
MANY_PATTERNS_SQL = """
many(pattern) AS (
  SELECT concat('^doc_', CAST(doc_id AS VARCHAR), '[.]tx?t$') FROM documents
  UNION ALL SELECT concat('^(doc)?_0*', CAST(c_custkey AS VARCHAR), '[.](txt|exe)$') FROM customer
  UNION ALL SELECT concat('lsass[.]e.e', CAST(c_nationkey AS VARCHAR), '?$') FROM customer WHERE c_custkey <= 50
  UNION ALL SELECT * FROM (VALUES ('^expl'), ('x$'), ('[.]txt$')))
"""


def many_patterns(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    number, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    return (
        table(spark, folder, "documents").select(F.concat(F.lit("^doc_"), F.col("doc_id").cast("string"), F.lit("[.]tx?t$")).alias("pattern"))
        .unionAll(customers.select(F.concat(F.lit("^(doc)?_0*"), number, F.lit("[.](txt|exe)$"))))
        .unionAll(customers.where("c_custkey <= 50").select(F.concat(F.lit("lsass[.]e.e"), nation, F.lit("?$"))))
        .unionAll(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")))


def hash_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Hex digests as an analyst would hand them in: mixed case, some twice."""
    body = F.col("text").cast("binary")
    # the digests are joined, not the texts
    known = table(spark, folder, "documents").select(
        "doc_id", F.md5(body).alias("md5"), F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256")
    )
    labelled = known.join(table(spark, folder, "labels"), "doc_id")
    kinds = F.array_compact(F.array(
        F.when(F.col("toxic") == 1, F.upper("md5")),
        F.when(F.col("toxic") == 1, F.col("md5")),
        F.when(F.col("quality") == 0, F.col("sha1")),
        F.when(F.col("quality") == 1, F.col("sha256")),
    ))
    return labelled.select(F.explode(kinds).alias("hash"))


HASH_IOCS = """
ioc_hashes AS (
  SELECT 'MD5' AS algo, md5(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION SELECT 'SHA1', sha1(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 0
  UNION SELECT 'SHA256', sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
"""


def watch_list(spark: SparkSession, folder: str) -> DataFrame:
    """A long watch-list: the built-in names and one name per document."""
    built_in = spark.createDataFrame([(n,) for n in WELL_KNOWN_NAMES], "known string")
    return built_in.unionByName(table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("known")
    ))


# --- records and registry values ---------------------------------------------


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON records of one log per event type."""
    data = F.concat(
        F.lit('{"EventID":"'), "event_type", F.lit('","Data":{"User":"u'), F.col("user_id").cast("string"),
        F.lit('","Tags":["'), "event_type", F.lit('",1,null,true]},"Props":'), "props", F.lit("}"),
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("/logs/"), "event_type", F.lit(".evtx")).alias("file"),
        F.col("event_id").alias("record_id"), data.alias("data"),
    )


RECORDS = """
records AS (
  SELECT concat('/logs/', event_type, '.evtx') AS file, event_id AS record_id,
         concat('{"EventID":"', event_type, '","Data":{"User":"u', CAST(user_id AS VARCHAR),
                '","Tags":["', event_type, '",1,null,true]},"Props":', props, '}') AS data
  FROM events),
leaves AS (
  SELECT r.file, r.record_id, r.data, json_extract_string(t.json, t.fullkey) AS leaf
  FROM records r, json_tree(r.data) t WHERE t.type = 'VARCHAR')
"""


def registry_values(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as values of one hive per brand, with the types in turn."""
    kind = F.col("p_size") % 4
    return table(spark, folder, "part").select(
        F.concat(F.lit("/hives/"), "p_brand").alias("hive"),
        F.concat(F.lit("/"), "p_type").alias("key_path"),
        F.col("p_partkey").cast("string").alias("value_name"),
        F.when(kind == 0, "string").when(kind == 1, "binary").when(kind == 2, "multi").otherwise("number").alias("value_type"),
        F.when(kind == 0, F.col("p_name")).alias("s"),
        F.when(kind == 1, F.col("p_name").cast("binary")).alias("b"),
        F.when(kind == 2, F.split("p_name", " ")).alias("multi"),
    )


REGISTRY = """
registry AS (
  SELECT concat('/hives/', p_brand) AS hive, concat('/', p_type) AS key_path, CAST(p_partkey AS VARCHAR) AS value_name,
         unnest(CASE p_size % 4 WHEN 2 THEN string_split(p_name, ' ') WHEN 3 THEN [] ELSE [p_name] END) AS value,
         p_size % 4 = 1 AS is_binary
  FROM part),
registry_units AS (
  SELECT hive, value, concat(key_path, '/@', value_name, ' = ''',
         CASE WHEN is_binary THEN '<binary data>' ELSE value END, '''') AS value_data
  FROM registry)
"""

# --- compressed artifacts ----------------------------------------------------


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("folder/", b"")
        for name, data in members:
            archive.writestr(name, data)
    return out.getvalue()


def _packed(kind: str, data: bytes, source: str) -> bytes:
    if kind == "gz":
        return gzip.compress(data, mtime=0)
    if kind == "bz2":
        return bz2.compress(data)
    if kind == "xz":
        return lzma.compress(data, preset=1)
    return _zip([("folder/text.txt", data), ("source.txt", source.encode())]) if kind == "zip" else data


def _parts(data: bytes, n: int) -> list[bytes]:
    each = -(-len(data) // n)
    return [data[i * each:(i + 1) * each] for i in range(n)]


def packed(spark: SparkSession, folder: str, kinds: tuple[str, ...], streams: int = 1) -> DataFrame:
    """Each document packed in one of the kinds, in turn; ``raw`` stays as it is. With ``streams``, in so many one after another."""
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), kind)
    chosen = table(spark, folder, "documents").select(
        "doc_id", "n_chars", F.concat(F.lit("/packed/"), name).alias("path"), name.alias("basename"), kind.alias("kind"), "text", "source")
    given = ["doc_id", "n_chars", "path", "basename"]

    def pack(batches):
        def packed_rows(batch, first, contents):
            taken = batch.select(given).slice(first, len(contents))
            return pa.RecordBatch.from_arrays([*taken.columns, pa.array(contents, pa.binary())], names=[*given, "content"])

        # a batch may have 64 MB of text: it leaves in small ones, and only one document at a time is a Python object
        for batch in batches:
            first, contents, size = 0, [], 0
            for k, t, s in zip(*(batch.column(c) for c in ("kind", "text", "source"))):
                source = s.as_py()
                contents.append(b"".join(_packed(k.as_py(), part, source) for part in _parts(t.as_py().encode("utf-8"), streams)))
                size += len(contents[-1])
                if size >= FLUSH_BYTES:
                    yield packed_rows(batch, first, contents)
                    first, contents, size = first + len(contents), [], 0
            if contents:
                yield packed_rows(batch, first, contents)

    return chosen.mapInArrow(
        pack, "doc_id bigint, n_chars bigint, path string, basename string, content binary"
    )


def kind_sql(kinds: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    return f"CASE doc_id % {len(kinds)} {cases} END"
