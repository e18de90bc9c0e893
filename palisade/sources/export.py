"""Sanitised exports, row ceilings, and manifests of written folders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: characters that make a spreadsheet treat a cell as a formula, full-width forms included.
_FORMULA = "(?U)^\\s*[\\t\\r\\n=+\\-@＝＋－＠]"
MAX_ROWS_PER_FILE = 1_000_000
MAX_HASHED_BYTES = 256 << 20
BUFFER_BYTES = 8 << 20


class ExportLimit(Exception):
    """More rows match than the export may hold."""


def sanitized(c: Column | str) -> Column:
    """Text that a spreadsheet will not run: a quote is put before a leading formula character."""
    cell = F.col(c) if isinstance(c, str) else c
    return F.when(cell.rlike(_FORMULA), F.concat(F.lit("'"), cell)).otherwise(cell)


def sanitized_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The export columns in order; text is sanitised, NULL becomes empty."""
    def shown(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            return F.coalesce(sanitized(F.col(name)), F.lit("")).alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return df.select(*[shown(c) for c in columns])


def export_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A folder of CSV parts, each with the header; parts are bounded by rows."""
    options = {
        "header": True, "escape": '"', "quoteAll": True, "emptyValue": "", "maxRecordsPerFile": MAX_ROWS_PER_FILE,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    sanitized_frame(df, columns).write.options(**options).csv(path)


def export_jsonl(df: DataFrame, path: str, ignore_nulls: bool = True) -> None:
    df.write.option("ignoreNullFields", ignore_nulls).option("maxRecordsPerFile", MAX_ROWS_PER_FILE).json(path)


def require_at_most(df: DataFrame, n: int) -> DataFrame:
    """The frame itself, or an error when it has more rows: an export is never cut silently."""
    if df.limit(n + 1).count() > n:
        raise ExportLimit(f"more than {n} rows match; narrow the filters or raise the limit")
    return df


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's path as Spark reports it for the files in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _digest_of_streams(files: DataFrame) -> DataFrame:
    """path and SHA-256 of files of any size: each is read through a buffer by one task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                # A local path comes with one slash only, and no path is escaped.
                store, name = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(path, safe=":/@")))
                found = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as stream:
                    while data := stream.read(BUFFER_BYTES):
                        found.update(data)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "sha256": pa.array([found.hexdigest()])})

    return files.select("path").repartition("path").mapInArrow(digest, "path string, sha256 string")


def build_manifest(spark: SparkSession, folder: str, max_bytes: int = MAX_HASHED_BYTES) -> DataFrame:
    """Path within the folder, size and SHA-256 of each data file, hashed where the files are read.

    Spark reads a file of up to `max_bytes` as one value; a larger one is streamed through a buffer of a few megabytes, from
    a store that the tasks can open by its address (local or shared folders, object stores, Hadoop). Spark lists no file
    without content, so an empty file is in no manifest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring("path", len(_qualified(spark, folder)) + 2, 10_000).alias("name")
    # The size filters are pushed down: the content of a larger file is never read as a value.
    small = files.filter(F.col("length") <= max_bytes).select(name, F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > max_bytes).select("path", name, F.col("length").alias("size"))
    streamed = large.join(_digest_of_streams(large), "path").select("name", "size", "sha256")
    return small.unionByName(streamed).filter(~F.col("name").rlike("(^|/)[_.]"))


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame, max_bytes: int = MAX_HASHED_BYTES) -> DataFrame:
    """Files that are missing, unlisted, of another size, or changed; no row when all is well."""
    found = build_manifest(spark, folder, max_bytes).select("name", F.struct("size", "sha256").alias("f"))
    listed = manifest.select("name", F.struct("size", "sha256").alias("m"))
    problem = (
        F.when(F.col("f").isNull(), "missing")
        .when(F.col("m").isNull(), "unlisted")
        .when(F.col("f.size") != F.col("m.size"), "size_mismatch")
        .when(~F.col("f.sha256").eqNullSafe(F.col("m.sha256")), "digest_mismatch")
    )
    return listed.join(found, "name", "full_outer").select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())
