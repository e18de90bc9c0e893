"""Tables laid out by tenant and day, and keyed tables whose next version rewrites only the buckets that change."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_POINTERS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


def write_by_tenant(df: DataFrame, path: str, ts: str = "ts", files: int = 8) -> None:
    """A folder for each tenant and day, so that a read for one tenant opens its files only.

    Rows of a day are dealt to `files` tasks, so a busy tenant's day is not one task's, and a folder holds few files.
    """
    dealt = df.withColumns({"day": F.to_date(ts), "__file": F.pmod(F.xxhash64(*df.columns), F.lit(files))})
    dealt.repartition("tenant_id", "day", "__file").drop("__file").write.partitionBy("tenant_id", "day").parquet(path)


def read_by_tenant(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table again, with `day`; its types are those it was written with, not guessed from folder names."""
    return spark.read.schema(T.StructType([*like.schema.fields, T.StructField("day", T.DateType())])).parquet(path)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions whose pointers are written in whole; a listing of one folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def current_version(spark: SparkSession, root: str) -> int:
    """The newest whole version, 0 where nothing has been written."""
    return max(_versions(spark, root), default=0)


def _folders(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    # One row for each bucket.
    rows = spark.read.schema(_POINTERS).parquet(f"{root}/pointers/v{version:08d}").collect() if version else []
    return {r["bucket"]: r["folder"] for r in rows}


def read_version(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The table as of a version (the newest if none is named); an older one stays readable as it was."""
    folders = _folders(spark, root, current_version(spark, root) if version is None else version)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(folders.values()))


def merge_version(
    rows: DataFrame, root: str, keys: Sequence[str], content: str, removed: DataFrame | None = None, buckets: int = BUCKETS
) -> tuple[int, list[int]]:
    """Bring the table at `root` to `rows`: rows whose key is new or whose `content` differs replace those it has.

    `rows` has one row for a key; keys in `removed` go. Keys are dealt to `buckets` folders, and only a folder with a
    change is written anew, beside the old one. Then one small table of folders makes the new version the current one, so
    a run that fails before that, or two that meet, leave the old version as it was. Returns the version and the
    buckets written: none, and the same version, where nothing has changed.
    """
    spark = rows.sparkSession
    version = current_version(spark, root)
    folders = _folders(spark, root, version)
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
    held = read_version(spark, root, rows.schema, version)
    same = [*keys, content]
    changed = rows.join(held.select(*same).distinct(), same, "left_anti").withColumn("__bucket", bucket)
    gone = changed.select(*keys)
    if removed is not None:
        gone = gone.unionByName(removed.select(*keys)).distinct()
    touched = changed.select("__bucket")
    if removed is not None:
        touched = touched.unionByName(held.select(*keys).join(removed.select(*keys), list(keys), "left_semi").select(bucket.alias("__bucket")))
    numbers = sorted(r["__bucket"] for r in touched.distinct().collect())  # at most `buckets`
    if not numbers:
        return version, []
    old = [folders[b] for b in numbers if b in folders]
    kept = spark.read.schema(rows.schema).parquet(*old) if old else spark.createDataFrame([], rows.schema)
    kept = kept.join(gone, list(keys), "left_anti").withColumn("__bucket", bucket)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    # Each bucket's rows come from one task at a time, and an empty bucket has no folder.
    kept.unionByName(changed).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    filled = {r["__bucket"] for r in spark.read.schema("__bucket int").parquet(folder).distinct().collect()}
    now = {b: f for b, f in folders.items() if b not in numbers} | {b: f"{folder}/__bucket={b}" for b in filled}
    pointers = spark.createDataFrame(sorted(now.items()), _POINTERS)
    pointers.coalesce(1).write.mode("errorifexists").parquet(f"{root}/pointers/v{version + 1:08d}")
    return version + 1, numbers
