"""Starting streams: settings, file replays, and bounded runs that end when the input is used up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.segments import row_numbers, time_slice
from palisade.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows of one file of an ordered replay.
BATCH_ROWS = 200_000


def configure_state(spark: SparkSession) -> None:
    """State on RocksDB: it spills to disk and checkpoints into the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def replay(spark: SparkSession, df: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A table as a file stream: its rows are written once and read back by readStream."""
    path = scratch_path(spark, "replay")
    df.write.parquet(path)
    return stream_folder(spark, path, df, files_per_batch)


def replay_in_order(
    spark: SparkSession, df: DataFrame, order: Sequence[str] = ("ts", "id"), rows_per_batch: int | None = None, files: int | None = None
) -> DataFrame:
    """A table as a file stream in `order` (a time first; nulls lead): each micro-batch holds at most `rows_per_batch` rows.

    Files are taken by the time they were written, so a batch is one parallel write of `files` files (one for a core, 16 at
    most, where not given), and batches are written one after the other.
    """
    files = files or min(spark.sparkContext.defaultParallelism, 16)
    most = rows_per_batch or BATCH_ROWS * files
    numbered = row_numbers(df.withColumn("__all", F.lit(0)), ["__all"], order, time_slice(order[0]), "__n").drop("__all")
    staged, path = scratch_path(spark, "replay-staged"), scratch_path(spark, "replay")
    numbered.withColumn("__batch", F.floor((F.col("__n") - 1) / most).cast("int")).drop("__n").write.partitionBy("__batch").parquet(staged)
    last = spark.read.schema(f"{order[1]} bigint, __batch int").parquet(staged).agg(F.max("__batch")).first()[0]
    for i in range(0 if last is None else last + 1):
        part = spark.read.schema(df.schema).parquet(f"{staged}/__batch={i}")
        # As many files each but for the last, so that a batch ends where the next begins.
        part.repartition(files).write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    if last is None:
        df.limit(0).write.parquet(path)
    return stream_folder(spark, path, df, files_per_batch=files)


def arrivals(spark: SparkSession, parts: list[DataFrame], files: int = 4) -> DataFrame:
    """Tables as a file stream that gets them one after the other: each is one micro-batch."""
    path = scratch_path(spark, "arrivals")
    for part in parts:
        # As many files each, so that a batch ends where the next table begins.
        part.repartition(files).write.mode("append").parquet(path)
    return stream_folder(spark, path, parts[0], files)


def stream_folder(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available into a written table, with its checkpoint in the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    running = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# A table, or what gives one once the tables before it are written.
Table = DataFrame | Callable[[], DataFrame]


def run_batches(stream: DataFrame, label: str, each: Callable[[DataFrame, int], dict[str, Table]], into: str | None = None) -> dict[str, DataFrame]:
    """Process everything available by micro-batches: `each` turns one into named tables, which are written and returned whole.

    A table's folder is named as it is, under `into` (a fresh one in the shared folder if not given); `follow` streams it on.
    A micro-batch writes to folders of its own number and replaces them, so one that runs again leaves no row twice.
    Before the first one, `each` is given an empty batch with number -1, for the columns of its tables.
    """
    spark = stream.sparkSession
    out, checkpoint = into or scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")

    def run(batch: DataFrame, number: int) -> None:
        # Several tables come from one pass over the stream's own work.
        held = batch.persist()
        for name, table in each(held, number).items():
            df = table() if callable(table) else table
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        held.unpersist()

    tables = each(spark.createDataFrame([], stream.schema), -1)
    if any(callable(t) for t in tables.values()):
        for frame in (t for t in tables.values() if not callable(t)):
            frame.write.format("noop").mode("overwrite").save()
    schemas = {name: (t() if callable(t) else t).schema for name, t in tables.items()}
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {name: _written(spark, f"{out}/{name}", schema) for name, schema in schemas.items()}


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What all micro-batches have written; nothing, where there was none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def follow(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A table of run_batches as a stream, in the order in which its micro-batches were written."""
    reader = spark.readStream.schema(like.schema).option("recursiveFileLookup", True)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def split_late(stream: DataFrame, ts: str, delay: str, into: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(on_time, late): rows that are newer than the newest of the micro-batches before theirs, less the delay, and the others.

    Spark drops late rows before a stateful step without a trace, and lets some through, as its watermark follows a
    batch behind. Put before such a step, this leaves none to chance: it splits every micro-batch by the query's own
    watermark, in milliseconds, and a step with the same delay that follows the folder `on_time` drops none of its rows. What
    the watermark follows from is written with the batches, so a restart or a repeated batch finds the same one. A
    row without a time is on time.
    """
    spark = stream.sparkSession
    clock = scratch_path(spark, "split-clock")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    marks = T.StructType([T.StructField("number", T.LongType()), T.StructField("newest", T.TimestampType())])

    def split(batch: DataFrame, number: int) -> dict[str, Table]:
        before = None
        if number > 0:
            seen = _written(batch.sparkSession, clock, marks).filter(F.col("number") < number)
            newest = F.date_trunc("millisecond", F.max("newest"))
            before = seen.agg((newest - F.expr(f"INTERVAL {delay}")).alias("t")).first()["t"]
        if number >= 0:
            # One row for each batch.
            batch.agg(F.lit(number).cast("long").alias("number"), F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{clock}/n{number}")
        late = F.lit(False) if before is None else F.coalesce(F.col(ts) <= F.lit(before), F.lit(False))
        return {"on_time": batch.filter(~late), "late": batch.filter(late)}

    out = run_batches(timed, "split", split, into)
    return out["on_time"], out["late"]
