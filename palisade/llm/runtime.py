"""Session settings of the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import configure

# Texts may be long: a batch that goes to a Python worker is bounded by bytes, not only by rows.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def pack_columns(docs: DataFrame, *working: str) -> DataFrame:
    """The working columns, and all others in one struct `own`: an operator's own column names never meet the caller's."""
    rest = [c for c in docs.columns if c not in working]
    own = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(*working, own.alias("own"))


def unpack_columns(packed: DataFrame, columns: Sequence[str], *added: str, **changed: Column) -> DataFrame:
    """The caller's columns as they were, but for changed ones, and then the added ones, which replace columns of their name."""
    own = set(packed.schema["own"].dataType.fieldNames())

    def value(name: str) -> Column:
        if name in changed:
            return changed[name]
        return F.col("own").getField(name) if name in own else F.col(name)

    return packed.select(*[value(c).alias(c) for c in columns if c not in added], *added)


def hide_columns(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns of these names, if it has any, under free ones, and how to name them back."""
    used, clash = {c.lower() for c in docs.columns}, {}
    for column in docs.columns:
        if column.lower() in {n.lower() for n in names}:
            free = f"{column}_"
            while free.lower() in used:
                free += "_"
            used.add(free.lower())
            clash[column] = free
    return docs.withColumnsRenamed(clash), {free: column for column, free in clash.items()}
