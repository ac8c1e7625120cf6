"""Shared plumbing: the cluster's shared folder, written intermediates and bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import written
from ..plans.ship import ship

#: Bytes of rows that a broadcast side may have; every caller has another way beyond it.
BROADCAST_BYTES = 64 << 20
#: What a row takes besides its values.
ROW_BYTES = 32
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def fresh_path(spark: SparkSession, name: str) -> str:
    return written.fresh(spark, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives lost executors."""
    out, out._mm_path = written.write(df, name)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan still to be run reads."""
    for t in tables:
        written.drop(t._mm_path)


def _width(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, c[f.name]) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + _width(kind.elementType, x)), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> int:
    """Bytes of an (already written) table's rows in memory."""
    each = sum((_width(f.dataType, quoted(f.name)) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.sum(each)).collect()[0][0] or 0


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Hint a broadcast only if the (already written) side's rows have at most BROADCAST_BYTES."""
    return F.broadcast(df) if row_bytes(df) <= (BROADCAST_BYTES if most is None else most) else df


def quoted(name: str, of: str = "") -> Column:
    """The column of exactly this name (of an alias), whatever is in it."""
    return F.col(of + "`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kernel(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package on the executors. Batches of whole texts are kept small unless the session sets their size."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)
