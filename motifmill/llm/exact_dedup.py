"""Exact dedup as a stateful stream.

A log of (digest, identifier, code points, content locator) is streamed through a keyed aggregation whose state
is in RocksDB and never expires. For each digest the state retains the identifier and locator of the best row so far and
the number of rows. The state is then read back, and every row whose digest was hit before has its full
bytes checked against those that the locator names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.written import drop
from .common import discard, fresh_path, materialise, small

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each store takes 4 MB of disk for its manifest at once, however small it is.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def log_of(docs: DataFrame, id_col: str, text_col: str, locator: Column, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(
        digest(norm).alias("digest"),
        F.col(id_col).cast("long").alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
        locator.alias("loc"),
    )


def ingest(log: DataFrame, state_dir: str) -> None:
    """Run the streaming log through the keyed state until nothing is left; call again to add later rows."""
    spark = log.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        # The larger the better: more code points, then the smaller identifier (~id falls as id grows), then the locator.
        rank = F.struct("chars", F.bitwise_not("id").alias("nid"), "loc")
        state = log.groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """digest, keep_id, keep_loc, n of every key in the state."""
    raw = spark.read.format("statestore").load(state_dir)
    best, n = (raw.schema["value"].dataType.names[k] for k in (0, 1))
    b = F.col("value")[best]
    return raw.select(F.col("key")["digest"].alias("digest"), F.bitwise_not(b["nid"]).alias("keep_id"), b["loc"].alias("keep_loc"), F.col("value")[n].alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", locator: Column | None = None, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> DataFrame:
    """id, loc, keep_id, group_size, kept and digest of each row of docs.

    Texts are equal when their bytes agree without blanks and control spaces; null counts as empty. Of equal texts the one with the
    most code points stays, then the smallest id (a null id is the largest), then the locator that sorts last, so exactly one row of a
    group is kept even if rows repeat. An empty table gives no rows. Other columns of docs are not looked at. ``locator`` must name a row
    uniquely (file and row number); without it the id does, and repeated ids then share their verdict. Rows that
    share a digest but not their bytes are told apart by the bytes themselves.
    """
    spark = docs.sparkSession
    loc = F.col(id_col) if locator is None else locator
    path = fresh_path(spark, "digest-log")
    log_of(docs, id_col, text_col, loc, digest).write.option("compression", "zstd").parquet(path)
    log = spark.read.parquet(path)
    state_dir = fresh_path(spark, "digest-state")
    stream = spark.readStream.schema(log.schema)
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream.option("maxBytesPerTrigger", 4 << 30)
    ingest(stream.parquet(path), state_dir)
    state = kept_state(spark, state_dir)
    # A hot digest holds many log rows and one state row: a plain join that AQE can split on the log's side.
    verdict = materialise(log.join(state, "digest"), "verdicts")
    drop(path)
    drop(state_dir)
    hits = verdict.where("n > 1").select("digest", "loc", "keep_loc")
    hits = materialise(hits.select("loc", "keep_loc", "digest"), "hits")
    texts = docs.select(loc.alias("loc"), normalised(F.col(text_col)).alias("norm")).join(small(hits), "loc")
    first = texts.where(F.col("loc").eqNullSafe(F.col("keep_loc"))).select("digest", F.col("norm").alias("keep_norm"))
    # One row for each digest against all of its rows: a plain join whose hot side AQE can split.
    differs = materialise(texts.join(first, "digest").where(F.col("norm") != F.col("keep_norm")).select("loc", "norm"), "collisions")
    clash = differs.limit(1).count() > 0
    discard(hits)
    out = verdict.select("id", "loc", "digest", "keep_id", F.col("n").alias("group_size"), F.col("loc").eqNullSafe(F.col("keep_loc")).alias("kept"))
    if not clash:
        return out
    # Different bytes under one digest: such digests are grouped by the bytes themselves.
    bad = differs.join(verdict.select("loc", "digest"), "loc").select("digest").distinct()
    rows = docs.select(loc.alias("loc"), normalised(F.col(text_col)).alias("norm")).join(verdict.join(bad, "digest", "left_semi").select("loc", "id", "chars", "digest"), "loc")
    rank = F.struct("chars", F.bitwise_not("id").alias("nid"), "loc")
    best = rows.groupBy("digest", "norm").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    again = rows.join(best, ["digest", "norm"]).select("id", "loc", "digest", F.bitwise_not(F.col("best.nid")).alias("keep_id"), "group_size", F.col("loc").eqNullSafe(F.col("best.loc")).alias("kept"))
    return out.join(bad, "digest", "left_anti").select(again.columns).union(again)
