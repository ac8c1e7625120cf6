"""Token-id files: Parquet list columns in id order, with dictionary or delta encoding, controlled row groups and page indexes.

Ids of small vocabularies are dictionary-encoded and bit-packed, identifiers and counts delta-encoded (format version 2). Small
pages with a column index let a reader of some documents touch their pages only, and a reader of metadata none of the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kernel

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
#: Rows of a page, so that the page index is fine enough for single documents.
PAGE_ROWS = 2000


def write_ids(docs: DataFrame, path: str, encode: Callable[[list[str]], list[np.ndarray]], end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write (doc_id, n_tokens, ids) in ascending id order, over all files and in each.

    A null or empty text is end_id alone. A null id comes first. Rows that share an id follow each other by text. An empty table
    gives a folder without rows. Texts are dealt out by range before they are encoded, so that sampling for the ranges encodes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                toks = [np.append(e, np.uint32(end_id)).astype(np.int32) for e in encode(part["text"].to_pylist())]
                size = np.fromiter(map(len, toks), np.int32, len(toks))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(toks)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size), ids], names=["doc_id", "n_tokens", "ids"])

    out = kernel(rows, run, "doc_id long, n_tokens int, ids array<int>").write
    options = {"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0"}
    out.options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids; a reader of fewer columns or of an id range reads only those columns and pages."""
    return spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path)


def checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it over all files), n_tokens, ids_crc32, all from the files."""
    rows = read_ids(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            crc = [zlib.crc32(flat[i:j].astype("<u4")) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["file"], b["at"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    slim = kernel(rows, run, "doc_id long, file string, at long, n_tokens long, ids_crc32 long")
    # Files hold disjoint ranges of ids: a running total over files (one row each), then inside each file.
    meta = read_ids(spark, path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"))
    files = meta.groupBy("file").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("low"), F.sum("n_tokens").alias("n"))
    ahead = files.select("file", F.coalesce(F.sum("n").over(W.orderBy("low", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return slim.join(F.broadcast(ahead), "file").select("doc_id", (F.col("ahead") + inside).alias("start"), "n_tokens", "ids_crc32")
