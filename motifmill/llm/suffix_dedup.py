"""Removal of repeated byte strings by column-wise suffix ordering.

Every window of ``length`` bytes chooses the ANCHOR-byte string in it with the smallest hash, so equal windows choose equal anchors
at the same place. A region is the stretch of windows that chose one anchor. Regions that occur more than once as a whole are
repeated without further ado. Where an anchor has regions that differ, they are aligned at the anchor and their suffixes are
ordered column by column (columnwise.py); neighbours with a common prefix of ``length`` show the windows that recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .columnwise import repeated_starts
from .common import discard, kernel, materialise, small

LENGTH = 400
#: Bytes of a text that are hashed at once; a longer text is taken in steps that overlap.
STEP = 1 << 20
#: Positions for which a place fits into the low bits of the compared keys.
CHUNK = 50_000
#: Regions ordered together, about; and the number of differing regions of one anchor beyond which their windows are counted by digest instead.
TOGETHER = 4096
HOT_REGIONS = 16_384


def choose(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of h[j : j + width] for each j, the first of equals."""
    n = len(h) - width + 1
    out = []
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        part = h[lo : hi + width - 1]
        key = (part & ~np.uint64(0xFFFF)) | np.arange(len(part), dtype=np.uint64)
        pad = -len(key) % width
        blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: hi - lo], before[width - 1 : width - 1 + hi - lo])
        out.append((least & np.uint64(0xFFFF)).astype(np.int64) + lo)
    return np.concatenate(out)


def regions(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor hash, region hash, anchor, first and last window start; every window start is in one region."""
    anchor = length // 2
    for base in range(0, max(len(text) - length + 1, 0), STEP):
        buf = np.frombuffer(text, np.uint8, min(STEP + length - 1, len(text) - base), base)
        prefix = K.prefix_hash(buf)
        h = K.window_hash(prefix, anchor) if len(buf) > anchor else np.zeros(0, np.uint64)
        h = np.append(h, K.span_hash(prefix, np.array([len(buf) - anchor]), np.array([len(buf)])))[: len(buf) - anchor + 1]
        at = choose(h, length - anchor + 1)
        lo = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        hi = np.append(lo[1:], len(at)) - 1
        yield h[at[lo]], K.span_hash(prefix, lo, hi + length), at[lo] + base, lo + base, hi + base


def _regions(texts: DataFrame, length: int) -> DataFrame:
    """anchor, region (hashes), t, p, lo, hi of each region of each text (t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[np.ndarray, ...]] = []
            n = 0
            for t, text in zip(b["t"].to_pylist(), K.as_bytes(b["text"]), strict=True):
                for r in regions(text, length):
                    held.append((*r, np.full(len(r[0]), t, np.int64)))
                    n += len(r[0])
                if n > 100_000:
                    yield _batch(held)
                    held, n = [], 0
            if held:
                yield _batch(held)

    return kernel(texts, run, "anchor long, region long, p long, lo long, hi long, t long")


def _batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, r, p, lo, hi, t = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), r.view(np.int64), p, lo, hi, t)], names=["anchor", "region", "p", "lo", "hi", "t"])


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """t, anchor, lo, n, left (bytes before the anchor), body of each wanted region. texts: t, text, wanted (array of anchor, p, lo, hi, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, text, wanted in zip(b["t"].to_pylist(), K.as_bytes(b["text"]), b["wanted"], strict=True):
                w = wanted.as_py()
                for k in range(0, len(w), 2000):
                    part = w[k : k + 2000]
                    columns = [[t] * len(part), [x["anchor"] for x in part], [x["lo"] for x in part], [x["n"] for x in part], [x["p"] - x["lo"] for x in part]]
                    body = pa.array([text[x["lo"] : x["hi"] + length] for x in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), body], names=["t", "anchor", "lo", "n", "left", "body"])

    return kernel(texts.select("t", "text", "wanted"), run, "t long, anchor long, lo long, n long, left long, body binary")


def _ordered(cut: DataFrame, groups: int, length: int) -> DataFrame:
    """t, lo, hi: window starts of regions that recur although the region as a whole does not."""

    def run(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        body, left = table["body"].to_pylist(), table["left"].to_numpy()
        flags, first = repeated_starts(body, -left, length)
        rows: list[tuple[int, int, int]] = []
        for i, (t, lo, n) in enumerate(zip(table["t"].to_pylist(), table["lo"].to_pylist(), table["n"].to_pylist(), strict=True)):
            starts = np.flatnonzero(flags[:, i]) + first + left[i] + lo if n == 1 else np.zeros(0, np.int64)
            if len(starts):
                edge = np.flatnonzero(np.diff(starts) > 1)
                rows += [(t, int(a), int(z)) for a, z in zip(starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["t", "lo", "hi"])

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return cut.withColumn("grp", F.pmod("anchor", F.lit(groups))).groupBy("grp").applyInArrow(run, "t long, lo long, hi long")


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many differing regions: windows counted by digest, which aggregates before it shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, lo, n, body in zip(b["t"].to_pylist(), b["lo"].to_pylist(), b["n"].to_pylist(), b["body"].to_pylist(), strict=True):
                prefix = K.prefix_hash(np.frombuffer(body, np.uint8))
                start = np.arange(len(body) - length + 1)
                h = K.span_hash(prefix, start, start + length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), t)), pa.array(start + lo), pa.array(np.full(len(h), n))], names=["w", "t", "at", "n"])

    windows = materialise(kernel(cut.select("t", "lo", "n", "body"), run, "w long, t long, at long, n long"), "windows")
    twice = windows.groupBy("w").agg(F.sum("n").alias("all")).where("all > 1").select("w")
    return windows.where("n = 1").join(twice, "w", "left_semi").select("t", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _removed(texts: DataFrame, length: int) -> DataFrame:
    """t, n_removed, n_spans, kept_sha256, kept of each text (t, text, spans: array of lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, text, spans in zip(b["t"].to_pylist(), K.as_bytes(b["text"]), b["spans"], strict=True):
                kept, end, n_removed, n_spans = [], 0, 0, 0
                last = -1
                for lo, hi in sorted((x["lo"], x["hi"] + length) for x in spans.as_py()):
                    if lo > last:  # a new run; one that only touches the last one belongs to it
                        kept.append(text[end:lo])
                        n_spans += 1
                        n_removed += hi - lo
                        last = end = hi
                    elif hi > last:
                        n_removed += hi - last
                        last = end = hi
                kept.append(text[end:])
                body = b"".join(kept)
                out.append((t, n_removed, n_spans, hashlib.sha256(body).hexdigest(), body))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["t", "n_removed", "n_spans", "kept_sha256", "kept"])

    return kernel(texts.select("t", "text", "spans"), run, "t long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and its remaining bytes (kept) if asked for.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in this or another row, so all copies of a
    text of that length lose everything. Null is empty; texts below ``length`` bytes stay as they are. A repeated row is a copy like
    any other. An empty table gives no rows. Texts are known by a 64-bit hash of their bytes, regions by one within their anchor's.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    rows = materialise(docs.select("id", "t", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    classes = rows.where(F.col("n_bytes") >= length).groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("rep"))
    classes = materialise(classes, "text-classes")
    # One row of each class: ids of further copies are taken out, unless they stand for another text.
    further = rows.where(F.col("n_bytes") >= length).join(classes.where("copies > 1"), "t").where("id != rep").select("id").distinct()
    copies_out = materialise(further.join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "further-copies")
    single = docs.where(F.octet_length("text") >= length).join(small(copies_out), "id", "left_anti").select("id", "t", "text")
    found = materialise(_regions(single.select("t", "text"), length), "regions")
    kinds = materialise(found.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "p", "lo", "hi")).alias("at")), "region-kinds")
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds")
    whole = found.join(kinds.where("n > 1").select("anchor", "region"), ["anchor", "region"], "left_semi").select("t", "lo", "hi")
    wanted = kinds.join(mixed, "anchor").select("at.t", F.struct("anchor", "at.p", "at.lo", "at.hi", "n").alias("w"))
    wanted = materialise(wanted.groupBy("t").agg(F.collect_list("w").alias("wanted")).join(classes.select("t", F.col("rep").alias("id")), "t"), "wanted-regions")
    n = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).collect()[0][0]
    cut = cut_all = materialise(_cut(single.join(small(wanted).drop("id"), "t"), length), "region-bytes")
    sizes = cut.groupBy("anchor").count()
    hot = materialise(sizes.where(F.col("count") > hot_regions).select("anchor"), "hot-anchors")
    spans = whole
    if hot.limit(1).count():
        spans = spans.union(_counted(cut.join(hot, "anchor", "left_semi"), length))
        cut = cut.join(hot, "anchor", "left_anti")
    if n:
        spans = spans.union(_ordered(cut, max(1, -(-n // TOGETHER)), length))
    spans = spans.join(classes.where("copies > 1").select("t"), "t", "left_anti")
    lists = materialise(spans.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).join(classes.select("t", F.col("rep").alias("id")), "t"), "spans")
    # Texts and their spans always meet by a shuffle: most texts of a large corpus have some.
    result = _removed(single.join(lists.drop("id"), "t"), length)
    result = materialise(result if with_text else result.drop("kept"), "removed")
    # What became of each text that lost something; all others stay as they are.
    gone = classes.where("copies > 1").select("t", F.lit(True).alias("gone"))
    info = materialise(gone.join(result, "t", "full"), "fates")
    discard(rows, classes, found, kinds, wanted, cut_all, hot, lists, result, copies_out)
    own = docs.select("id", "t", F.octet_length("text").cast("long").alias("n_bytes"), *(["text"] if with_text else []), *([] if with_text else [F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")]))
    # Texts always meet what became of them by a shuffle, at any size: the other side holds texts too.
    out = own.join(info if with_text else small(info), "t", "left")
    gone = F.coalesce("gone", F.lit(False))
    sha = F.sha2(F.encode("text", "UTF-8"), 256) if with_text else F.col("sha")
    columns = [
        "id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).when(F.col("kept_sha256").isNotNull(), F.col("kept_sha256")).otherwise(sha).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(gone, F.lit(b"")).when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.encode("text", "UTF-8")).alias("kept"))
    return out.select(*columns)
