"""Packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt into groups by a hash; rows that repeat more often than a group has documents are dealt out by their input partition as well. In a group every document is cut into full sequences and a rest; rests are packed by
first-fit decreasing, where a tournament tree over the bins' free room finds the first bin that fits in logarithmic time. What is
left open is closed by cutting up the emptiest bins, so a group has one unfilled sequence at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kernel, materialise, small

LENGTH = 1024
#: Documents of a group, on average; a group that turns out larger than twice that, or than GROUP_TOKENS, is closed and continued as another.
GROUP_DOCS = 2000
GROUP_TOKENS = 8_000_000
#: Groups that a task gets, on average.
TASK_GROUPS = 8
#: Bits of a sequence's number that count sequences of a part, and parts of a group.
SEQUENCE_BITS, PART_BITS = 21, 17
Piece = tuple[int, int, int]  # document in the group, start, length


class Tournament:
    """Free room of bins in a complete tree; each node knows the largest below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        k, most = 1, self.most
        while k < self.leaves:
            k *= 2
            if most[k] < need:
                k += 1
        return k - self.leaves

    def take(self, leaf: int, n: int) -> None:
        k, most = leaf + self.leaves, self.most
        most[k] -= n
        k //= 2
        while k:
            best = max(most[2 * k], most[2 * k + 1])
            if most[k] == best:
                break
            most[k] = best
            k //= 2


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each bin; ties by item."""
    tree = Tournament(len(sizes), length)
    bins: list[list[int]] = [[] for _ in sizes]
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = tree.first_fit(sizes[item])
        bins[at].append(item)
        tree.take(at, sizes[item])
    return [b for b in bins if b]


def pack_group(sizes: list[int], length: int = LENGTH) -> list[list[Piece]]:
    """Pieces of each sequence, in their order."""
    full, rest = [], []
    for doc, n in enumerate(sizes):
        cut = n - n % length
        full += [[(doc, s, length)] for s in range(0, cut, length)]
        if n > cut:
            rest.append((doc, cut, n - cut))
    packed = [[rest[k] for k in b] for b in first_fit_decreasing([n for _, _, n in rest], length)]
    fill = [sum(n for _, _, n in b) for b in packed]
    open_ = sorted((k for k in range(len(packed)) if fill[k] < length), key=lambda k: (-fill[k], k))
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        to, frm = open_[lo], open_[hi]
        doc, start, n = packed[frm].pop()
        moved = min(n, length - fill[to])
        packed[to].append((doc, start + n - moved, moved))
        if moved < n:
            packed[frm].append((doc, start, n - moved))
        fill[to] += moved
        fill[frm] -= moved
        lo += fill[to] == length
        hi -= fill[frm] == 0
    return full + [b for b in packed if b]


def pack(docs: DataFrame, encode: Callable[[list[str]], list[np.ndarray]], end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = 0, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its ids if asked for.

    ``encode`` runs on the executors. Every document ends with end_id, so a null or empty text is one token. Rows are packed each by itself,
    also if they repeat or share an id. Groups follow from seed, id and text (and the input partition of rows that repeat more than ``group_docs``
    times), so a task that runs again gives the same pieces. An empty table gives no rows. Columns other than id and text are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", F.substring("text", 1, 64), F.octet_length("text")))
    repeats = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    n, most = repeats.agg(F.sum("n"), F.max("n")).collect()[0]
    groups = max(1, -(-(n or 0) // group_docs))
    deal = F.col("h")
    if (most or 0) > group_docs:
        often = materialise(repeats.where(F.col("n") > group_docs).select("h", F.lit(True).alias("often")), "often-repeated")
        rows = rows.withColumn("part", F.spark_partition_id()).join(small(often), "h", "left")
        deal = F.when(F.col("often"), F.xxhash64("h", "part")).otherwise(deal)
    rows = rows.select("id", "text", "h", F.pmod(deal, F.lit(groups)).alias("grp"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // TASK_GROUPS))
    rows = rows.repartition(tasks, "grp").sortWithinPartitions("grp", "h", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        toks: list[np.ndarray] = []
        held = part = 0
        now = None
        for b in batches:
            grp, doc = b["grp"].to_pylist(), b["id"].to_pylist()
            for lo in range(0, len(grp), 256):
                texts = b["text"].slice(lo, 256).to_pylist()
                for g, d, e in zip(grp[lo : lo + 256], doc[lo : lo + 256], encode(texts), strict=True):
                    if ids and (g != now or len(ids) >= 2 * group_docs or held > GROUP_TOKENS):
                        yield _pieces(ids, toks, now, part, length, with_ids)
                        part = part + 1 if g == now else 0
                        ids, toks, held = [], [], 0
                    now = g
                    e = np.append(e, np.uint32(end_id)).astype("<u4")
                    ids.append(d)
                    toks.append(e)
                    held += len(e)
        if ids:
            yield _pieces(ids, toks, now, part, length, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return kernel(rows.select("id", "text", "grp"), run, schema + ", ids array<int>" * with_ids)


def _pieces(ids: list, toks: list[np.ndarray], group: int, part: int, length: int, with_ids: bool) -> pa.RecordBatch:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    cut = []
    if part >> PART_BITS:
        raise OverflowError("too many rows in one group: use smaller ones")
    first = ((group << PART_BITS) + part) << SEQUENCE_BITS
    for k, pieces in enumerate(pack_group([len(t) for t in toks], length)):
        offset = 0
        for doc, start, n in pieces:
            piece = toks[doc][start : start + n]
            row = (ids[doc], start, n, zlib.crc32(piece), len(toks[doc]), first + k, offset)
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)
            offset += n
            if with_ids:
                cut.append(piece.astype(np.int32))
    columns = [pa.array(c, pa.int64()) for c in out.values()]
    if with_ids:
        columns.append(pa.array(cut, pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=[*out, *(["ids"] if with_ids else [])])
