"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Each round inserts one symbol of every document, from the last column to the first. The transform of a round holds, for the round's
suffixes in their order, the symbol before each. These are the first symbols of the next round's suffixes, so a stable sort of the transform
maps one order to the next, and where two neighbours have the same symbol, their common prefix is one more than the
least one between the suffixes they extend. Columns are read from one file and the transform and prefixes
appended to another, both sequentially, so a round needs the one before only. The files of a group of regions are bounded by its size
and kept in memory, as executors share no local folder and should use none.

Only suffixes that start in the same column are ever compared, so the transform is kept by column and not merged over them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np


def write_columns(docs: list[bytes], at: np.ndarray, first: int, last: int, file) -> None:
    """Column u of document i is docs[i][u - at[i]] + 1, or 0 outside of it; from column last - 1 down to first."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(docs), np.uint8)
    for u in range(last - 1, first - 1, -1):
        k = u - at
        inside = (k >= 0) & (k < size)
        column = np.zeros(len(docs), np.uint16)
        column[inside] = flat[(start + k)[inside]].astype(np.uint16) + 1
        file.write(column.tobytes())


def rounds(columns, n_docs: int, n_columns: int, out) -> None:
    """Append (symbol before, document, common prefix with the one before) of each round's suffixes in order."""

    def column() -> np.ndarray:
        return np.frombuffer(columns.read(2 * n_docs), np.uint16)

    order = np.arange(n_docs, dtype=np.int32)
    lcp = np.zeros(n_docs + 1, np.uint16)
    columns.seek(0)
    bwt = column()
    for left in range(n_columns - 1, -1, -1):
        perm = np.argsort(bwt, kind="stable")
        x = bwt[perm]
        same = np.flatnonzero((x[1:] == x[:-1]) & (x[1:] > 0)) + 1
        new = np.zeros(n_docs + 1, np.uint16)
        if len(same):
            # The least of lcp over (perm[k - 1], perm[k]].
            cut = np.column_stack([perm[same - 1] + 1, perm[same] + 1]).ravel()
            new[same] = np.minimum.reduceat(lcp, cut)[::2] + 1
        order, lcp = order[perm], new
        bwt = column()[order] if left else np.zeros(n_docs, np.uint16)
        out.write(bwt.tobytes())
        out.write(order.tobytes())
        out.write(lcp[:n_docs].tobytes())


def transform(out, n_docs: int, n_columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Read back each round's symbols before, documents and common prefixes."""
    out.seek(0)
    for _ in range(n_columns):
        symbol = np.frombuffer(out.read(2 * n_docs), np.uint16)
        doc = np.frombuffer(out.read(4 * n_docs), np.int32)
        yield symbol, doc, np.frombuffer(out.read(2 * n_docs), np.uint16)


def repeated_starts(docs: list[bytes], at: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Flags (column, document) of the aligned starts whose next ``length`` symbols are those of another document, and the first column.

    at[i] is the column of docs[i][0]. Only equal columns are compared, so documents must be aligned where they can agree.
    """
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    first, last = int(at.min()), int((at + size).max())
    flags = np.zeros((last - first, len(docs)), bool)
    with io.BytesIO() as columns, io.BytesIO() as out:
        write_columns(docs, at, first, last, columns)
        rounds(columns, len(docs), last - first, out)
        for u, (_, doc, lcp) in enumerate(transform(out, len(docs), last - first)):
            with_before = lcp >= length
            with_after = np.append(with_before[1:], False)
            flags[last - first - 1 - u, doc[with_before | with_after]] = True
    return flags, first
