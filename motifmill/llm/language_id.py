"""Language identification by bit-sliced Bloom filters of character n-grams.

Every position of the filter holds one bit for each language, so the AND over an n-gram's positions returns all languages that
contain it. A text's hits of each language, corrected for that language's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import kernel

#: Labelled rows of each language that the filters are fitted on, at most (those with the smallest hash).
ROWS_A_LANGUAGE = 3000
#: n-grams in less than this share of a language's sampled rows are left out (in fewer than two of 3,000).
LEAST_SHARE = 1 / 2000
WIDTH = 4
SLOTS = 1 << 20
HASHES = 3
UNKNOWN = "und"


@dataclass
class Filters:
    languages: list[str]
    planes: np.ndarray  # (planes, SLOTS) uint64; language k is bit k % 64 of plane k // 64
    false_positive: np.ndarray  # by language
    common: int = 0  # the language with most labelled rows, the first by name of equals


def code_grams(text: str) -> np.ndarray:
    """Hashes of the WIDTH-grams over lower-cased letters, with one blank for each run of anything else."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(code)
    keep = letter | np.concatenate([[True], letter[:-1]])
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    return K.gram_hash(code * np.uint64(0x9E3779B97F4A7C15), WIDTH)


_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _letters(code: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(code, 0x2FFF)]
    high = code >= 0x3000
    if high.any():
        out = out.copy()
        out[high] = [chr(c).isalpha() for c in code[high]]
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def slots(grams: np.ndarray) -> list[np.ndarray]:
    a, b = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def measured(languages: list[str], planes: np.ndarray, common: int = 0) -> Filters:
    """False positives are the share of a language's set bits to the power HASHES."""
    fill = [np.count_nonzero(planes[k // 64] & np.uint64(1 << k % 64)) / SLOTS for k in range(len(languages))]
    return Filters(languages, planes, np.array(fill) ** HASHES, common)


def build(grams: dict[str, np.ndarray]) -> Filters:
    """grams: by language."""
    languages = sorted(grams)
    planes = np.zeros(((len(languages) + 63) // 64 or 1, SLOTS), np.uint64)
    for k, lang in enumerate(languages):
        for at in slots(grams[lang]):
            planes[k // 64][at] |= np.uint64(1 << k % 64)
    return measured(languages, planes)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learn from rows with a language and a text. The sample is by a hash of the id, ROWS_A_LANGUAGE a language at most in expectation (all rows
    without an id are one draw). Rows that repeat count as often as they are there. No labelled rows give a filter without languages."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # one row a language
    known = {r["lang"]: r["rows"] for r in sizes.collect()}
    languages = sorted(known)
    if not languages:
        return measured([], np.zeros((1, SLOTS), np.uint64))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * ROWS_A_LANGUAGE / F.col("rows")
    sample = rows.join(F.broadcast(sizes), "lang").where(share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                found.setdefault(lang, []).append(np.unique(code_grams(text)))
            for lang, parts in found.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.searchsorted(languages, b["lang"].to_pylist())
            bit = np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)).view(np.int64)
            for at in slots(b["gram"].to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(k // 64), pa.array(at), pa.array(bit)], names=["plane", "slot", "bits"])

    counts = kernel(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*(F.lit(x) for lang, n in known.items() for x in (lang, LEAST_SHARE * min(n, ROWS_A_LANGUAGE))))
    kept = counts.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram")
    # SLOTS rows a plane at most come to the driver.
    cells = kernel(kept, place, "plane long, slot long, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    planes = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
    planes[cells.plane, cells.slot] = cells.bits.to_numpy(np.int64).view(np.uint64)
    return measured(languages, planes, max(range(len(languages)), key=lambda k: (known[languages[k]], -k)))


def decide(hits: np.ndarray, n: int, filters: Filters) -> tuple[str, float]:
    """Language and score from the hits of each language among n grams; the first by name of equals, the common one with score 0 without any."""
    # hits = true + (n - true) * fp
    true = np.clip((hits - n * filters.false_positive) / (1 - filters.false_positive), 0, n)
    best = int(np.argmax(true))
    if not true[best]:
        return filters.languages[filters.common], 0.0
    rest = np.partition(true, -2)[-2] if len(true) > 1 else 0.0
    return filters.languages[best], float(0.5 + 0.5 * (true[best] - rest) / max(true[best], 1))


def predict_text(text: str | None, filters: Filters) -> tuple[str, float]:
    if not text or not filters.languages or not has_letter(text):
        return UNKNOWN, 0.0
    g = code_grams(text)
    if not len(g):
        g = code_grams(f" {text}   ")
    at = slots(g)
    hits = np.zeros(len(filters.languages))
    for p, plane in enumerate(filters.planes):
        mask = plane[at[0]]
        for x in at[1:]:
            mask = mask & plane[x]
        for k in range(min(64, len(filters.languages) - 64 * p)):
            hits[64 * p + k] = np.count_nonzero(mask & np.uint64(1 << k))
    return decide(hits, len(g), filters)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row; `und` and 0 for a null text or one without a letter. Reads id and text only.

    Each row is judged by itself, so repeated rows repeat their prediction. Of languages with the same count the first by name is taken; a text without a
    known n-gram gets the most common language with score 0. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [predict_text(t.as_py(), filters) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return kernel(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double")
