"""Quality rules: a word-repetition base, a hashed n-gram log-likelihood ratio, and words that the trusted rows lack.

Every document gives hashed n-gram counts to the raw multinomial; documents of a trusted set also to the target. A document's
score is the mean of log(target/raw) over its n-grams, and a threshold on the score decides, for each document alike.
The n-grams are of the text's own bytes in small letters. The raw multinomial is smoothed by more than the target: it stands for whatever
might come in, so an n-gram that neither has seen speaks against a text, and one language's share in the trusted rows matters little.
Which single words a text has is judged besides: each word has a log-ratio of the documents with it in the target and in the raw corpus, and a
document whose lowest is below a threshold goes. Only a word that many documents have, and the target hardly any, can get there.
Both thresholds are found on labelled rows, each scored as if its own counts were not in the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.quantiles import quantiles
from ..plans.scan import AT, PART, in_ranges, row_numbers
from . import textkernel as K
from .common import discard, kernel, materialise, small

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Labelled rows whose thresholds are found at the driver; of more, by passes over all of them. Both give the same.
AT_DRIVER = 400_000
BUCKETS = 1 << 18
WIDTH = 4
#: Counts added to each bucket at the target's scale: of the target, and of the raw corpus.
SMOOTH = 0.5
RAW_SMOOTH = 1.5
#: n-grams with the trusted rows' mean ratio that every document is taken to have besides its own, so that a few rare n-grams don't reject a short text.
PRIOR_GRAMS = 50
#: The score's threshold at least, and where there are no rejected rows to find it with: texts unlike the good and the bad rows score below it.
THRESHOLD = -0.3
#: Words are runs of letters (any script) and digits in small letters; their hash's cell counts documents.
WORD_BUCKETS = 1 << 18
WORD_SMOOTH = 1.0
#: Share of the trusted rows that the words may reject, and their threshold at most.
WORD_LOSS = 0.002
WORD_THRESHOLD = -1.5


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_SMALL[ord("0") : ord("9") + 1] = ord("0")
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else ord(" ") for c in range(128)]


@dataclass
class Ratio:
    """log(target/raw) of each n-gram bucket and each word bucket, the trusted rows' mean, and the thresholds."""

    log_ratio: np.ndarray
    word_log_ratio: np.ndarray
    mean: float = 0.0
    threshold: float = THRESHOLD
    word_threshold: float = WORD_THRESHOLD

    def score(self, total: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return (total + PRIOR_GRAMS * self.mean) / (grams + PRIOR_GRAMS)


@dataclass
class Tally:
    """Counts of buckets in the raw corpus and in the trusted rows; the last cell of words counts documents."""

    raw: np.ndarray
    target: np.ndarray
    word_raw: np.ndarray
    word_target: np.ndarray

    def log_ratio(self, at: np.ndarray | slice, own: np.ndarray | int = 0, own_total: int = 0) -> np.ndarray:
        """own: counts of the judged row that are left out of the target."""
        n_raw, n_target = self.raw.sum(), self.target.sum() - own_total
        if n_target <= 0:  # nothing to compare with
            return np.zeros(len(self.raw[at]))
        return np.log((self.target[at] - own + SMOOTH) / (n_target * self.raw[at] / n_raw + RAW_SMOOTH))

    def word_log_ratio(self, at: np.ndarray | slice, own: int = 0) -> np.ndarray:
        n_raw, n_target = self.word_raw[-1], self.word_target[-1] - own
        if n_target <= 0:
            return np.zeros(len(self.word_raw[:-1][at]))
        return np.log((self.word_target[:-1][at] - own + WORD_SMOOTH) / (n_target * self.word_raw[:-1][at] / n_raw + WORD_SMOOTH))


def buckets(joined: K.Joined) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each WIDTH-gram of bytes in small letters inside a document, and its document."""
    h = K.window_hash(K.prefix_hash(_SMALL[joined.buf]), WIDTH)
    start = np.flatnonzero(_inside(joined, WIDTH)[: len(h)])
    return (h[start] & np.uint64(BUCKETS - 1)).astype(np.int64), joined.doc_of(start)


def word_buckets(joined: K.Joined) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of a document, once for a document, and the document."""
    buf = _LETTER[joined.buf]
    start, end = K.word_spans(buf)
    h = (K.span_hash(K.prefix_hash(buf), start, end) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    cell = np.unique(joined.doc_of(start) * WORD_BUCKETS + h)
    return cell % WORD_BUCKETS, cell // WORD_BUCKETS


def _inside(joined: K.Joined, width: int) -> np.ndarray:
    ok = np.zeros(len(joined.buf) + 1, np.int32)
    n = np.maximum(joined.size - width + 1, 0)
    np.add.at(ok, joined.start, n > 0)
    np.add.at(ok, joined.start + n, -(n > 0).astype(np.int32))
    return np.cumsum(ok)[:-1] > 0


def _labels(trusted: DataFrame, rejected: DataFrame | None, id_col: str) -> DataFrame:
    """id, good of every labelled id, written; an id in both is good."""
    ids = lambda df, good: df.select(F.col(id_col).alias("id"), F.lit(good).alias("good")).where("id is not null")
    rows = ids(trusted, True) if rejected is None else ids(trusted, True).union(ids(rejected, False))
    return materialise(rows.groupBy("id").agg(F.max("good").alias("good")), "labelled-ids")


def fit(docs: DataFrame, trusted: DataFrame, rejected: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", at_driver: int = AT_DRIVER) -> Ratio:
    """Counts of n-grams and of documents with a word over all of docs, and over those whose id is in trusted; thresholds from the rows of trusted and rejected.

    All labelled rows count; an id in both sets is trusted. Without trusted rows every ratio is 0, and all that the base keeps stays. Without
    rejected ones the score's threshold is THRESHOLD. Rows with a null id count for the raw corpus only, rows with a null text for nothing but its documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labels = _labels(trusted, rejected, id_col)
    known = small(labels)
    flagged = rows.join(known, "id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = BUCKETS + WORD_BUCKETS + 1  # n-grams, words, documents
        raw, target = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            texts, good = K.as_bytes(b["text"]), np.array([bool(x) for x in b["good"].to_pylist()], bool)
            for lo, hi in K.slices(texts):
                joined, ok = K.Joined(texts[lo:hi]), good[lo:hi]
                at, doc = buckets(joined)
                word, of = word_buckets(joined)
                for total, grams, words, n in ((raw, at, word, len(ok)), (target, at[ok[doc]], word[ok[of]], ok.sum())):
                    np.add.at(total, grams, 1)
                    np.add.at(total, BUCKETS + words, 1)
                    total[-1] += n
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])

    # One row for each of the cells at most comes to the driver.
    cells = kernel(flagged.select("text", "good"), count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS + WORD_BUCKETS + 1), np.zeros(BUCKETS + WORD_BUCKETS + 1)
    raw[cells.bucket], target[cells.bucket] = cells.raw, cells.target
    tally = Tally(raw[:BUCKETS], target[:BUCKETS], raw[BUCKETS:], target[BUCKETS:])
    ratio = Ratio(tally.log_ratio(slice(None)).astype(np.float32), tally.word_log_ratio(slice(None)).astype(np.float32))
    if not target[-1]:
        return ratio
    judged = materialise(kernel(rows.join(known, "id").select("text", "good"), _judge(tally, ratio), "good boolean, total double, grams long, low double"), "judged")
    if judged.count() > at_driver:
        ratio = _thresholds_by_passes(ratio, judged)
    else:
        local = judged.toPandas()
        ratio = _with_thresholds(ratio, local[local.good], local[~local.good])
    discard(labels, judged)
    return ratio


def _judge(tally: Tally, ratio: Ratio):
    """Sum of log ratios, n-grams and lowest word ratio of each labelled row that the base keeps; a good row's own counts are not in the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, good = K.as_bytes(b["text"]), b["good"].to_pylist()
            out = []
            for lo, hi in K.slices(texts):
                base = _score(pa.nulls(hi - lo, pa.int64()), texts[lo:hi], ratio)["base_failed"].to_pylist()
                joined = K.Joined(texts[lo:hi])
                at, doc = buckets(joined)
                word, of = word_buckets(joined)
                cut, word_cut = (np.searchsorted(x, np.arange(hi - lo + 1)) for x in (doc, of))
                for k in range(hi - lo):
                    if base[k]:
                        continue
                    g, w, ok = at[cut[k] : cut[k + 1]], word[word_cut[k] : word_cut[k + 1]], good[lo + k]
                    cell, n = np.unique(g, return_counts=True)
                    each = tally.log_ratio(cell, n * ok, len(g) * ok)
                    out.append((ok, float((each * n).sum()), len(g), float(tally.word_log_ratio(w, int(ok)).min(initial=0.0))))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.bool_(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["good", "total", "grams", "low"])

    return run


def _with_thresholds(ratio: Ratio, good, bad) -> Ratio:
    """The score's threshold parts good and bad rows with the least sum of both shares of errors, as near to the good ones as that allows, but not below THRESHOLD."""
    has = good[good.grams > 0]
    if not len(has):
        return ratio
    ratio.mean = float((has.total / has.grams).median())
    ok, low = np.sort(ratio.score(good.total.to_numpy(), good.grams.to_numpy())), np.sort(ratio.score(bad.total.to_numpy(), bad.grams.to_numpy()))
    if len(low):
        between = np.unique(np.concatenate([ok, low]))
        between = np.append(between[0] - 1.0, (between[1:] + between[:-1]) / 2)
        errors = np.searchsorted(ok, between) / len(ok) + 1 - np.searchsorted(low, between) / len(low)
        ratio.threshold = max(THRESHOLD, float(between[np.flatnonzero(errors <= errors.min() + 1e-12)[-1]]))
    words = np.sort(good.low.to_numpy())
    ratio.word_threshold = min(WORD_THRESHOLD, float(words[int(WORD_LOSS * len(words))]))
    return ratio


def _thresholds_by_passes(ratio: Ratio, judged: DataFrame) -> Ratio:
    """As _with_thresholds, of any number of rows: only the mean, the counts and the thresholds reach the driver."""
    middle = quantiles(judged.where("good and grams > 0").select((F.col("total") / F.col("grams")).alias("x")), "x", {"mean": 0.5}).collect()
    if not middle:
        return ratio
    ratio.mean = float(middle[0]["mean"])
    scored = materialise(judged.select("good", "low", ((F.col("total") + PRIOR_GRAMS * ratio.mean) / (F.col("grams") + PRIOR_GRAMS)).alias("v")), "scored")
    n_good, n_bad = scored.where("good").count(), scored.where("not good").count()
    if n_bad:
        # Errors of a threshold below each score: good rows before it and bad ones from it on.
        count = lambda c: F.sum(c.cast("long"))
        ranged = in_ranges(scored.groupBy("v").agg(count(F.col("good")).alias("ok"), count(~F.col("good")).alias("no")), "v")
        along, here = W.orderBy(PART), W.partitionBy(PART).orderBy(AT)
        earlier = along.rowsBetween(W.unboundedPreceding, -1)
        ranges = ranged.groupBy(PART).agg(F.sum("ok").alias("ok"), F.sum("no").alias("no"), F.max("v").alias("last"))  # one row a range
        carry = ranges.select(PART, F.sum("ok").over(earlier).alias("ok_before"), F.sum("no").over(earlier).alias("no_before"), F.lag("last").over(along).alias("last"))
        before = lambda c: F.coalesce(f"{c}_before", F.lit(0)) + F.sum(c).over(here) - F.col(c)
        at = F.coalesce((F.coalesce(F.lag("v").over(here), "last") + F.col("v")) / 2, F.col("v") - 1.0)
        errors = materialise(ranged.join(F.broadcast(carry), PART).select(at.alias("at"), (before("ok") / n_good + 1 - before("no") / n_bad).alias("errors")), "errors")
        least = errors.agg(F.min("errors")).collect()[0][0]
        ratio.threshold = max(THRESHOLD, float(errors.where(F.col("errors") <= least + 1e-12).agg(F.max("at")).collect()[0][0]))
        discard(errors)
    nth = row_numbers(scored.where("good").select("low", "v"), "low", "v").where(F.col("n") == int(WORD_LOSS * n_good) + 1)
    ratio.word_threshold = min(WORD_THRESHOLD, float(nth.collect()[0]["low"]))
    discard(scored)
    return ratio


def score_docs(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, llr and word_llr (the lowest ratio of its words, 0 without any) of each row.

    Null text counts as empty: no words, base_failed. Words are [^\\x20\\x09-\\x0D]+ and equal byte for byte. Texts below
    WIDTH bytes have the trusted rows' mean as llr. Each row is judged by itself, so repeated rows repeat their verdict. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = K.as_bytes(b["text"]), b["id"]
            for lo, hi in K.slices(texts):
                yield _score(ids.slice(lo, hi - lo), texts[lo:hi], ratio)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double, word_llr double"
    return kernel(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)


def keep(docs: DataFrame, ratio: Ratio, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and whatever their names. Null and empty texts go, as all with fewer than 10 words."""
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = K.as_bytes(b.column(k))
            for lo, hi in K.slices(texts):
                kept = _score(pa.nulls(hi - lo, pa.int64()), texts[lo:hi], ratio)["kept"]
                yield b.slice(lo, hi - lo).filter(kept)

    numbered = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))  # names may have any characters
    return kernel(numbered, run, numbered.schema).toDF(*docs.columns)


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _score(ids: pa.Array, texts: list[bytes], ratio: Ratio) -> pa.RecordBatch:
    n = len(texts)
    j = K.Joined(texts)
    _, _, h, doc = j.words()
    n_words = np.bincount(doc, minlength=n)
    chars = j.per_doc(~K.SPACE[j.buf] & ((j.buf & 0xC0) != 0x80))
    g, at = K.grams_in_docs(h, doc, 5)
    g = K.mix64(g + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int32)
    first = at[twice]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + 5, -1)
    repeat = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    bucket, of = buckets(j)
    grams = np.bincount(of, minlength=n)
    llr = ratio.score(np.bincount(of, ratio.log_ratio[bucket], minlength=n), grams)
    word, of = word_buckets(j)
    low = np.full(n, np.inf)
    np.minimum.at(low, of, ratio.word_log_ratio[word])
    low[np.isinf(low)] = 0.0
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    lines = np.fromiter(map(dup_lines, texts), np.int64, n)
    columns = [ids, n_words, chars, j.per_doc(SYMBOLS[j.buf]), lines, repeat, failed, ~failed & (llr >= ratio.threshold) & (low >= ratio.word_threshold), llr, low.astype(float)]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "word_llr"]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(np.asarray(x)) for x in columns[1:])], names=names)
