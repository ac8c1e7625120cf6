"""Spelling variant grouping: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter: whether it occurs an odd number of times. An inserted or deleted letter flips one bit, a replaced one
two or none. The mask is split into three bands, so one band at least stays as it is:

- lengths differ by one: one flip, so two bands are equal;
- equal lengths, both flips in one band: the two others are equal;
- equal lengths, no flip: all three are equal;
- equal lengths, flips in two bands: the third is equal and the number of odd letters in each of the two changes its parity.

Words are joined on (case, equal bands, length); the join's condition counts the flips of the rest, then compares the words themselves. Each
pair of near words falls into one case and is made once. Letters are dealt to the bands so that each band tells as many words apart as the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small

# What a run of letters is, which runs lose a letter, what counts as a word and as a variant.
LETTERS = r"A-Za-zÀ-ÿ"
DROPPED = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
BANDS = 3
#: Bytes of rows of forms that a round of roots() broadcasts.
ROOT_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int = DROPPED) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lower-cased, of least_length code points that occur least_count times or more.

    Of a run whose crc32 with its document's id is divisible by dropped, one letter is left out. Null texts have no words, a null id is empty;
    repeated rows count each time. Counts are added up in each task first.
    """
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return each.select(F.when(h % dropped == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def letter_bands(vocabulary: DataFrame) -> dict[str, tuple[int, int]]:
    """Band and bit of each letter: letters by how well their parity tells words apart, each to the band that has least so far. One row a letter of the alphabet (90 of them) comes to the driver."""
    total = vocabulary.count()
    letters = vocabulary.select(F.explode(F.filter(F.array_distinct(F.split("word", "")), lambda c: (F.length("word") - F.length(F.replace("word", c, F.lit("")))) % 2 == 1)).alias("letter"))
    gain = {}
    for r in letters.groupBy("letter").count().collect():
        p = r["count"] / total
        gain[r.letter] = -sum(x * math.log2(x) for x in (p, 1 - p) if x > 0)
    held, bits, out = [0.0] * BANDS, [0] * BANDS, {}
    for letter in sorted(gain, key=lambda c: (-round(gain[c], 12), c)):
        b = min(range(BANDS), key=lambda k: (round(held[k], 12), k))
        out[letter] = (b, bits[b])
        held[b] += gain[letter]
        bits[b] += 1
    return out


def masks(vocabulary: DataFrame) -> DataFrame:
    """word, n, len, b0 to b2: the parity mask's bands. Letters that are always even have no bit: they flip none."""
    of = letter_bands(vocabulary)
    parity = lambda c: (F.length("word") - F.length(F.replace("word", F.lit(c), F.lit("")))) % 2
    band = lambda k: sum((F.shiftleft(parity(c).cast("long"), bit) for c, (b, bit) in sorted(of.items()) if b == k), F.lit(0).cast("long"))
    return vocabulary.select("word", "n", F.length("word").alias("len"), *(band(k).alias(f"b{k}") for k in range(BANDS)))


def _signature(case: int, x: Column, y: Column, length: Column, r1: Column, r2: Column) -> Column:
    names = ("case", "x", "y", "size", "r1", "r2")
    return F.struct(*(c.cast("long").alias(n) for c, n in zip((F.lit(case), x, y, length, r1, r2), names, strict=True)))


def _sides() -> tuple[Column, Column]:
    """Signatures of a word as the left and as the right one of a pair. r1 and r2 are what must differ in two bits."""
    b = [F.col(f"b{k}") for k in range(BANDS)]
    odd = [F.bit_count(x) % 2 for x in b]
    n, zero = F.col("len"), F.lit(0)
    left, right = [], []
    for k in range(BANDS):
        i, j = (x for x in range(BANDS) if x != k)
        same_band = _signature(k, b[i], b[j], n, b[k], zero)
        left.append(same_band)
        right.append(same_band)
        # One flip: a constant makes up the second bit.
        left.append(_signature(4 + k, b[i], b[j], n, b[k], zero))
        right.append(_signature(4 + k, b[i], b[j], n - 1, b[k], F.lit(1)))
        # One flip in i and one in j; the left word is the one with an even band i.
        two = lambda of_j, k=k, i=i, j=j: _signature(8 + k, b[k], of_j, n, b[i], b[j])
        left.append(F.when(odd[i] == 0, two(odd[j])))
        right.append(F.when(odd[i] == 1, two(1 - odd[j])))
    left.append(_signature(3, b[0], b[1], n, b[2], zero))
    right.append(_signature(3, b[0], b[1], n, b[2], F.lit(3)))
    return (F.filter(F.array(*side), lambda s: s.isNotNull()) for side in (left, right))


def near_pairs(masked: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words that differ by one inserted, deleted or replaced letter, once.

    A plain equi-join, so Spark can split a bucket that many words share; only verified pairs leave it. It is always a shuffle: Spark takes the
    signatures, eight or so a word, for hardly larger than the words' small file, and would collect all of them at the driver to broadcast them.
    """
    left, right = _sides()
    key = ("case", "x", "y", "size")
    side = lambda sig, name: masked.select("word", "n", F.inline(sig)).select(*(F.col(c).alias(f"{name}_{c}") for c in (*key, "word", "n", "r1", "r2")))
    flips = F.bit_count(F.col("a_r1").bitwiseXOR(F.col("b_r1"))) + F.bit_count(F.col("a_r2").bitwiseXOR(F.col("b_r2"))) == 2
    once = (F.col("a_case") >= BANDS + 1) | (F.col("a_word") < F.col("b_word"))
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in key]
    pairs = side(left, "a").join(side(right, "b").hint("merge"), [*on, flips, once, F.levenshtein("a_word", "b_word", 1) == 1])
    return pairs.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms ends, by doubling. Each step is FACTOR times as frequent, so there are few rounds."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = materialise(now.join(small(up, ROOT_BYTES), now.root == up.via, "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, **kw) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of words().

    form: the most frequent word that is one edit away (the first in code-point order among equals), if it is factor times as frequent; root: the end of the
    chain of forms, the word itself without one; n_near: number of words one edit away. Empty tables give no rows; other columns are not read.
    """
    vocabulary = materialise(words(docs, id_col, text_col, **kw), "vocabulary")
    masked = materialise(masks(vocabulary), "masks")
    pairs = near_pairs(masked)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select("b", "a", "a_n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), "other")).alias("best"))
    known = vocabulary.join(near, "word", "left")
    enough = -F.col("best.order") >= factor * F.col("n")
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")), "spelling-forms")
    ends = roots(known.where("form is not null"))
    out = known.join(ends, "word", "left")
    discard(vocabulary, masked)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
