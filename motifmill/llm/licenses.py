"""License scans: ordered signature rules over normalised words.

A text's words stand between blanks, so a pattern matches whole words. A rule is tried only on texts that hold its anchor and its key.
Detections are rows (rule, first word, end): one inside another goes, and of two neighbours that still overlap the one of lower priority goes.
Rules of BASE are never suppressed and suppress nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kernel, materialise, small
from .license_rules import Rule, rules

#: Words are runs of digits, letters and everything beyond ASCII; A-Z are lower-cased.
_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str) -> tuple[int, bytes]:
    """Number of words, and the words each with a blank before and behind it."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO).split()
    return len(words), b" " + b"  ".join(words) + b" " if words else b""


def spaced(pattern: str) -> str:
    """The pattern for normalised texts."""
    return f" (?:{pattern.replace(' ', '  ')}) "


@cache
def _compiled(found: tuple[Rule, ...]) -> tuple:
    return tuple((k, r.anchor.encode(), r.keys.encode().split(b"|"), re.compile(spaced(r.pattern).encode())) for k, r in enumerate(found))


def detections(words: bytes, found: tuple[Rule, ...]) -> Iterator[tuple[int, int, int]]:
    """(rule, first word, end) of every match, leftmost first and not overlapping within a rule."""
    held: dict[bytes, bool] = {}

    def holds(part: bytes) -> bool:
        if part not in held:
            held[part] = part in words
        return held[part]

    for k, anchor, keys, pattern in _compiled(found):
        if holds(anchor) and any(map(holds, keys)):
            at = last = 0
            for m in pattern.finditer(words):
                at += words.count(b" ", last, m.start())
                last = m.start()
                yield k, at // 2, at // 2 + m.group().count(b" ") // 2


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: tuple[Rule, ...] | None = None) -> DataFrame:
    """id, n_words, hits: array of (rule, start, end). Null texts are empty."""
    found = rules() if found is None else found
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hits = [], []
            for t in b["t"]:
                count, words = normalised(t.as_py())
                n.append(count)
                hits.append([{"rule": k, "start": s, "end": e} for k, s, e in detections(words, found)])
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))], names=["id", "n_words", "hits"])

    t = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    return kernel(t, run, f"id {kind}, n_words bigint, hits array<struct<rule:int,start:bigint,end:bigint>>")


def kept(hits: DataFrame) -> DataFrame:
    """uid, rule, start, end of hits (uid, rule, start, end, priority) that nothing suppresses.

    One that lies inside another (or at the same place as one of better priority) goes. What stays has ascending starts and ends; of two
    neighbours that overlap, the one of lower priority goes, of equal ones the later.
    """
    order = W.partitionBy("uid").orderBy("start", F.desc("end"), "priority", "rule")
    inside = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) >= F.col("end")
    outer = hits.where("priority >= 0").withColumn("inside", F.coalesce(inside, F.lit(False))).where("not inside")
    along = W.partitionBy("uid").orderBy("start")
    before, after = (lambda c: F.lag(c).over(along)), (lambda c: F.lead(c).over(along))
    lost = (before("end") > F.col("start")) & (before("priority") <= F.col("priority")) | (after("start") < F.col("end")) & (after("priority") < F.col("priority"))
    return outer.withColumn("lost", F.coalesce(lost, F.lit(False))).where("not lost").select("uid", "rule", "start", "end")


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: tuple[Rule, ...] | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row for each row of docs.

    n_base places of BASE phrases, from first_word to last_word (starts, null without one); labels of BASE and of all detections that stay, sorted; score is the
    confidence of the surest of them, 0 without any; spans are (start, end, label) in order. A null text is empty and has no words; repeated rows
    each have their own result. Texts of any length are taken whole. An empty table gives no rows; columns besides id and text are not read.
    """
    found = rules() if found is None else found
    spark = docs.sparkSession
    scanned = materialise(scan(docs, id_col, text_col, found).withColumn("uid", F.monotonically_increasing_id()), "license-hits")
    known = F.broadcast(spark.createDataFrame([(k, r.label, r.priority, r.confidence) for k, r in enumerate(found)], "rule int, label string, priority int, confidence double"))  # one row a rule
    hits = materialise(scanned.where(F.size("hits") > 0).select("uid", F.inline("hits")).join(known, "rule"), "license-detections")
    base = hits.where("priority < 0").withColumn("base", F.lit(True))
    added = kept(hits).join(known, "rule").withColumn("base", F.lit(False))
    columns = ("uid", "base", "start", "end", "label", "confidence")
    stay = base.select(*columns).union(added.select(*columns))
    own = F.when(F.col("base"), F.col("start"))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    by_doc = stay.groupBy("uid").agg(F.count(own).alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"), labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("confidence").alias("score"), F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    by_doc = materialise(by_doc, "license-labels")
    out = scanned.select("uid", "id", "n_words").join(small(by_doc), "uid", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    none = F.array().cast(by_doc.schema["spans"].dataType)
    return out.select("id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", text("base_labels"), text("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"))

