"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds are found by their own pattern. Weak parts (identifiers, short or unlabelled secrets, endpoints) mean little alone: an
interval join within a document reports an identifier or a secret only near its complement, and an endpoint only near both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

# The base patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Weak parts.
IDENTIFIER = r"""(?i:(client_?id|user_?name|user|login|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
BEARER = r"(?i:(bearer|basic))\x20+([A-Za-z0-9+/_.=-]+)"
ENDPOINT = r"""(?i:(https?|postgres|mysql|mongodb|redis|amqp|s3))://([^\x20\x09-\x0D"'<>]+)"""
#: Kinds in the order they are listed at equal starts.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
#: Code points between the starts of parts that belong together.
SCOPE = 200
WEAK_IDENTIFIER = 3
WEAK_SECRET = 6
#: (kind of the scan, pattern, group whose length counts)
SCANS = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", r"[0-9a-f]{16,}", 0), ("identifier", IDENTIFIER, 2), ("bearer", BEARER, 2), ("endpoint", ENDPOINT, 2))


def _scan(kind: str, pattern: str, group: int) -> Column:
    """Matches in order as (kind, k, gap before the match, its length, the group's length). Positions follow by summing up."""
    # A text without a match costs one search; split and the groups are only evaluated on the others.
    found = F.col("t").rlike(pattern)
    length = lambda x: F.length(x)
    parts = F.arrays_zip(
        F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), length).alias("len"),
        F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(group)), length).alias("val"),
        F.transform(F.split("t", pattern, -1), length).alias("gap"),
    )
    rows = F.transform(parts, lambda p, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), p["gap"].alias("gap"), p["len"].alias("len"), p["val"].alias("val")))
    rows = F.filter(rows, lambda p: p["len"].isNotNull())
    return F.when(found, rows).otherwise(F.array().cast("array<struct<kind:string,k:int,gap:int,len:int,val:int>>"))


def parts_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(uid, id) of each row; (uid, kind, start, end, val) of each match. Written once, so that uid stays."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    scanned = t.select(F.monotonically_increasing_id().alias("uid"), "id", F.concat(*(_scan(*s) for s in SCANS)).alias("found"))
    scanned = materialise(scanned, "secret-parts")
    rows = scanned.where(F.size("found") > 0).select("uid", F.inline("found"))
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("uid", "kind").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return scanned.select("uid", "id"), rows.withColumn("end", end).select("uid", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "val")


def near(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Parts with one of others at most scope code points away: an interval join over cells of scope code points.

    A cell holds a bounded number of starts, and the semi join puts out no pair.
    """
    cells = others.select("uid", "start", F.explode(F.array(*(F.floor(F.col("start") / scope) + d for d in (-1, 0, 1)))).alias("cell")).alias("o")
    ours = parts.withColumn("cell", F.floor(F.col("start") / scope)).alias("p")
    on = (F.col("p.uid") == F.col("o.uid")) & (F.col("p.cell") == F.col("o.cell")) & (F.abs(F.col("p.start") - F.col("o.start")) <= scope)
    return ours.join(cells, on, "left_semi").drop("cell")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, base: array of (start, k, kind, end), added: the same for linked weak parts.

    A null text is empty; both arrays are then empty, as for a text without matches. Repeated rows each get their own result. Starts and ends
    are code points, end exclusive; spans that start at the same place are in the order of KINDS. An empty table gives no rows. Nothing outside id and text is read.
    """
    ids, parts = parts_of(docs, id_col, text_col)
    kept = {k: parts.where((F.col("kind") == k) & (F.col("val") >= n)) for k, n in LEAST.items()}
    base = kept["assign"].union(kept["access"]).union(kept["hex"])
    short = parts.where((F.col("kind") == "assign") & F.col("val").between(WEAK_SECRET, LEAST["assign"] - 1))
    weak_secret = short.union(parts.where((F.col("kind") == "bearer") & (F.col("val") >= WEAK_SECRET))).withColumn("kind", F.lit("weak_secret"))
    identifier = parts.where((F.col("kind") == "identifier") & (F.col("val") >= WEAK_IDENTIFIER))
    short_access = parts.where((F.col("kind") == "access") & F.col("val").between(8, LEAST["access"] - 1)).withColumn("kind", F.lit("identifier"))
    identifier = identifier.union(short_access)
    secrets = weak_secret.union(kept["assign"])
    identifiers = identifier.union(kept["access"])
    linked_secret = near(weak_secret, identifiers, scope)
    linked_identifier = near(identifier, secrets, scope)
    endpoint = parts.where(F.col("kind") == "endpoint")
    linked_endpoint = near(near(endpoint, identifiers, scope), secrets, scope)
    added = linked_secret.union(linked_identifier).union(linked_endpoint)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = base.withColumn("base", F.lit(True)).union(added.withColumn("base", F.lit(False))).select("uid", "base", F.struct("start", order.alias("k"), "kind", "end").alias("span"))
    lists = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("base"), F.col("span")))).alias("added"))
    none = F.array().cast(lists.schema["base"].dataType)
    return ids.join(lists, "uid", "left").select("id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def as_text(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
