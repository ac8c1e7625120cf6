"""From documents to packed sequences: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents. Other
columns of any name and type go along unread. Empty tables give empty ones, texts of any length are taken whole, and no stage
drops a row because its id is null or shared. What else holds for nulls, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.llm import jaccard_join, line_dedup, mixing, packing, quality
from motifmill.llm import queries as Q
from motifmill.llm.common import discard, documents, free_name, materialise, quoted, small

#: Chunks whose ids a worker remembers in packing; workers of the stages before still hold memory then.
KNOWN_CHUNKS = 1 << 17
#: Share of the remaining tokens that the mixture is cut to.
BUDGET_SHARE = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts (without ten words) among them. Repeated rows share their fate."""
    return quality.keep(docs, quality.fit(docs, Q.trusted(spark, sf_dir), Q.rejected(spark, sf_dir)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated passages go from the texts; n_chars follows. All rows stay, those with null or empty texts as they are.

    Of equal passages the one in the row with the smallest id (null first) stays; of repeated rows one is the first.
    """
    out = line_dedup.line_dedup(docs)
    n_chars = F.when(quoted(out.columns[-1]).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.select(*(n_chars.alias(c) if c == "n_chars" else quoted(c) for c in docs.columns))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _row_key(docs: DataFrame) -> Column:
    """The same for rows that agree in every column, and for no others (but for a collision of 64 bits). Maps, which can't be hashed, count as JSON, their entries in the order they have."""
    own = [quoted(f.name) for f in docs.schema.fields]
    values = [F.to_json(F.struct(c.alias("m"))) if _has_map(f.dataType) else c for c, f in zip(own, docs.schema.fields, strict=True)]
    return F.xxhash64(*values, *(c.isNull() for c in own))


def _times(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs' rows whose _row_key is in wanted (row_key, n), n of each. Rows that agree in every column are alike, so any n of them do."""
    key = free_name(docs, "_mm_row")
    docs = docs.withColumn(key, _row_key(docs))
    wanted = wanted.select(F.col("row_key").alias(key), "n")
    counts = docs.groupBy(key).count().where("count > 1").select(key, "count")
    more = materialise(counts.join(wanted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")), "repeated-rows")
    plain = materialise(wanted.join(more, key, "left_anti").select(key), "single-rows")
    out = docs.join(small(plain), key, "left_semi")
    if more.limit(1).count():
        again = docs.join(small(more.select(key)), key, "left_semi").dropDuplicates([key])
        n = free_name(docs, "n_times")
        again = again.join(more.select(key, F.col("n").alias(n)).where(f"{n} > 0"), key)
        out = out.union(again.select(*map(quoted, out.columns), F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(n)).drop(n))
    return out.drop(key)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (then text hash) stays. Rows with the same id and text count once: of
    those that differ in other columns, the one with the smallest row key stays. Rows without an id, without a word or linked with nothing stay, also if they
    share an id with a near copy."""
    linked = materialise(jaccard_join.jaccard_join(docs), "linked")
    same = ["id", "text_hash"]
    gone = materialise(linked.where("not first").select(same).distinct(), "near-copies")
    again = materialise(linked.where("first and id is not null").groupBy(same).count().where("count > 1").select(same), "repeated-rows")
    discard(linked)
    key, own_id, own_hash = (free_name(docs, n) for n in ("_mm_row", "_mm_id", "_mm_hash"))
    mine = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    by = lambda side: small(side).toDF(own_id, own_hash)
    rows = mine.join(by(gone), [own_id, own_hash], "left_anti")
    if again.limit(1).count():
        twins = mine.join(by(again), [own_id, own_hash], "left_semi").withColumn(key, _row_key(docs))
        least = twins.groupBy(own_id, own_hash).agg(F.min(key).alias(key))
        once = twins.join(least, [own_id, own_hash, key], "left_semi").dropDuplicates([own_id, own_hash])
        rows = rows.join(by(again), [own_id, own_hash], "left_anti").select(*map(quoted, docs.columns)).union(once.select(*map(quoted, docs.columns)))
    return rows.select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of each leaf's token prefix stay: as many of rows that repeat as were chosen, and rows without an id like others.

    Null and empty texts have no tokens and cost nothing. A null language or source is a branch of its own; ties in the order of a leaf go by row.
    """
    chosen = mixing.mix(docs, Q.levels(), Q.weights, BUDGET_SHARE, epochs=1, seed=Q.SEED, row_key=_row_key(docs))
    return _times(docs, materialise(chosen.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")), "chosen"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids. A null or empty text is its end id alone; repeated rows and rows without an id each get their own pieces."""
    return packing.pack(docs, Q.byte_bpe(KNOWN_CHUNKS), end_id=0, seed=Q.SEED, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed n-gram ratios, signatures and tokenizers are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
