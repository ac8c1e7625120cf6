import hashlib
import re

import pytest
from pyspark.sql import functions as F

from motifmill.llm import exact_dedup as X


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    """One result for each row: (id, keep_id, group_size, sha), and how many are kept in each group."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    out = []
    for n, g in groups.items():
        keep = sorted(g, key=lambda x: (-len(x[1]), x[0] is None, x[0]))[0][0]
        out += [(i, keep, len(g), hashlib.sha256(n.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=repr), len(groups)


def unique_rows(df):
    """A locator for frames that aren't files."""
    from motifmill.llm.common import materialise

    return materialise(df.withColumn("_at", F.monotonically_increasing_id()), "rows")


@pytest.mark.parametrize("digest", [X.sha256, lambda c: F.substring(X.sha256(c), 1, 1), lambda c: F.lit(b"x")])
def test_matches_brute_force_even_when_digests_collide(edge, digest):
    df = unique_rows(edge)
    got = X.exact_dedup(df, locator=F.col("_at"), digest=digest).collect()
    want, groups = brute([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    sha = {r._at: hashlib.sha256(norm(r.text).encode()).hexdigest() for r in df.select("_at", "text").collect()}
    assert sorted([(r.id, r.keep_id, r.group_size, sha[r["loc"]]) for r in got], key=repr) == want
    assert sum(r.kept for r in got) == groups


def test_state_lasts_over_batches(spark, sample, tmp_path):
    docs = sample.union(sample.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    one = X.exact_dedup(docs, files_per_trigger=1).select("id", "keep_id", "group_size").collect()
    want, _ = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted([tuple(r) for r in one], key=repr) == sorted([w[:3] for w in want], key=repr)


def test_later_rows_meet_the_state(spark, tmp_path):
    X.log_of(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text", F.col("doc_id"), X.sha256).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    X.ingest(stream(), str(tmp_path / "state"))
    X.log_of(spark.createDataFrame([(0, "ab"), (2, "a  b")], "doc_id long, text string"), "doc_id", "text", F.col("doc_id"), X.sha256).write.mode("append").parquet(str(tmp_path / "log"))
    X.ingest(stream(), str(tmp_path / "state"))
    (row,) = X.kept_state(spark, str(tmp_path / "state")).collect()
    assert (row.keep_id, row.n) == (2, 3)


def test_empty(empty):
    assert X.exact_dedup(empty).count() == 0
