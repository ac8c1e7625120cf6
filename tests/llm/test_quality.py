import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motifmill.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    cover = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def check(df, ratio):
    got = Q.score_docs(df, ratio).collect()
    want = sorted([(r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect()], key=repr)
    assert sorted([tuple(r)[:7] for r in got], key=repr) == want
    assert all(not r.kept for r in got if r.base_failed)
    return got


@pytest.fixture(scope="module")
def ratio(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    return Q.fit(sample, labels.where("quality = 1 and toxic = 0").select("doc_id"), labels.where("quality = 0").select("doc_id"))


def test_edge_rows(edge, ratio):
    check(edge, ratio)


def test_sample(sample, ratio):
    check(sample, ratio)


def test_ratio_is_the_counts(sample, spark, ratio):
    """The model and one score, from the bytes themselves."""
    from motifmill.llm import textkernel as K

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    rows = sample.collect()
    cells = {}
    for r in rows:
        b = np.frombuffer(re.sub(rb"[0-9]", b"0", r.text.encode().lower()), np.uint8)
        cells[r.doc_id] = (K.window_hash(K.prefix_hash(b), Q.WIDTH) & np.uint64(Q.BUCKETS - 1)).astype(int)
        np.add.at(raw, cells[r.doc_id], 1)
        if r.doc_id in good:
            np.add.at(target, cells[r.doc_id], 1)
    want = np.log((target + Q.SMOOTH) / (target.sum() * raw / raw.sum() + Q.RAW_SMOOTH))
    assert np.allclose(ratio.log_ratio, want, atol=1e-6)
    got = {r.doc_id: r.llr for r in Q.score_docs(sample, ratio).collect()}
    for i, c in cells.items():
        assert got[i] == pytest.approx((want[c].sum() + Q.PRIOR_GRAMS * ratio.mean) / (len(c) + Q.PRIOR_GRAMS), abs=1e-5)
    # The mean is over rows as if their own counts were not there.
    means = []
    for r in rows:
        if r.doc_id in good and not brute(r.text)[-1]:
            own = np.bincount(cells[r.doc_id], minlength=Q.BUCKETS)
            alone = np.log((target - own + Q.SMOOTH) / ((target.sum() - own.sum()) * raw / raw.sum() + Q.RAW_SMOOTH))
            means.append(alone[cells[r.doc_id]].mean())
    assert ratio.mean == pytest.approx(np.median(means))


SPAM = "casino pills viagra bonus jackpot cheap free winner click buy now poker slots cash prize discount offer pharmacy".split()


def halves(spark, sf):
    """For each half of the ids: the model fitted on its labels, and the other half's labelled rows with their scores."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for fold in (0, 1):
        ours = labels.where(f"doc_id % 2 = {fold}")
        fit = Q.fit(docs, ours.where("quality = 1 and toxic = 0").select("doc_id"), ours.where("quality = 0").select("doc_id"))
        yield fit, Q.score_docs(docs, fit).join(labels.where(f"doc_id % 2 != {fold}"), "doc_id").toPandas()


def test_tells_labelled_rows_apart(spark):
    """Held-out rows of each half; texts of no language and of one that the corpus does not have."""
    rng = np.random.default_rng(3)
    strange = [" ".join(rng.choice(SPAM, 300))] + [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 9))) for _ in range(n)) for n in (15, 50, 300)]
    strange = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    for fit, held in halves(spark, "/root/testdata/sf0.1"):
        held = held[~held.base_failed]
        clean, toxic = held[(held.quality == 1) & (held.toxic == 0)], held[(held.quality == 1) & (held.toxic == 1)]
        assert clean.kept.mean() > 0.98 and (clean.llr >= fit.threshold).mean() > 0.999
        assert held[held.quality == 0].kept.mean() < 0.05
        assert toxic.kept.mean() < 0.45
        assert not any(r.kept or r.llr >= fit.threshold for r in Q.score_docs(strange, fit).collect())


def test_short_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = Q.fit(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"), labels.where("quality = 0").select("doc_id"))
    short = Q.score_docs(docs, fit).join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("n_words < 40 and not base_failed").toPandas()
    assert len(short) and (short.llr >= fit.threshold).mean() > 0.98


def test_threshold_parts_with_the_least_errors():
    rng = np.random.default_rng(2)
    good = pd.DataFrame({"grams": rng.integers(1, 500, 200), "low": rng.normal(-1, 0.5, 200)})
    good["total"] = good.grams * rng.normal(0.1, 0.3, 200)
    bad = pd.DataFrame({"grams": rng.integers(0, 500, 60)})
    bad["total"], bad["low"] = bad.grams * rng.normal(-0.4, 0.3, 60), 0.0
    r = Q._with_thresholds(Q.Ratio(np.zeros(1), np.zeros(1)), good, bad)
    ok, no = (r.score(x.total.to_numpy(), x.grams.to_numpy()) for x in (good, bad))
    errors = lambda t: (ok < t).mean() + (no >= t).mean()
    assert errors(r.threshold) == pytest.approx(min(errors(t) for t in np.linspace(-2, 2, 20_001)), abs=1e-9)
    assert (good.low < r.word_threshold).mean() <= Q.WORD_LOSS


def test_keep_has_all_columns(edge, ratio):
    out = Q.keep(edge, ratio)
    assert out.schema == edge.schema
    want = sorted([r.doc_id for r in Q.score_docs(edge, ratio).collect() if r.kept], key=repr)
    assert sorted([r.doc_id for r in out.collect()], key=repr) == want


def test_empty(spark, empty, ratio):
    assert Q.score_docs(empty, ratio).count() == 0
    assert np.allclose(Q.fit(empty, empty.select("doc_id"), empty.select("doc_id")).log_ratio, 0)


def test_nothing_trusted(sample):
    none = sample.where("false")
    got = Q.score_docs(sample, Q.fit(sample, none, sample.where("doc_id < 5"))).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_words_that_the_target_lacks(spark):
    """Same form, one word apart; a rare word is no evidence."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{chr(97 + x)}" for x in rng.permutation(20)) for _ in range(300)]
    rows = [(k, t + (" Slurword, again" if k % 10 == 9 else " wordz again") + (" wordq" if k == 4 else "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fit = Q.fit(docs, docs.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in Q.score_docs(docs, fit).collect()}
    assert [k for k, r in got.items() if not r.kept] == [k for k in got if k % 10 == 9]
    n, n_good = 300, 150
    assert got[9].word_llr == pytest.approx(np.log(Q.WORD_SMOOTH / (n_good * 30 / n + Q.WORD_SMOOTH)))


def test_all_labelled_rows_count(spark):
    """More trusted rows than a bounded sample of ids used to hold: each counts in the target."""
    n = 230_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"))
    assert n > 200_000 and Q._labels(docs, docs.limit(3), "doc_id").where("good").count() == n
    ratio = Q.fit(docs, docs)
    raw = target = 0.0 + n
    assert ratio.log_ratio.max() == pytest.approx(np.log((target + Q.SMOOTH) / (n * raw / n + Q.RAW_SMOOTH)), abs=1e-7)


def test_thresholds_by_passes_are_those_at_the_driver(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    sets = labels.where("quality = 1 and toxic = 0").select("doc_id"), labels.where("quality = 0").select("doc_id")
    for bad in (sets[1], None):
        here, there = (Q.fit(docs, sets[0], bad, at_driver=n) for n in (1 << 40, 0))
        assert (there.mean, there.threshold, there.word_threshold) == pytest.approx((here.mean, here.threshold, here.word_threshold), rel=1e-12)
    rng = np.random.default_rng(7)
    rows = [(bool(k % 3), float(rng.integers(-9, 9)), int(rng.integers(0, 4)), float(-rng.integers(0, 5))) for k in range(3000)]
    local = pd.DataFrame(rows, columns=["good", "total", "grams", "low"])
    here = Q._with_thresholds(Q.Ratio(np.zeros(1), np.zeros(1)), local[local.good], local[~local.good])
    there = Q._thresholds_by_passes(Q.Ratio(np.zeros(1), np.zeros(1)), spark.createDataFrame(rows, "good boolean, total double, grams long, low double"))
    assert (there.mean, there.threshold, there.word_threshold) == pytest.approx((here.mean, here.threshold, here.word_threshold), rel=1e-12)
