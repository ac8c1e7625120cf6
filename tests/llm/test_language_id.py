from collections import Counter

import numpy as np
import pytest

from motifmill.llm import language_id as L
from motifmill.llm import queries as Q


@pytest.fixture(scope="module")
def filters(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"not ({Q.HELD_OUT})"))


def test_held_out_accuracy(spark, filters):
    rows = Q.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97


def test_edge_rows(edge, filters):
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(edge, filters).collect()}
    assert got[3] == got[4] == got[5] == (L.UNKNOWN, 0.0)
    assert all(p in filters.languages and 0 <= s <= 1 for i, (p, s) in got.items() if i not in (3, 4, 5))
    assert L.predict(edge, filters).count() == edge.count()


def test_no_letter_is_unknown(filters):
    assert L.predict_text("123 !? \n", filters) == (L.UNKNOWN, 0.0)
    assert L.predict_text(None, filters)[0] == L.UNKNOWN


def test_filters_return_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    sets = {f"l{k:03d}": rng.integers(0, 1 << 63, 500, dtype=np.uint64) for k in range(70)}  # more than one plane
    f = L.build(sets)
    for k, lang in enumerate(f.languages):
        mask = f.planes[k // 64][L.slots(sets[lang])[0]]
        for at in L.slots(sets[lang])[1:]:
            mask = mask & f.planes[k // 64][at]
        assert (mask >> np.uint64(k % 64) & np.uint64(1)).all()
    assert f.false_positive.max() < 0.01


def brute_grams(text):
    """WIDTH-grams over lower-cased letters, one blank for each run of anything else, none at the end."""
    out, low = [], text.lower()
    for k, c in enumerate(low):
        if c.isalpha():
            out.append(c)
        elif k == 0 or low[k - 1].isalpha():
            out.append(" ")
    return ["".join(out[k : k + L.WIDTH]) for k in range(len(out) - L.WIDTH + 1)]


def test_predictions_of_exact_sets(spark, sample):
    """The filters' answers against those of plain sets of n-grams in Python, for every row."""
    train = [r for r in sample.where(f"not ({Q.HELD_OUT})").collect() if r.lang is not None and r.text is not None]
    f = L.fit(sample.where(f"not ({Q.HELD_OUT})"))
    sets = {}
    for lang in f.languages:
        ours = [set(brute_grams(r.text)) for r in train if r.lang == lang]
        n = Counter(g for x in ours for g in x)
        sets[lang] = {g for g, k in n.items() if k >= L.LEAST_SHARE * len(ours)}
    exact = L.Filters(f.languages, f.planes, np.zeros(len(f.languages)), f.common)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(sample, f).collect()}
    for r in sample.collect():
        g = brute_grams(r.text or "")
        lang, score = L.decide(np.array([sum(x in sets[k] for x in g) for k in f.languages], float), len(g), exact)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 0.01


def test_no_known_gram_and_ties():
    f = L.build({"a": L.code_grams("same words"), "b": L.code_grams("same words")})
    f.common = 1
    assert L.predict_text("日本語のテキスト", f) == ("b", 0.0)
    assert L.predict_text("same words", f) == ("a", 0.5)


def test_learns_from_labels_only(spark):
    rows = [(1, "aaaa bbbb", "x"), (2, "cccc dddd", "y"), (3, "zzzz", None), (4, None, "q")]
    f = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.languages == ["x", "y"]
    assert L.predict_text("bbbb aaaa", f)[0] == "x" and L.predict_text("dddd", f)[0] == "y"


def test_empty(empty):
    f = L.fit(empty)
    assert f.languages == [] and L.predict(empty, f).count() == 0 and L.predict_text("abc", f) == (L.UNKNOWN, 0.0)
