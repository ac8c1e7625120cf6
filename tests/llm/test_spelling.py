import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motifmill.llm import spelling as S
from motifmill.llm.common import materialise

LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    """Plain counting of (id, text) rows."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def got(df, **kw):
    rows = S.variants(df, **kw).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def vocabulary(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzßéüÀÿ÷"])
def test_near_pairs_are_all_pairs_one_edit_apart(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 9))) for _ in range(150)}
    for w in list(words)[:60]:  # near ones
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :] + "a", w[:k] + rng.choice(alphabet) + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]}
    words = sorted(words)
    rows = S.near_pairs(S.masks(vocabulary(spark, dict.fromkeys(words, 5)))).collect()
    found = [tuple(sorted((r.a, r.b))) for r in rows]
    assert len(found) == len(set(found))  # once each
    assert set(found) == {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if one_edit(a, b)}


def test_chains_of_forms(spark):
    words = {"aaaaaa": 3125, "aaaaab": 625, "aaaabb": 125, "aaabbb": 25, "aabbbb": 5, "zzzzzz": 9, "zzzzzy": 9}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    out = got(spark.createDataFrame([(1, text)], "doc_id long, text string"), dropped=1 << 40)
    assert {w: x[1] for w, x in out.items()} == {w: w if w[0] == "z" else "aaaaaa" for w in words}
    assert out["aabbbb"] == ("aaabbb", "aaaaaa", 5, 1, 25) and out["zzzzzz"] == (None, "zzzzzz", 9, 1, None)


def test_ties_go_to_the_first_word(spark):
    text = " ".join(["walken"] * 5 + ["walked"] * 30 + ["walker"] * 30)
    out = got(spark.createDataFrame([(None, text)], "doc_id long, text string"))
    assert out["walken"][:2] == ("walked", "walked") and out["walken"][3:] == (2, 30)


def test_sample_by_plain_counting(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    words = counted(rows)
    assert len(words) > 100
    assert got(sample) == expected(words)


def test_edge_rows(spark, edge):
    rows = [(1, "Nothing"), (1, "nothing"), (None, "NOTHING nothing"), (2, None), (3, ""), (4, "nothing nothng " * 50_000), (4, "nothing nothng " * 50_000), (5, "émigré ÉMIGRÉ émigrÉ " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "run", "id", "b0", "x.y"):
        df = df.withColumn(c, F.lit(1))
    df = df.withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert got(df.repartition(3)) == expected(counted(rows))
    assert got(edge) == expected(counted([(r.doc_id, r.text) for r in edge.collect()]))


def test_empty_table(empty):
    assert got(empty) == {}


def test_signatures_are_never_broadcast(spark):
    words = vocabulary(spark, dict.fromkeys(("walken", "walked", "walker"), 5))
    plan = S.near_pairs(materialise(S.masks(words), "masks"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
