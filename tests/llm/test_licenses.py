import random
import re

import pytest
from pyspark.sql import functions as F

from motifmill.llm import licenses as L
from motifmill.llm.license_rules import BASE, rules

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return SPLIT.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def base_of(text):
    w = words_of(text)
    at = [(k, label) for phrase, label in BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def resolved(hits):
    """Suppression by comparing all detections (rule, start, end, priority) of a text."""
    hits = [h for h in hits if h[3] >= 0]
    outer = sorted((h for h in hits if not any(o != h and o[1] <= h[1] and o[2] >= h[2] and (o[2] - o[1] > h[2] - h[1] or (o[3], o[0]) < (h[3], h[0])) for o in hits)), key=lambda h: h[1])
    out = []
    for k, h in enumerate(outer):
        before, after = outer[k - 1] if k else None, outer[k + 1] if k + 1 < len(outer) else None
        if not (before and before[2] > h[1] and before[3] <= h[3] or after and after[1] < h[2] and after[3] < h[3]):
            out.append(h[:3])
    return out


def got(df):
    return {r.id: r for r in L.licenses(df).collect()}


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


CASES = [
    ("Released under the MIT License.", "mit"),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"),  # the base phrase stays
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"),
    ("see https://www.gnu.org/licenses/gpl-3.0.html or https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa,gpl-3"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
    ("GNU General Public License v2 or any later version license", "gpl-2-or-later"),
    ("BSD 3-Clause License", "bsd-3"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Ich gehe mit dem Hund under the bridge; the apache helicopter is curl free", ""),
    ("a licence to kill, an artistic licentious python", ""),
    ("underthe mit license", "mit"),
    ("unmit license", ""),
]


def test_labels_of_known_notices(spark):
    out = got(table(spark, [t for t, _ in CASES]))
    for k, (text, labels) in enumerate(CASES):
        assert out[k].labels == labels, (text, out[k])
        assert (out[k].score > 0) == bool(labels) and 0 <= out[k].score <= 1
        assert (out[k].n_words, out[k].n_base, out[k].first_word, out[k].last_word, out[k].base_labels) == base_of(text)


def test_rules():
    found = rules()
    assert len(found) > 300 and len({r.pattern for r in found if r.priority == 0}) > 70
    for r in found:  # the gates never keep a rule from its own match
        assert re.compile(L.spaced(r.pattern)) and r.anchor == r.anchor.lower() and "," not in r.label
    assert [r.priority for r in found] == sorted(r.priority for r in found)


def test_gates_lose_nothing():
    """Every notice is found with and without anchors and keys."""
    texts = [t for t, _ in CASES] + [f"{way} {n}" for way in ("licensed under the", "license:", "spdx license identifier") for n in ("mit", "apache 2 0", "gpl v3", "cc by sa 4 0", "mpl 2 0", "isc", "eupl", "sspl", "odc by", "gnu affero general public license 3")]
    for text in texts:
        w = L.normalised(text)[1].decode()
        for r in rules():
            if re.search(L.spaced(r.pattern), w):
                assert r.anchor in w and any(k in w for k in r.keys.split("|")), (text, r)


@pytest.mark.parametrize("seed", range(4))
def test_suppression_by_comparing_all(spark, seed):
    rng = random.Random(seed)
    hits = {u: list(dict.fromkeys((rng.randrange(9), s := rng.randrange(30), s + rng.randrange(1, 9)) for _ in range(rng.randrange(1, 14)))) for u in range(40)}
    hits = {u: [(r, s, e, (r % 4) - 1 if r == 0 else r % 4) for r, s, e in hs] for u, hs in hits.items()}
    df = spark.createDataFrame([(u, *h) for u, hs in hits.items() for h in hs], "uid long, rule int, start long, end long, priority int")
    out = {}
    for r in L.kept(df).collect():
        out.setdefault(r.uid, []).append((r.rule, r.start, r.end))
    assert {u: sorted(resolved(hs)) for u, hs in hits.items() if resolved(hs)} == {u: sorted(x) for u, x in out.items()}


def test_sample_and_edges(spark, sample, edge, empty):
    assert L.licenses(empty).count() == 0
    for df in (sample, edge.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = L.licenses(df).collect()
        key = lambda x: tuple((v is not None, v) for v in x)
        assert sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=key) == sorted(((i, *base_of(t)) for i, t in rows), key=key)
        found = rules()
        for r in out:
            text = next(t for i, t in rows if i == r.id)
            w = L.normalised(text or "")[1]
            hits = [(k, s, e, found[k].priority) for k, s, e in L.detections(w, found)]
            labels = {found[h[0]].label for h in hits if h[3] < 0} | {found[h[0]].label for h in resolved(hits)}
            assert r.labels == ",".join(sorted(labels))


def test_long_texts_many_places_repeated_and_null_rows(spark):
    many = "cc by nc cc by nc " * 20_000 + "Under The MIT-License"
    rows = [(1, many), (1, many), (2, None), (None, "under the mit license ÄÖ"), (3, "")]
    out = L.licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == 5 and [r.n_base for r in out if r.id == 1] == [40_001] * 2
    one = next(r for r in out if r.id == 1)
    assert (one.first_word, one.last_word, one.base_labels) == (0, 120_000, "cc-by-nc,mit")
    assert {(r.n_words, r.n_base) for r in out if r.id is None} == {(5, 1)}
    assert {(r.n_words, r.labels, r.score, r.first_word) for r in out if r.id in (2, 3)} == {(0, "", 0.0, None)}
