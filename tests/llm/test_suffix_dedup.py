import hashlib
import io
from collections import Counter

import numpy as np
import pytest

from motifmill.llm import columnwise as C
from motifmill.llm import suffix_dedup as S


def brute(texts, length):
    seen = Counter(t[j : j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                cover[j : j + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, length, **options):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([(r.text or "").encode() for r in rows], length), strict=True)), key=repr)
    got = S.suffix_dedup(df, length=length, **options).collect()
    assert sorted([(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == want


@pytest.mark.parametrize("length", [400, 40])
def test_edge_rows(edge, length):
    check(edge, length)


def test_very_long_text(spark):
    """Several steps long, with a copied stretch, beside a text that shares another one."""
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghij klmno"), 2_300_000))
    long += long[1_048_000:1_049_500]
    rows = [(1, long), (2, "x" * 100 + long[50_000:51_000] + "y" * 100), (3, "short")]
    got = {r.id: r for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert bytes(got[1].kept).decode() == long[:50_000] + long[51_000:1_048_000] + long[1_049_500:2_300_000]
    assert bytes(got[2].kept).decode() == "x" * 100 + "y" * 100 and got[1].n_spans == 3


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_by_shuffles_alone(sample, monkeypatch, most):
    """No broadcast is hinted, or every one."""
    from motifmill.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    check(sample, 60)


def test_query_has_the_remaining_text(spark):
    from motifmill.llm import queries

    for r in queries.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect():
        assert "\ufffd" in r.text or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
        assert r.n_removed or len(r.text.encode()) == r.n_bytes


def test_sample(sample):
    check(sample, 400)


@pytest.mark.parametrize("hot", [S.HOT_REGIONS, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_passages_among_noise(spark, hot, seed):
    """Shared passages at random places, periodic stretches, zero bytes and repeats inside one text."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefgh \n\x00é"))
    noise = lambda n: "".join(rng.choice(letters, n))
    shared = [noise(int(rng.integers(30, 200))) for _ in range(4)]
    texts = []
    for k in range(60):
        parts = [noise(int(rng.integers(0, 60))) for _ in range(3)]
        for _ in range(int(rng.integers(0, 3))):
            p = shared[int(rng.integers(4))]
            a = int(rng.integers(0, 20))
            parts.insert(int(rng.integers(len(parts))), p[a : len(p) - int(rng.integers(0, 20))])
        if k % 10 == 0:
            parts.append("xyz" * int(rng.integers(5, 60)))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(df, 40, hot_regions=hot)


def test_steps_of_long_texts_overlap(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghij"), 3000))
    texts = [base + "1" + base[500:1500], "q" * 50 + base[100:900]]
    want = brute([t.encode() for t in texts], 40)
    starts = [set() for _ in texts]
    monkeypatch.setattr(S, "STEP", 700)
    monkeypatch.setattr(S, "CHUNK", 300)
    for k, t in enumerate(texts):
        for _, _, p, lo, hi in S.regions(t.encode(), 40):
            for a, b, c in zip(lo, hi, p, strict=True):
                assert a <= c <= a + 20 or c >= a
                assert not starts[k] & set(range(a, b + 1))
                starts[k] |= set(range(a, b + 1))
    assert [s == set(range(len(t) - 39)) for s, t in zip(starts, texts, strict=True)] == [True, True]
    assert want[0][1] > 0


def test_columnwise_orders_and_prefixes():
    rng = np.random.default_rng(7)
    docs = [bytes(rng.choice(list(b"ab"), int(rng.integers(1, 30)))) for _ in range(40)]
    at = rng.integers(-5, 6, len(docs))
    flags, first = C.repeated_starts(docs, at, 4)
    for i, d in enumerate(docs):
        for j in range(len(d)):
            u = at[i] + j
            same = any(k != i and 0 <= u - at[k] and len(e) - (u - at[k]) >= 4 and len(d) - j >= 4 and e[u - at[k] :][:4] == d[j : j + 4] for k, e in enumerate(docs))
            assert flags[u - first, i] == same


def test_transform_holds_the_symbols_before():
    """Each round's suffixes in order, the symbol before each, and the common prefix of neighbours."""
    rng = np.random.default_rng(8)
    docs = [bytes(rng.choice(list(b"abc"), int(rng.integers(1, 20)))) for _ in range(30)]
    at = rng.integers(-4, 5, len(docs))
    first, last = int(at.min()), int((at + [len(d) for d in docs]).max())
    columns, out = io.BytesIO(), io.BytesIO()
    C.write_columns(docs, at, first, last, columns)
    C.rounds(columns, len(docs), last - first, out)
    symbol = lambda i, u: docs[i][u - at[i]] + 1 if 0 <= u - at[i] < len(docs[i]) else 0
    for k, (bwt, doc, lcp) in enumerate(C.transform(out, len(docs), last - first)):
        u = last - 1 - k
        suffixes = [[symbol(i, v) for v in range(u, last)] for i in doc]
        assert suffixes == sorted(suffixes)
        if u > first:
            assert bwt.tolist() == [symbol(i, u - 1) for i in doc]
        for a, b, n in zip(suffixes, suffixes[1:], lcp[1:].tolist(), strict=False):
            common = next((j for j, (x, y) in enumerate(zip(a, b, strict=True)) if x != y or x == 0), len(a))
            assert n == common


def test_remaining_bytes(edge):
    got = {r.id: bytes(r.kept) for r in S.suffix_dedup(edge.where("doc_id in (7, 8, 1)"), length=40, with_text=True).collect()}
    assert b"word5 word6" not in got[7] + got[8] and got[7].startswith(b"alpha") and got[1].startswith(b"The quick")


def test_empty(empty):
    assert S.suffix_dedup(empty).count() == 0
