"""The linking of weak parts against a plain search of all pairs, on documents with planted multipart credentials; and the query's SQL on them."""

import random
import re

import duckdb
import pandas as pd
import pytest

from motifmill.llm import queries as Q
from motifmill.llm import secrets as S


def planted(seed, n=120):
    """Identifiers, secrets and endpoints among words and other letters, some near each other and some far, and the base kinds."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("ghijklmnoprstuvw") for _ in range(k))
    value = lambda k: "".join(rng.choice("GHJKLMNPQRSTUVW23456789") for _ in range(k))
    parts = [
        lambda: f"client_id: {word(6)}",
        lambda: f'username = "{word(rng.randint(1, 6))}"',
        lambda: f"login={word(5)}@{word(4)}.org",
        lambda: f"password: {value(rng.randint(4, 14))}",
        lambda: f"API_KEY='{value(rng.randint(5, 30))}'",
        lambda: f"Authorization: Bearer {value(rng.randint(4, 20))}",
        lambda: f"https://{word(5)}.example/{word(3)}",
        lambda: f"postgres://{word(4)}:5432/{word(3)}",
        lambda: f"AKIA{value(rng.randint(2, 16)).upper()}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(14, 20))),
    ]
    fill = lambda: rng.choice(["é😀 ", "\n", " " * rng.randint(1, 260), " ".join(word(4) for _ in range(rng.randint(1, 60))) + " "])
    rows = []
    for k in range(n):
        rows.append((k, "".join(rng.choice(parts)() + fill() if rng.random() < 0.6 else fill() for _ in range(rng.randint(0, 9)))))
    return [*rows, (n, None), (n + 1, ""), rows[3], rows[3]]


def matches(text, pattern, group):
    return [(m.start(), m.end(), len(m[group])) for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text)]


def brute(text):
    """All spans of a text, each weak part compared with each other part."""
    found = {kind: matches(text, pattern, group) for kind, pattern, group in S.SCANS}
    base = [(s, e, k) for k in ("assign", "access", "hex") for s, e, n in found[k] if n >= S.LEAST[k]]
    weak = [(s, e) for s, e, n in found["assign"] if S.WEAK_SECRET <= n < S.LEAST["assign"]] + [(s, e) for s, e, n in found["bearer"] if n >= S.WEAK_SECRET]
    names = [(s, e) for s, e, n in found["identifier"] if n >= S.WEAK_IDENTIFIER] + [(s, e) for s, e, n in found["access"] if 8 <= n < S.LEAST["access"]]
    secrets = [s for s, _ in weak] + [s for s, _, k in base if k == "assign"]
    holders = [s for s, _ in names] + [s for s, _, k in base if k == "access"]
    near = lambda s, others: any(abs(s - o) <= S.SCOPE for o in others)
    added = [(s, e, "weak_secret") for s, e in weak if near(s, holders)] + [(s, e, "identifier") for s, e in names if near(s, secrets)]
    added += [(s, e, "endpoint") for s, e, _ in found["endpoint"] if near(s, holders) and near(s, secrets)]
    return base, added


def as_text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], S.KINDS.index(x[2]))))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_planted_parts(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, kinds = [], set()
    for i, t in rows:
        base, added = brute(t or "")
        kinds |= {k for _, _, k in added}
        want.append((i, as_text(base), as_text(added)))
    assert kinds == {"weak_secret", "identifier", "endpoint"}
    got = S.find_secrets(df).select("id", S.as_text("base").alias("base"), S.as_text("added").alias("added")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sql_on_planted_parts(spark, tmp_path):
    rows = list(dict(planted(4, 300)).items())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name
    want = con.sql(Q.oracle_sql()["op4_secret_scan"]).df()
    got = Q.op4_secret_scan(spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))
    assert sum("weak_secret" in x for x in got.spans) > 20


def test_a_hot_document(spark):
    """Thousands of weak parts in one text: a part is linked once, however many complements it has."""
    text = "user: bob token=short12 " * 3000
    got = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(got.added) == 6000 and not got.base
