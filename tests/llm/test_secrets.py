import re

from motifmill.llm import secrets as S

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 1, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 2, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 3, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def check(df):
    got = S.find_secrets(df).collect()
    want = sorted([(r.doc_id, base(r.text or "")) for r in df.select("doc_id", "text").collect()], key=repr)
    assert sorted([(r.id, [tuple(s) for s in r.base]) for r in got], key=repr) == want
    return {r.id: [tuple(s) for s in r.added] for r in got}


def test_edge_rows(edge):
    added = check(edge)
    kinds = [k for _, _, k, _ in added[11]]
    assert kinds == ["identifier", "weak_secret", "endpoint"]


def test_sample(sample):
    check(sample)


def test_failing_matches_use_up_their_text(spark):
    rows = [(1, "token: secret: abcdefghijklmno"), (2, "password=token=abcdefghijklmnop"), (3, "API_KEY: 'AbCdEfGhIjKlMn' apikey=x"), (4, "é😀 secret=abcdefghijklmn")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_weak_parts_alone_are_not_reported(spark):
    far = " " * 500
    rows = [(1, "user: bob"), (2, "token=short12"), (3, "https://db.example.com"), (4, f"user: bob{far}token=short12"), (5, "user: bob token=short12"), (6, "user: bob https://x.y")]
    added = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [k for k, v in added.items() if v] == [5]


def test_empty(empty):
    assert S.find_secrets(empty).count() == 0
