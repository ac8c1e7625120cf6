import random
import re

import pytest

from motifmill.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stretches(text, least):
    """(content, first word, end) of each window of ``least`` words."""
    words = WORD.findall(text or "")
    for s in range(len(words) - least + 1):
        yield tuple(words[s : s + least]), s, s + least


def brute(rows, least):
    seen, out = set(), []
    done = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        if (i, t) not in done:
            gone = set()
            found = sorted(stretches(t, least), key=lambda s: s[1])
            for body, a, b in found:
                if body in seen:
                    gone |= set(range(a, b))
                seen.add(body)
            done[i, t] = t
            if gone:
                pieces = [m.group() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)]
                rest = "".join(p for k, p in enumerate(pieces) if k not in gone) + t[len("".join(pieces)) :]
                done[i, t] = rest[1:] if 0 in gone and rest.startswith("\n") else rest
        out.append((i, done[i, t]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [50, 5, 1])
def test_edge_rows(edge, least):
    got = L.line_dedup(edge, min_words=least)
    assert got.columns == [*edge.columns, "_mm_cuts"]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == brute([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], least)


@pytest.mark.parametrize("least", [50, 8])
def test_sample(sample, least):
    got = [(r.doc_id, r.text) for r in L.line_dedup(sample, min_words=least).collect()]
    assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in sample.collect()], least)


def test_passage_stays_once(edge):
    texts = {r.doc_id: r.text for r in L.line_dedup(edge).collect() if r.doc_id in (7, 8, 9)}
    assert "word5 word6" in texts[7] and "word5 word6" not in texts[8] + texts[9]


def test_passage_goes_wherever_lines_begin(spark):
    w = [f"p{k}" for k in range(60)]
    passage = f"{' '.join(w[:20])}\n{' '.join(w[20:35])}\n{' '.join(w[35:])}"
    alone = " ".join(w[20:35])
    rows = [(1, f"own words {passage} of the first"), (2, f"  {alone}\nthe same line elsewhere"), (3, f"a head {passage} and\ta tail\n"), (4, f"{passage}\nrest"), (5, " ".join(w)), (6, "x " + " ".join(w[5:54]))]
    got = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].text for i in got} == {1: rows[0][1], 2: rows[1][1], 3: "a head and\ta tail\n", 4: "rest", 5: "", 6: rows[5][1]}
    assert [(c["from"], c["to"]) for c in got[3]["_mm_cuts"]] == [(2, 61)]


@pytest.mark.parametrize("least", [50, 20])
def test_passages_at_any_offset_of_one_line(spark, least):
    """Repeats of all lengths about the least one, in texts without a line break, between documents and within one; periodic texts."""
    rng = random.Random(5)
    fresh = lambda n: [f"f{rng.random()}" for _ in range(n)]
    source = fresh(300)
    rows = [(0, " ".join(source))]
    for i in range(1, 60):
        words = fresh(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            a, n = rng.randrange(250), rng.randrange(least - 4, least + 40)
            words += source[a : a + n] + fresh(rng.randrange(1, 20))
        rows.append((i, " ".join(words)))
    own = fresh(80)
    rows += [(90, " ".join(own + ["mid"] + own[10:75])), (91, "a b " * 70), (92, "a b " * 40 + "c"), (93, "b " + "a b " * 33)]
    got = [(r.doc_id, r.text) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()]
    assert sorted(got, key=repr) == brute(rows, least)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_of_long_texts_change_nothing(spark, block):
    rng = random.Random(block)
    source = [f"s{rng.randrange(40)}" for _ in range(400)]
    rows = [(i, " ".join(source[a : a + rng.randrange(20, 200)])) for i in range(12) for a in [rng.randrange(300)]]
    texts = L.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    cut = lambda b: sorted((r["_mm_id"], c["from"], c["to"]) for r in L.passages(L.repeats(texts, "text", 12, b)).collect() for c in r.cuts)
    assert cut(block) == cut(L.BLOCK) != []


def test_line_shared_by_all_with_a_match_of_only_some(spark):
    line = "common line of six words here"
    rows = [(k, f"{' '.join(f'x{k}y{j}' for j in range(30))}\n{line}\n{' '.join(f'{k % 7 if k < 28 else k}z{j}' for j in range(46))}") for k in range(60)]
    got = [(r.doc_id, r.text) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == brute(rows, 50)
    assert sum(t != dict(rows)[i] for i, t in got) == 21


def test_empty(empty):
    assert L.line_dedup(empty).count() == 0


def test_only_zones_with_repeats_are_winnowed(spark, monkeypatch):
    rng = random.Random(3)
    fresh = lambda n: [f"{rng.choice('adhteo')}{rng.random()}" for _ in range(n)]
    passage = fresh(60)
    rows = [(i, " ".join(fresh(400))) for i in range(40)]
    rows += [(50, " ".join(fresh(300) + passage + fresh(300))), (51, " ".join(fresh(200) + passage)), (52, rows[0][1]), (53, f"{rows[0][1]}\n")]
    seen, places_of = [], L.places_of

    def watched(texts, *more):
        seen.extend((r["_mm_id"], sum(z["to"] - z["from"] for z in r["zones"])) for r in texts.collect())
        return places_of(texts, *more)

    monkeypatch.setattr(L, "places_of", watched)
    got = [(r.doc_id, r.text) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == brute(rows, 50)
    zones = dict(seen)
    assert set(zones) == {0, 50, 51, 53} and zones[50] < 120 and zones[51] < 120


@pytest.mark.parametrize("least", [50, 20, 7, 2])
def test_passages_across_pieces_of_all_lengths(spark, least):
    """Stretches with and without the letters that texts are cut at, so that passages begin and end in short pieces, in parts of long ones and among single words."""
    rng = random.Random(least)

    def fresh(n):
        words, of = [], "t"
        for _ in range(n):
            of = rng.choice(["adhteo", "e" + "t" * 5, "t", "ttttttta", of, of]) if rng.random() < 0.08 else of
            words.append(f"{rng.choice(of)}{rng.randrange(10**6)}")
        return words

    source = fresh(1500)
    rows = [(0, " ".join(source))]
    for i in range(1, 150):
        words = fresh(rng.randrange(2 * least))
        for _ in range(rng.randrange(1, 5)):
            a, n = rng.randrange(1400), rng.randrange(max(1, least - 2), least + 30)
            words += source[a : a + n] + fresh(rng.randrange(least))
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "\t", " \r\n"]) for w in words)))
    rows += [(200, ""), (201, " \n"), (202, None), (203, rows[5][1]), (204, rows[5][1]), (None, rows[6][1]), (205, "\n\n" + rows[7][1])]
    got = [(r.doc_id, r.text) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()]
    assert sorted(got, key=repr) == brute(rows, least)
