import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from motifmill.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows):
    """(cost, audit, turns) of the cheapest edits, by trying all of them."""
    found, best = faults(rows), [10**9, "", []]
    legal = re.compile(r"(s?(ua)+)?\Z")
    prefix = re.compile(r"s?(ua)*u?\Z")

    def go(k, cost, audit, made, put):
        if cost > best[0] or not prefix.match("".join(r[:1] for r, _ in made)):
            return
        if k == len(rows):
            if legal.match("".join(r[:1] for r, _ in made)) and (cost, audit) < (best[0], best[1] or "~" if best[0] < 10**9 else "~"):
                best[:] = [cost, audit, list(made)]
        if put < 3:
            for r in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*made, (r, "")], put + 1)
        if k < len(rows):
            role, text = rows[k]
            go(k + 1, cost + 3, audit + "D", made, 0)
            if found[k] not in ("blank", "duplicate"):
                more = found[k] == "truncated"
                if role:
                    go(k + 1, cost + more, audit + "K", [*made, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(k + 1, cost + 2 + more, audit + "R", [*made, (r, text)], 0)

    go(0, 0, "", [], 0)
    return best


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def table(spark, convs):
    return spark.createDataFrame([(i, k, role, text) for i, rows in convs.items() for k, (role, text) in enumerate(rows)], SCHEMA)


def result(df, **kw):
    plans, turns = C.repair(df, **kw)
    return {r.conv: r for r in C.joined([plans, C.digests(turns)], "conv").collect()}


@pytest.mark.parametrize("block", [2, 1024])
def test_cheapest_edits_by_search(spark, block):
    rng = random.Random(block)
    roles, texts = ("user", "assistant", "system", "tool", ""), ("Yes.", "No!", "cut", "", "Why?")
    convs = {i: [(rng.choice(roles[: rng.choice((2, 5))]), rng.choice(texts)) for _ in range(rng.randrange(1, 6))] for i in range(60)}
    got = result(table(spark, convs), block=block)
    for i, rows in convs.items():
        cost, audit, turns = search(rows)
        assert (got[i].cost, got[i].audit) == (cost, audit), rows
        assert (got[i].sha256 or sha([])) == sha(turns), rows
        assert [got[i].blank, got[i].duplicate, got[i].truncated] == [faults(rows).count(n) for n in ("blank", "duplicate", "truncated")]
        assert got[i].illegal == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(rows))


def test_blocks_give_what_one_fold_gives(spark):
    rng = random.Random(3)
    convs = {i: [(rng.choice(("user", "assistant", "user", "assistant", "system")), f"{rng.randrange(40)}" + rng.choice(".!? ")) for _ in range(n)] for i, n in enumerate((1, 30, 31, 90, 200))}
    df = table(spark, convs)
    whole = result(df)
    for block in (1, 7, 30):
        assert result(df.repartition(3), block=block) == whole
    assert whole[4].cost > 0 and re.fullmatch("[DIKR]+", whole[4].audit)


def test_nulls_ties_repeated_rows_and_other_columns(spark):
    rows = [(1, None, None, None), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 5, "assistant", None), (None, 1, "user", "A?"), (None, 2, "assistant", "B."), (2, 1, "assistant", "b."), (2, 1, "user", "a."), (3, None, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("conv", "pos", "step", "at", "fold", "xs", "a.b"):
        df = df.withColumn(c, F.lit(1))
    got = result(df.withColumn("m", F.create_map(F.lit(1), F.lit(2))))
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].illegal) == (2, 2, 1, 2)
    assert (got[1].cost, got[1].audit) == (3 * 3 + 2, "DKDDI") and got[1].sha256 == sha([("user", "Hi."), ("assistant", "")])
    assert (got[None].cost, got[None].audit, got[None].gaps) == (0, "KK", 0)
    assert got[2].audit == "IKKI" and got[2].sha256 == sha([("user", ""), ("assistant", "b."), ("user", "a."), ("assistant", "")])  # a tie in turn goes by role
    assert (got[3].gaps, got[3].truncated, got[3].cost, got[3].audit) == (0, 1, 3, "D")


def test_repaired_turns_and_long_texts(spark):
    long = "word " * 100_000 + "end."
    plans, turns = C.repair(table(spark, {7: [("user", long), ("user", "again?"), ("assistant", "Yes.")], 8: [("user", "")]}))
    assert [tuple(r) for r in turns.where("conv = 7").orderBy("at", "nth").select("role", "edit").collect()] == [("user", "K"), ("assistant", "I"), ("user", "K"), ("assistant", "K")]
    assert turns.where("conv = 8").count() == 0 and plans.where("conv = 8").first().audit == "D"
    assert plans.where("conv = 7").first().cost == 2
    assert {r.sha256 for r in C.digests(turns.where("conv = 7")).collect()} == {sha([(r.role, r.text) for r in turns.where("conv = 7").orderBy("at", "nth").collect()])}


def test_empty_table(spark):
    plans, turns = C.repair(spark.createDataFrame([], SCHEMA))
    assert plans.count() == 0 and turns.count() == 0 and C.digests(turns).count() == 0
