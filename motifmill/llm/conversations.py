"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user-assistant pairs.

Windows derive each turn's faults; sorted turn structs of a block are folded by aggregate(), which carries for each of four states (nothing
yet, after system, after user, after assistant) the least (cost, audit). Longer conversations are several blocks: each is folded once for
every state it can be entered in, and the blocks are put together in order.

Null roles and texts are one space. A role that is empty has no initial and can't be kept. Turns are in the order of turn (nulls first), then
role and text, so the order of rows in the table does not matter; repeated rows are turns of their own. A null conversation id is an id like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kernel, materialise

#: Turns folded together; only flags are collected, no texts.
BLOCK = 1024
# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK = r"\x20\x09-\x0D"
#: A state that can't be reached.
NEVER = 1 << 40
STATES = 4
POINT = "struct<cost:bigint,audit:string,path:string>"


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), turn, role, text, initial, new_turn, illegal (with the turn before), fault (blank, duplicate, truncated or null)."""
    space = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    t = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    along = W.partitionBy("conv").orderBy("turn", "role", "text")
    t = t.withColumns({"pos": F.row_number().over(along) - 1, "initial": F.substring("role", 1, 1)})
    pair = F.concat(F.lag("initial").over(along), "initial")
    t = t.withColumns({
        "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(along)),
        "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
        "again": F.row_number().over(W.partitionBy("conv", "role", "text").orderBy("pos")) > 1,
    })
    fault = F.when(~F.col("text").rlike(f"[^{BLANK}]"), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(rf"[.!?][{BLANK}]*\z"), "truncated")
    return t.withColumn("fault", fault).drop("again")


def _point(p: Column, cost: int | Column, letter: str, step: str) -> Column:
    return F.struct((p["cost"] + cost).alias("cost"), F.concat(p["audit"], F.lit(letter)).alias("audit"), F.concat(p["path"], F.lit(step)).alias("path"))


def _states(points: list[Column]) -> Column:
    return F.struct(*(p.alias(f"s{k}") for k, p in enumerate(points)))


def _at(state: Column, k: int) -> Column:
    return state[f"s{k}"]


def _with_inserts(s: Column) -> Column:
    """Up to two turns inserted; a third would come back to a state already seen at less cost."""
    nothing, system, user, assistant = (_at(s, k) for k in range(STATES))
    put_user = lambda p: _point(p, INSERT, "I", "u")
    put_assistant = lambda p: _point(p, INSERT, "I", "a")
    return _states([nothing, system, F.least(user, put_user(nothing), put_user(system), put_user(assistant)), F.least(assistant, put_assistant(user), put_assistant(put_user(nothing)), put_assistant(put_user(system)))])


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _turn(s: Column, x: Column) -> Column:
    """States after the turn x (initial, fault): kept, given the other role, or deleted."""
    nothing, system, user, assistant = (_at(s, k) for k in range(STATES))
    more = F.when(x["fault"].eqNullSafe("truncated"), TRUNCATED).otherwise(0)
    stays = ~F.coalesce(x["fault"].isin("blank", "duplicate"), F.lit(False))
    drop = lambda p: _point(p, DELETE, "D", "D")
    keep = lambda p, initial: F.when(stays & (x["initial"] == initial), _point(p, more, "K", "K"))
    give = lambda p, step: F.when(stays, _point(p, more + REROLE, "R", step))
    before_user = (nothing, system, assistant)
    return _states([
        drop(nothing),
        F.least(drop(system), keep(nothing, "s")),
        F.least(drop(user), *(keep(p, "u") for p in before_user), *(give(p, "U") for p in before_user)),
        F.least(drop(assistant), keep(user, "a"), give(user, "A")),
    ])


def _entered(e: Column) -> Column:
    start = lambda k: F.struct(F.when(e == k, 0).otherwise(NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))
    return _states([start(k) for k in range(STATES)])


def _after_block(s: Column, block: Column) -> Column:
    """States after a block that was folded for each state it can be entered in (the first block only for the first)."""

    def through(e: int, k: int) -> Column:
        p, q = _at(s, e), _at(F.get(block, F.lit(e)), k)
        both = F.struct((p["cost"] + q["cost"]).alias("cost"), F.concat(p["audit"], q["audit"]).alias("audit"), F.concat(p["path"], q["path"]).alias("path"))
        return F.when(q["cost"].isNotNull(), both)

    return _states([F.least(*(through(e, k) for e in range(STATES))) for k in range(STATES)])


def cheapest(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, path: one row for each conversation of turns_of().

    path spells the edits with their roles: K kept, D deleted, U and A given the role, u and a inserted.
    """
    x = F.struct("pos", "initial", "fault")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    tallies = [count(F.col("fault") == n).alias(n) for n in ("blank", "duplicate", "truncated")] + [count(F.col("illegal")).alias("illegal"), count(F.col("new_turn")).alias("n_turns")]
    parts = turns.groupBy("conv", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(x)).alias("xs"), F.min("turn").alias("first"), F.max("turn").alias("last"), *tallies)
    entries = F.when(F.col("block") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(STATES))))
    fold = F.transform(entries, lambda e: F.aggregate("xs", _entered(e), lambda s, x: _let(_with_inserts(s), lambda c: _turn(c, x))))
    parts = parts.withColumn("fold", fold).drop("xs")
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "fold"))).alias("folds"), F.min("first").alias("first"), F.max("last").alias("last"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "n_turns")))
    state = F.aggregate("folds", _entered(F.lit(0)), lambda s, b: _after_block(s, b["fold"]))
    whole = whole.withColumn("best", _let(_with_inserts(state), lambda c: F.least(_at(c, 0), _at(c, 3))))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.path")


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, at, nth, role, text, edit: the turns after the edits of plans, by (at, nth) in each conversation. Deleted ones are left out, inserted ones have an empty text."""
    steps = plans.select("conv", F.posexplode(F.regexp_extract_all("path", F.lit("[ua]*[UAKD]|[ua]+$"), F.lit(0))).alias("at", "step"))
    own = turns.select(F.col("conv").alias("own_conv"), "pos", "role", "text")
    both = steps.join(own, steps.conv.eqNullSafe(own.own_conv) & (steps.at == own.pos), "left")
    made = F.transform(F.split("step", ""), lambda c: F.struct(F.when(c.isin("u", "U"), "user").when(c.isin("a", "A"), "assistant").otherwise(F.col("role")).alias("role"), F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text"), F.translate(c, "uaUA", "IIRR").alias("edit")))
    rows = both.select("conv", "at", F.posexplode(F.filter(made, lambda m: ~m["edit"].isin("D", ""))).alias("nth", "made"))
    return rows.select("conv", "at", "nth", "made.*")


def digests(rows: DataFrame) -> DataFrame:
    """conv, sha256 of its turns as `role:text`, newline-joined. Rows of a conversation are streamed in order, so its length is not bounded by memory."""
    conv = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done: list[tuple] = []
            for c, role, text in zip(b["conv"], b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
                if sha is None or c != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
            yield _batch(done, b.schema.field("conv").type)
        if sha is not None:
            yield _batch([(now, sha.hexdigest())], now.type)

    return kernel(rows.repartition("conv").sortWithinPartitions("conv", "at", "nth").select("conv", "role", "text"), run, f"conv {conv}, sha256 string")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c.as_py() for c, _ in rows], kind), pa.array([x for _, x in rows], pa.string())], names=["conv", "sha256"])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(plans, turns): one row of faults and edits for each conversation, and the repaired turns. Empty tables give empty ones; other columns are not read."""
    turns = materialise(turns_of(rows, conv, turn, role, text), "turns")
    plans = materialise(cheapest(turns, block), "repair-plans")
    return plans, repaired(turns, plans)


def joined(frames: list[DataFrame], key: str) -> DataFrame:
    """Left joins on a key whose nulls are equal; the key of the first stays."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed(key, f"{key}_b")
        return a.join(b, a[key].eqNullSafe(b[f"{key}_b"]), "left").drop(f"{key}_b")

    return reduce(add, frames)
