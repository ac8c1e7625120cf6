"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of levels (domain, language, source). Where a node can't use its share, the shortage goes to
its siblings first, and only what they can't take goes back up to the ancestors' level. A leaf's budget is then spent on a
prefix of its documents in a seeded order, epoch after epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kernel, materialise, small

#: Hex digits of the order that cut each leaf and epoch into slices, at least; a running total goes over slices first, so no task holds a leaf.
ORDER_DIGITS = 3
#: Rows of a slice of the largest leaf, about.
SLICE_ROWS = 1 << 16
#: Leaves whose totals the driver may hold; budgets of more go down level by level, one node's children at a time.
LEAVES = 1_000_000
_NULL = "\0null"


@dataclass
class Node:
    have: int = 0
    children: dict = field(default_factory=dict)
    got: int = 0


def share_out(budget: int, wants: Sequence[float], have: Sequence[int]) -> list[int]:
    """Split budget by weight; what a node can't use goes to the siblings that can, by weight again. Whole tokens, floors first."""
    got = [0] * len(have)
    open_ = [k for k in range(len(have)) if have[k] > 0 and wants[k] > 0]
    left = min(budget, sum(have[k] for k in open_))
    while open_ and left:
        total = sum(wants[k] for k in open_)
        full = [k for k in open_ if have[k] - got[k] <= left * wants[k] / total]
        if not full:
            parts = {k: int(left * wants[k] / total) for k in open_}
            over = left - sum(parts.values())
            for k in open_:
                step = min(1, over) if got[k] + parts[k] < have[k] else 0
                got[k] += parts[k] + step
                over -= step
            break
        for k in full:
            left -= have[k] - got[k]
            got[k] = have[k]
        open_ = [k for k in open_ if k not in full]
    return got


def allocate(totals: dict[tuple, int], budget: int, weights: Callable[[tuple], float]) -> dict[tuple, int]:
    """Tokens of each leaf. weights(path) weighs a node against its siblings; 0 leaves it out."""
    if not totals:
        return {}
    root = Node()
    for path, n in totals.items():
        node = root
        node.have += n
        for step in path:
            node = node.children.setdefault(step, Node())
            node.have += n

    def usable(node: Node, path: tuple) -> int:
        """What the subtree can take, without nodes of weight 0."""
        if node.children:
            node.have = sum(usable(c, (*path, s)) for s, c in node.children.items() if weights((*path, s)) > 0)
        return node.have

    out: dict[tuple, int] = {}

    def down(node: Node, path: tuple, tokens: int) -> None:
        if not node.children:
            out[path] = tokens
            return
        steps = sorted(node.children, key=lambda s: (s is None, s))
        for s, n in zip(steps, share_out(tokens, [weights((*path, s)) for s in steps], [node.children[s].have for s in steps]), strict=True):
            down(node.children[s], (*path, s), n)

    usable(root, ())
    down(root, (), min(budget, root.have))
    return out


def _path(row: dict, names: Sequence[str]) -> tuple:
    return tuple(None if row[n] == _NULL else row[n] for n in names)


def allocate_by_level(leaves: DataFrame, names: Sequence[str], budget: int, weights: Callable[[tuple], float]) -> DataFrame:
    """leaf_budget of each leaf (names, n), the same as allocate's: what subtrees can take goes up and budgets go down, a level at a time."""

    def weigh(depth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = [float(weights(_path(r, names[:depth]))) for r in b.select(names[:depth]).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], names=[*b.schema.names, "w"])

        return run

    def deal(depth: int):
        def run(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            step = names[depth - 1]
            rows.sort(key=lambda r: (r[step] == _NULL, r[step]))
            given = share_out(rows[0]["above"], [r["w"] for r in rows], [r["n"] for r in rows])
            columns = [pa.array([r[n] for r in rows], pa.string()) for n in names[:depth]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(given, pa.int64())], names=[*names[:depth], "above"])

        run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        return run

    schema = lambda depth: ", ".join(f"`{n}` string" for n in names[:depth])
    have = leaves.select(*(F.coalesce(F.col(n), F.lit(_NULL)).alias(n) for n in names), "n")
    nodes = {}
    for depth in range(len(names), 0, -1):
        nodes[depth] = materialise(kernel(have, weigh(depth), f"{schema(depth)}, n long, w double"), "mix-nodes")
        have = nodes[depth].groupBy(*names[: depth - 1]).agg(F.sum(F.when(F.col("w") > 0, F.col("n")).otherwise(0)).alias("n"))
    total = have.collect()[0]["n"] or 0
    given = leaves.sparkSession.createDataFrame([(min(budget, total),)], "above long")
    for depth in range(1, len(names) + 1):
        below = nodes[depth].join(given, names[: depth - 1]) if depth > 1 else nodes[depth].withColumn("above", F.lit(min(budget, total)))
        siblings = below.groupBy(*names[: depth - 1]) if depth > 1 else below.withColumn("top", F.lit(True)).groupBy("top")
        given = materialise(siblings.applyInArrow(deal(depth), f"{schema(depth)}, above long"), "mix-budgets")
    return given.select(*(F.when(F.col(n) != _NULL, F.col(n)).alias(n) for n in names), F.col("above").alias("leaf_budget"))


def words_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: Callable[[tuple], float], budget_share: float, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, row_key: Column | None = None, most_leaves: int = LEAVES) -> DataFrame:
    """id, the levels, epoch, tokens, leaf_budget, before (tokens of the leaf chosen earlier) and row_key (null unless given) of each chosen row.

    The budget is budget_share of all tokens (words unless ``tokens`` says otherwise). A leaf offers its documents ``epochs`` times, each in its own
    seeded order (hash, then id, then tokens); chosen is the longest prefix that stays within its budget, so at most one document's tokens are left unspent.
    Rows that tie in all of this (rows that repeat, or share id and tokens) follow each other by row_key, if there is one. Documents without tokens (null or empty text) are chosen while their place lies within the prefix. A null level value is
    a node of its own. Repeated rows count as often as they are there. An empty table gives no rows.
    """
    names = [n for n, _ in levels]
    count = words_of(text_col) if tokens is None else tokens
    key = F.lit(None).cast("long") if row_key is None else row_key
    base = docs.select(F.col(id_col).alias("id"), *(c.cast("string").alias(n) for n, c in levels), count.alias("tokens"), key.alias("row_key"))
    base = materialise(base, "mix-tokens")
    leaves = materialise(base.groupBy(*names).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")), "mix-leaves")
    n_leaves, total, largest = leaves.agg(F.count(F.lit(1)), F.sum("n"), F.max("rows")).collect()[0]
    budget = int((total or 0) * budget_share)
    offered = leaves.select(*names, (F.col("n") * epochs).alias("n"))
    spark = docs.sparkSession
    if n_leaves <= most_leaves:
        given = allocate({tuple(r[n] for n in names): int(r["n"]) for r in offered.collect()}, budget, weights)
        schema = ", ".join(f"`{n}` string" for n in names) + ", leaf_budget long"
        budgets = spark.createDataFrame([(*path, n) for path, n in given.items()], schema)
    else:
        budgets = allocate_by_level(offered, names, budget, weights)
    budgets = small(materialise(budgets, "mix-budgets"))
    digits = ORDER_DIGITS
    while (largest or 0) > SLICE_ROWS * 16**digits:
        digits += 1
    tagged = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(epochs, 1) - 1))).alias("epoch"))
    order = F.md5(F.encode(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("id").cast("string"), F.lit(""))), "UTF-8"))
    tagged = tagged.select("*", order.alias("h")).withColumn("slice", F.substring("h", 1, digits))
    leaf = [F.coalesce(F.col(n), F.lit(_NULL)).alias(n) for n in names]
    sums = tagged.groupBy(*leaf, "epoch", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = sums.select(*names, "epoch", "slice", F.coalesce(F.sum("in_slice").over(W.partitionBy(*names).orderBy("epoch", "slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ours = tagged.select("id", "row_key", "tokens", "epoch", "h", "slice", *leaf).join(before, [*names, "epoch", "slice"])
    inner = W.partitionBy(*names, "epoch", "slice").orderBy("h", "id", "tokens", "row_key").rowsBetween(W.unboundedPreceding, -1)
    placed = ours.withColumn("before", F.col("ahead") + F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    chosen = placed.select("id", "row_key", *(F.when(F.col(n) != _NULL, F.col(n)).alias(n) for n in names), "epoch", "tokens", "before")
    on = None
    for n in names:
        same = chosen[n].eqNullSafe(budgets[n])
        on = same if on is None else on & same
    return chosen.join(budgets, on).where("before + tokens <= leaf_budget").select("id", *(chosen[n] for n in names), "epoch", "tokens", "leaf_budget", "before", "row_key")
