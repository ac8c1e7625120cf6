"""N-gram Jaccard join with PartEnum signatures.

Sets whose sizes fall into one band, or into neighbouring ones, have a bounded Hamming distance k if they are similar enough. For each
band the feature domain is cut into first-level partitions, and each of these into SECOND second-level ones. Two similar sets
differ by at most one element in some first-level partition, hence agree on all but one of its second-level ones: the enumerated
subsets of SECOND - 1 second-level partitions are the signatures, and similar sets share one. No similar pair is missed.

Sets that are equal are joined by their digest first. Of the sets that share a signature the smallest is compared with the others, which
joins many of a group of near copies. For components that still share a signature, parity sketches bound the Hamming distance from
below: a forest of the links they allow is verified on the sets themselves, until no allowed link between components is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, kernel, materialise, small
from .components import components

SECOND = 3
#: Share of first-level partitions that there are to spare, in percent. A linked pair agrees in more of them than are to spare, so each
#: set leaves out signatures of subsets that say little, below a score of up to LEAST_SCORE, as far as no more partitions have such subsets.
SPARE = 15
LEAST_SCORE = 6
#: An element scores 1, and RARE more unless it is among the FREQUENT most frequent shingles. Which ones these are only
#: decides about the number of candidates, as both sets of a pair judge a subset on which they agree alike.
RARE = 2
FREQUENT = 20_000
FREQUENT_WINDOW = 1_000_000
FREQUENT_BITS = 20
#: Words of a sketch at least.
SKETCH_WORDS = 16
#: Signatures that one reducing group is meant to hold.
BUCKET_SIGNATURES = 500_000
FLUSH = 1_000_000

SIGNATURE_BITS = 40
#: Rounds that verify trees of allowed pairs; after them each member's EACH nearest pairs a round.
TREES = 2
EACH = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Measure:
    """Words of a shingle; two sets link if den * |a & b| >= num * |a | b|."""

    n: int = 5
    num: int = 80
    den: int = 100

    def bands(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper end of each size band, and its Hamming bound."""
        ends, low = [], 1
        while low <= most or len(ends) < 2:
            ends.append(low * self.den // self.num)
            low = ends[-1] + 1
        ends.append(low * self.den // self.num)
        r = np.array(ends, np.int64)
        return r, 2 * r * (self.den - self.num) // (self.den + self.num)

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest Hamming distance of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """a and b: sorted distinct shingle hashes."""
        if not len(a) or not len(b):
            return False
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        inter = int(np.count_nonzero(both[1:] == both[:-1]))
        return self.den * inter >= self.num * (len(both) - inter)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text; a shorter text has its whole sequence as one."""
    j = K.Joined(texts)
    j.buf = _LOWER[j.buf]
    _, _, h, doc = j.words()
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(K.gram_hash(h[lo:hi], n)))
        elif hi > lo:
            out.append(K.gram_hash(h[lo:hi], hi - lo) + np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    a = int(np.sum(K.mix64(s ^ np.uint64(0x51ED270B))))
    b = int(np.sum(K.mix64(s ^ np.uint64(0xA24BAED4963EE407))))
    return _signed(a & (1 << 64) - 1), _signed(b & (1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Frequent:
    """The most frequent elements of a task's sets: of each window those found three times or more, added up and cut back to a bounded number."""

    def __init__(self):
        self.window: list[np.ndarray] = []
        self.held = 0
        self.element, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.window.append(s)
        self.held += len(s)
        if self.held >= FREQUENT_WINDOW:
            self.close()

    def close(self) -> None:
        if not self.held:
            return
        x, n = np.unique(np.concatenate(self.window), return_counts=True)
        x, n = np.append(self.element, x[n > 2]), np.append(self.count, n[n > 2])
        self.element, at = np.unique(x, return_inverse=True)
        self.count = np.bincount(at, n, len(self.element)).astype(np.int64)
        top = np.argsort(-self.count, kind="stable")[: 2 * FREQUENT]
        self.element, self.count = self.element[top], self.count[top]
        self.window, self.held = [], 0


def frequent_bits(elements: np.ndarray) -> np.ndarray:
    """A bit for each low part of a hash; elements that meet a frequent one there count as frequent too."""
    out = np.zeros(1 << FREQUENT_BITS, bool)
    out[(elements & np.uint64((1 << FREQUENT_BITS) - 1)).astype(np.int64)] = True
    return out


def signatures(s: np.ndarray, ends: np.ndarray, bound: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set: in its own band's instance and in the next one's."""
    own = int(np.searchsorted(ends, len(s)))
    score = 1.0 + RARE * ~frequent[(s & np.uint64((1 << FREQUENT_BITS) - 1)).astype(np.int64)]
    out = []
    for i in (own, own + 1):
        k = int(bound[i])
        if k == 0 or not len(s):
            continue  # only equal sets are that close
        spare = max(int(k > 3), (k // 2 + 1) * SPARE // 100)
        n1 = k // 2 + 1 + spare
        value = K.mix64(s + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
        cell = (value >> np.uint64(33)).astype(np.int64) % n1 * SECOND + (value & np.uint64(0xFFFFFFF)).astype(np.int64) % SECOND
        total = np.zeros(n1 * SECOND, np.uint64)
        np.add.at(total, cell, K.mix64(value))
        total = total.reshape(n1, SECOND)
        rest = total.sum(1, keepdims=True) - total
        worth = np.bincount(cell, score, n1 * SECOND).reshape(n1, SECOND)
        worth = worth.sum(1, keepdims=True) - worth
        # Of two linked sets take the one with the higher limit: some partition on which they agree has no subset below it, in either.
        least = worth.min(1)
        limit = next(c for c in range(LEAST_SCORE, -1, -1) if np.count_nonzero(least < c) <= spare)
        name = K.mix64(np.arange(n1 * SECOND, dtype=np.uint64) + np.uint64((i + 1) << 32)).reshape(n1, SECOND)
        sig = K.mix64(rest * np.uint64(0x9FB21C651E98DF25) + name)
        out.append(sig[worth >= limit])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each bit: two sketches differ in no more bits than the sets in elements.

    With two bits an element or more, few linkable distances are hidden by elements that meet on a bit.
    """
    bits = max(SKETCH_WORDS * 64, 1 << (2 * len(s) - 1).bit_length())
    bit = (K.mix64(s ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(20)).astype(np.int64) & (bits - 1)
    odd = (np.bincount(bit, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _sets(docs: DataFrame, measure: Measure) -> DataFrame:
    """id, t, n, node and node2 (digest of the set) of each row (id, t, text); with n = -1 a frequent shingle and its count in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent()
        for b in batches:
            texts = K.as_bytes(b["text"])
            for lo, hi in K.slices(texts):
                sets = shingle_sets(texts[lo:hi], measure.n)
                for x in sets:
                    frequent.add(x)
                d = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([b["id"].slice(lo, hi - lo), b["t"].slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64())], names=["id", "t", "n", "node", "node2"])
        frequent.close()
        m = len(frequent.element)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.full(m, -1)), pa.array(frequent.element.view(np.int64)), pa.array(frequent.count)], names=["id", "t", "n", "node", "node2"])

    return kernel(docs, run, "id long, t long, n long, node long, node2 long")


def planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, the lowest of all first: high bytes that are alike then take almost no room in a compressed shuffle."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _shared(texts: DataFrame, measure: Measure, most: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """sig, leader, node of the sets that share a signature with another; leader is the smallest node. texts: node (null for the set's digest), text.

    Signatures are cut to SIGNATURE_BITS below their bucket; the few that meet by chance are candidates like others.
    """
    ends, bound = measure.bands(most)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    low = np.uint64(64 - (buckets.bit_length() - 1) - SIGNATURE_BITS)

    def emit(sig: list[np.ndarray], node: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, d = np.concatenate(sig) >> low, np.concatenate(node)
        order = np.argsort(s)
        s, d = s[order], d[order]
        bucket = (s >> (shift - low)).astype(np.int64)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        step = np.diff(s, prepend=np.uint64(0))
        for lo in range(0, buckets, 16):
            ks = [k for k in range(lo, min(lo + 16, buckets)) if at[k] < at[k + 1]]
            if ks:
                first = [int(s[at[k]]) for k in ks]
                sigs = [planes(np.concatenate([[np.uint64(0)], step[at[k] + 1 : at[k + 1]]])) for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(first, pa.int64()), pa.array(sigs, pa.binary()), pa.array([planes(d[at[k] : at[k + 1]]) for k in ks], pa.binary())], names=["bucket", "first", "sigs", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig: list[np.ndarray] = []
        node: list[np.ndarray] = []
        held = 0
        for b in batches:
            texts, ids = K.as_bytes(b["text"]), b["node"].to_pylist()
            for lo, hi in K.slices(texts):
                for s, i in zip(shingle_sets(texts[lo:hi], measure.n), ids[lo:hi], strict=True):
                    x = signatures(s, ends, bound, frequent)
                    if len(x):
                        sig.append(x)
                        node.append(np.full(len(x), digest(s)[0] if i is None else i, np.int64))
                        held += len(x)
                if held > FLUSH:
                    yield from emit(sig, node)
                    sig, node, held = [], [], 0
        if held:
            yield from emit(sig, node)

    def meet(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.cumsum(from_planes(x)) + np.uint64(f), from_planes(y).view(np.int64)) for b in batches for f, x, y in zip(b["first"].to_pylist(), b["sigs"].to_pylist(), b["nodes"].to_pylist(), strict=True)]
        s, d = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        del parts
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        again = np.concatenate([[False], (s[1:] == s[:-1]) & (d[1:] == d[:-1])])
        s, d = s[~again], d[~again]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(s)))
        keep = np.repeat(size > 1, size)
        leader = np.repeat(d[start], size)
        s, d, leader = s[keep], d[keep], leader[keep]
        for lo in range(0, len(s), 100_000):
            hi = lo + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(s[lo:hi].view(np.int64)), pa.array(leader[lo:hi]), pa.array(d[lo:hi])], names=["sig", "leader", "node"])

    blobs = kernel(texts.select("node", "text"), run, "bucket int, first long, sigs binary, nodes binary")
    # These annotations choose the form of applyInArrow that gives batches.
    meet.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return blobs.groupBy("bucket").applyInArrow(meet, "sig long, leader long, node long")


def _store(docs: DataFrame, measure: Measure) -> DataFrame:
    """node, n, sketch, body (sorted hashes) of each row. docs: node (null for the set's digest), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = K.as_bytes(b["text"])
            for lo, hi in K.slices(texts):
                sets = shingle_sets(texts[lo:hi], measure.n)
                node = [digest(s)[0] if i is None else i for s, i in zip(sets, b["node"].slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "sketch", "body"])

    return kernel(docs, run, "node long, n long, sketch binary, body binary")


def _verify(pairs: DataFrame, store: DataFrame, measure: Measure) -> DataFrame:
    """a, b, linked of each pair, by the sets themselves."""
    bodies = store.select("node", "body")
    rows = pairs.select("a", "b").join(bodies.toDF("b", "body_b"), "b").join(bodies.toDF("a", "body_a"), "a").select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [measure.linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b["body_a"], b["body_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return kernel(rows, run, "a long, b long, linked boolean")


def fold(sk: np.ndarray, words: int) -> np.ndarray:
    """The same sketch over fewer bits."""
    while len(sk) > words:
        sk = sk[: len(sk) // 2] ^ sk[len(sk) // 2 :]
    return sk


class Forest:
    """Pairs of different components that the sketches allow and nobody has rejected, from the members of one signature after another.

    ``each`` None: one pair for each join of components, so that a group of near copies gives a tree. Else: each member's ``each``
    nearest pairs. Either way the pairs are as many as the members at most, times a constant. A signature with an allowed pair stays alive,
    and so does one with members that only pairs of earlier signatures, not verified yet, have joined: they are looked at again if those fail.
    """

    def __init__(self, measure: Measure, each: int | None):
        self.measure = measure
        self.each = each
        self.parent: dict[int, int] = {}
        self.out: dict[tuple[int, int], int] = {}
        self.alive: list[int] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def put(self, a: int, b: int, d: int) -> None:
        self.out[(a, b) if a < b else (b, a)] = d

    def add(self, sig: int, node: list[int], comp: list[int], n: np.ndarray, sketches: list[bytes], no: list[list[int] | None]) -> None:
        label = np.array([self.root(c) for c in comp] if self.each is None else comp)
        found = len(set(label.tolist())) < len(set(comp))  # joined here, but not verified yet
        if (label == label[0]).all():
            self.alive.append(sig)
            return
        sks = [np.frombuffer(x, np.uint64) for x in sketches]
        words = min(map(len, sks))
        sk = np.stack([fold(x, words) for x in sks])
        rest = np.arange(len(node))

        def allowed(k: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = np.bitwise_count(sk[among] ^ sk[k]).sum(1)
            ok = np.flatnonzero(d <= self.measure.reach(n[among], n[k]))
            if no[k] and len(ok):
                banned = set(no[k])
                ok = np.array([x for x in ok if node[among[x]] not in banned], int)
            return ok[np.argsort(d[ok], kind="stable")], d

        if self.each is not None:
            for k in range(len(node) - 1):
                among = rest[k + 1 :][label[k + 1 :] != label[k]]
                if len(among):
                    ok, d = allowed(k, among)
                    found |= len(ok) > 0
                    for x in ok[: self.each]:
                        self.put(node[k], node[among[x]], int(d[x]))
        while self.each is None and len(rest):
            queue = [k for k in rest if label[k] == label[rest[0]]]
            rest = rest[label[rest] != label[rest[0]]]
            while queue and len(rest):
                k = queue.pop()
                ok, d = allowed(k, rest)
                if not len(ok):
                    continue
                found = True
                joined = []
                for x in ok:
                    if label[rest[x]] not in joined:
                        joined.append(label[rest[x]])
                        self.put(node[k], node[rest[x]], int(d[x]))
                        self.parent[self.root(int(label[rest[x]]))] = self.root(int(label[k]))
                hit = np.isin(label[rest], joined)
                queue += list(rest[hit])
                rest = rest[~hit]
        if found:
            self.alive.append(sig)


def _allowed(members: DataFrame, measure: Measure, each: int | None) -> DataFrame:
    """sig of each signature that stays alive; a < b and distance of pairs to verify. members: sig, node, comp, n, sketch, no (rejected partners)."""
    rows = members.repartition("sig").sortWithinPartitions("sig", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(measure, each)
        held: list[tuple] = []

        def close() -> None:
            sig, node, comp, n, sk, no = zip(*held, strict=True)
            forest.add(sig[0], list(node), list(comp), np.array(n), list(sk), list(no))

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("sig", "node", "comp", "n", "sketch", "no")), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                    held = []
                held.append(row)
        if held:
            close()
        alive, pairs = forest.alive, forest.out
        none, no_sig = [None] * len(alive), [None] * len(pairs)
        columns = [
            pa.array(alive + no_sig, pa.int64()),
            pa.array(none + [a for a, _ in pairs], pa.int64()),
            pa.array(none + [b for _, b in pairs], pa.int64()),
            pa.array(none + list(pairs.values()), pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["sig", "a", "b", "distance"])

    return kernel(rows.select("sig", "node", "comp", "n", "sketch", "no"), run, "sig long, a long, b long, distance int")


def linked_nodes(shared: DataFrame, store: DataFrame, measure: Measure) -> DataFrame:
    """node, comp for every node that shares a signature: equal comp if linked, directly or not."""
    nodes = store.select("node", "n", "sketch")
    nearest = shared.where("leader != node").groupBy("leader", "node").count().groupBy("node").agg(F.max_by("leader", F.struct("count", F.negative("leader"))).alias("a"))
    checked = materialise(_verify(nearest.select("a", F.col("node").alias("b")), store, measure), "verified")
    used = [checked]  # read again each round
    comp = materialise(store.select("node", F.col("node").alias("comp")), "components")
    rejected = None
    tries = 0
    while True:
        linked = checked.where("linked").select("a", "b")
        if linked.limit(1).count():
            edges = linked.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            roots = components(edges).toDF("comp", "root")
            before, comp = comp, materialise(comp.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")
            discard(before)
        failed = checked.where("not linked").select("a", "b")
        rejected = failed if rejected is None else rejected.union(failed)
        partners = rejected.union(rejected.select("b", "a")).groupBy("a").agg(F.collect_list("b").alias("no")).withColumnRenamed("a", "node")
        members = shared.select("sig", "node").join(comp, "node")
        mixed = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
        members = members.join(mixed, "sig", "left_semi").join(nodes, "node").join(partners, "node", "left")
        found = materialise(_allowed(members, measure, None if tries < TREES else EACH), "allowed")
        pairs = found.where("a is not null").groupBy("a", "b").agg(F.min("distance").alias("distance"))
        if tries < TREES:
            best = lambda x, y: pairs.groupBy(x).agg(F.min_by(y, F.struct("distance", y)).alias(y)).select("a", "b")
            pairs = best("a", "b").union(best("b", "a")).distinct()
        pairs = materialise(pairs.select("a", "b"), "pairs")
        if not pairs.limit(1).count():
            discard(shared, found, pairs, *used)
            return comp
        before, shared = shared, materialise(shared.join(found.where("sig is not null").select("sig"), "sig", "left_semi"), "alive")
        discard(before, found)
        checked = materialise(_verify(pairs, store, measure), "verified")
        discard(pairs)
        used.append(checked)
        tries += 1


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = Measure()) -> DataFrame:
    """id, text_hash (xxhash64 of the text), n_shingles, component_id and first (the row stands for its component) of each row.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. A null or wordless text has the empty set and is linked with nothing. component_id is the smallest id
    reachable by links. Rows of equal sets are linked whatever their ids; rows that share an id but not a set are documents of their own, so only
    first tells which of them stands for a component: the smallest id, then the smallest text_hash, and all rows with both.
    A row with a null id is no link: its component_id is null. It is first, as is a row with the empty set. An empty table gives no rows. Sets are
    compared by 64-bit hashes of the shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    written = materialise(_sets(docs.withColumn("t", F.xxhash64("text")), measure), "shingle-sets")
    rows = written.where("n >= 0")
    head = F.min(F.struct("id", "t")).alias("head")
    classes = rows.where("n > 0 and id is not null").groupBy("n", "node", "node2").agg(head, F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("rep", F.col("head.id")), "set-classes")
    most, total = classes.agg(F.max("n"), F.sum("n")).collect()[0]
    if not most:
        return rows.select("id", F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("first"))
    # A set is known by the smallest id of its class, or by its digest if an id stands for more than one set.
    by_id = classes.groupBy("rep").count().where("count > 1").limit(1).count() == 0
    node = F.col("id") if by_id else F.lit(None).cast("long")
    classes = classes.withColumn("set_node", F.col("rep") if by_id else F.col("node"))
    # One text for each class: rows of other ids are taken out by an anti join, whose side is small where copies are few.
    copies = materialise(rows.where("n > 0 and id is not null").join(classes.select("node", "rep"), "node").where("id != rep").select("id").distinct().join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "copies")
    texts = docs.where("id is not null").join(small(copies), "id", "left_anti")
    counted = written.where("n < 0").groupBy("node").agg(F.sum("node2").alias("count"))
    top = counted.orderBy(F.desc("count"), "node").limit(FREQUENT).select("node").toPandas()  # FREQUENT rows at most
    frequent = frequent_bits(top.node.to_numpy(np.int64).view(np.uint64))
    buckets = 64
    while buckets * BUCKET_SIGNATURES < total:
        buckets *= 2
    shared = materialise(_shared(texts.select(node.alias("node"), "text"), measure, int(most), buckets, frequent), "shared-signatures")
    nodes = shared.select("node").distinct()
    wanted = materialise(classes.join(nodes.withColumnRenamed("node", "set_node"), "set_node", "left_semi").select(F.col("rep").alias("id")).distinct(), "candidates")
    store = materialise(_store(docs.join(small(wanted), "id").select(node.alias("node"), "text"), measure), "sets")
    if store.groupBy("node").count().where("count > 1").limit(1).count():  # rows that repeat
        store = materialise(store.dropDuplicates(["node"]), "sets")
    comp = linked_nodes(shared, store, measure)
    discard(copies, wanted, store)
    named = classes.join(comp.withColumnRenamed("node", "set_node"), "set_node", "left").withColumn("comp", F.coalesce("comp", "set_node"))
    least = named.groupBy("comp").agg(F.min("head").alias("least"))
    named = named.join(least, "comp").select("node", "least")
    out = rows.join(named, "node", "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id")
    first = (alone | (F.struct("id", "t") == F.col("least"))).alias("first")
    return out.select("id", F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), component, first)
