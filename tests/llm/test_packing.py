import zlib
from collections import defaultdict

import numpy as np
import pytest

from motifmill.llm import packing as P
from motifmill.llm import queries as Q


def naive_first_fit(sizes, length):
    bins, room = [], []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b, r in enumerate(room):
            if r >= sizes[item]:
                bins[b].append(item)
                room[b] -= sizes[item]
                break
        else:
            bins.append([item])
            room.append(length - sizes[item])
    return bins


@pytest.mark.parametrize("seed", range(20))
def test_tournament_is_first_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    sizes = list(map(int, rng.integers(1, 101, int(rng.integers(1, 200)))))
    assert P.first_fit_decreasing(sizes, 100) == naive_first_fit(sizes, 100)


@pytest.mark.parametrize("seed", range(20))
def test_one_open_sequence_a_group(seed):
    rng = np.random.default_rng(seed)
    sizes = list(map(int, rng.integers(1, 400, int(rng.integers(1, 60)))))
    packed = P.pack_group(sizes, 64)
    fill = [sum(n for _, _, n in b) for b in packed]
    assert max(fill) <= 64 and sum(f < 64 for f in fill) <= 1
    seen = defaultdict(list)
    for b in packed:
        for doc, start, n in b:
            seen[doc] += range(start, start + n)
    assert {d: sorted(v) for d, v in seen.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}


def whole(df, **options):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted([(r.doc_id, tuple(file.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in df.select("doc_id", "text").collect()], key=repr)
    rows = P.pack(df, Q.byte_bpe(), 0, with_ids=True, seed=1, **options).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(t) for _, t in want)
    if len({w[0] for w in want}) == len(want):
        docs = defaultdict(list)
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == len(docs[r.doc_id])
            docs[r.doc_id] += r.ids
        assert sorted([(d, tuple(v)) for d, v in docs.items()], key=repr) == want
    return rows, sequences


def test_edge_rows(edge):
    whole(edge)


def test_sample_in_small_groups(sample):
    rows, sequences = whole(sample, group_docs=20)
    tokens = sum(r.length for r in rows)
    assert len(sequences) * 1024 < 1.12 * tokens


def test_same_pieces_again(sample):
    one, two = (sorted(map(tuple, P.pack(sample.repartition(n), Q.byte_bpe(), 0).collect())) for n in (2, 7))
    assert one == two


def test_rows_repeated_beyond_a_group(spark):
    """A third of all rows is one row: it is dealt out by input partition, and no sequence number comes twice."""
    rows = [(7, "the same row again")] * 100 + [(k, f"row number {k} of its own") for k in range(200)]
    rows, sequences = whole(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), group_docs=10)
    assert len({s >> P.PART_BITS + P.SEQUENCE_BITS for s in (r.sequence_id for r in rows if r.doc_id == 7)}) > 1
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)


def test_many_parts_of_a_group():
    table = [P._pieces([1], [np.arange(3, dtype="<u4")], 5, part, 64, False) for part in (0, 1, 4096, 5000)]
    ids = [t["sequence_id"][0].as_py() for t in table]
    assert len(set(ids)) == 4 and max(ids) < P._pieces([1], [np.arange(3, dtype="<u4")], 6, 0, 64, False)["sequence_id"][0].as_py()
    with pytest.raises(OverflowError):
        P._pieces([1], [np.arange(3, dtype="<u4")], 0, 1 << P.PART_BITS, 64, False)


def test_empty(empty):
    assert P.pack(empty, Q.byte_bpe(), 0).count() == 0
