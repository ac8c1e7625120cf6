import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motifmill.llm import queries as Q
from motifmill.llm import token_files as T
from motifmill.llm import tokens


@pytest.fixture(scope="module")
def both():
    """Each encoder with the library's plain reading of its file."""
    kinds = ("byte_bpe_50k.json", tokens.byte_piece), ("word_bpe_49k.json", tokens.word_piece)
    return [(tokens.Encoder(public.path(name), piece), Tokenizer.from_file(public.path(name))) for name, piece in kinds]


def same(both, text):
    return all(list(t.encode(text)) == file.encode(text, add_special_tokens=False).ids for t, file in both)


PARTS = ["'s", "'ll", "don't", " ", "é", "e\u0301", "ß", "2", "²", "a", "AB", "\n", "  ", "_", "-", "!'s", "ª", "µ", "x1y", "ÿ", "\x0c", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "ς", "日", "İ", "😀"]


def test_random_texts_give_the_files_ids(both):
    """Among them the strings of special tokens, which are those tokens."""
    rng = random.Random(1)
    for k in range(4000):
        text = "".join(rng.choices([chr(c) for c in range(0x250)] if k % 3 == 0 else PARTS, k=rng.randint(0, 25)))
        assert same(both, text), repr(text)


@given(st.text(max_size=40))
@settings(max_examples=500, deadline=None)
def test_any_text(both, text):
    assert same(both, text)


def test_special_tokens(both):
    assert list(both[0][0].encode("a <|endoftext|> b")) == [64, 220, 50256, 275]
    assert list(both[1][0].encode("a <|endoftext|> b")) == [320, 49407, 321]


def test_chunks_are_forgotten_and_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 3)
    t = tokens.Encoder(public.path("word_bpe_49k.json"), tokens.word_piece)
    file = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for text in ("one two three four five six one two", "six five four", "y" * 100 + " one"):
        assert list(t.encode(text)) == file.encode(text, add_special_tokens=False).ids
        assert len(t) <= 3


def test_sample_texts(both, sample):
    for r in sample.collect():
        assert same(both, r.text)


@pytest.mark.parametrize("text", ["A" * 50_000, " " * 50_000, "ab " * 20_000, "\n" * 500 + "x" * 399 + " y", "!" * 30_000])
def test_long_runs(both, text):
    assert same(both, text)


def round_trip(spark, df, path):
    file = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    T.write_ids(df, path, Q.word_bpe(), 1)
    rows = [(r.doc_id, file.encode(r.text or "", add_special_tokens=False).ids + [1], r.text or "") for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2].encode()))
    want, start = [], 0
    for i, ids, _ in rows:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    got = sorted(map(tuple, T.checked(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    read = T.read_ids(spark, path)
    assert sorted(r.n_tokens for r in read.select("n_tokens").collect()) == sorted(w[2] for w in want)


def test_edge_rows(spark, edge, tmp_path):
    round_trip(spark, edge, str(tmp_path / "ids"))


def test_sample(spark, sample, tmp_path):
    round_trip(spark, sample.repartition(5), str(tmp_path / "ids"))


def test_selective_reads_and_encodings(spark, sample, tmp_path):
    import pyarrow.parquet as pq

    T.write_ids(sample, str(tmp_path / "ids"), Q.word_bpe(), 1, row_group_bytes=1 << 20)
    one = T.read_ids(spark, str(tmp_path / "ids")).where("doc_id = 7").select("n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert one.count() == 1
    meta = pq.ParquetFile(next((tmp_path / "ids").glob("*.parquet"))).metadata.row_group(0)
    ids = next(meta.column(k) for k in range(meta.num_columns) if meta.column(k).path_in_schema.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index


def test_empty(spark, empty, tmp_path):
    T.write_ids(empty, str(tmp_path / "ids"), Q.word_bpe(), 1)
    assert T.checked(spark, str(tmp_path / "ids")).count() == 0


def test_texts_that_stay_whole_are_told_without_a_pattern(both):
    """Every character that Unicode calls a blank, and every special token, at any width of the text's characters."""
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace() and c not in (0x20, *range(9, 14), *range(0x1C, 0x20))]
    for t, _ in both:
        for part in [*blanks, *t.special]:
            for other in ("a", "é", "日", "😀"):
                assert t.uncut(f"{other} b{part}c")
        assert not any(t.uncut(x) for x in ("", "a b\n", "é <|", "日\x1c\t本", "😀 <|endoftext"))
