import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from motifmill.llm import jaccard_join, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, edge):
    docs = edge
    sizes = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        sizes.append(len(rows))
        if k < len(P.STAGES) - 1:
            assert out.columns == edge.columns
            docs = P.materialise(out, "test")
    assert all(a >= b for a, b in zip(sizes[:3], sizes[1:4], strict=True))


def test_columns_of_any_name_and_type(spark, edge):
    """Dots, backticks, maps, and the names that stages use inside."""
    odd = edge.withColumns({"a.b": F.lit(1), "c`d": F.lit("x"), "map": F.create_map(F.lit("k"), F.col("doc_id")), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit(2)).alias("m")))})
    for name in ("n", "part", "side", "spot", "good", "text_hash", "row_key", "_mm_row", "_mm_id", "_mm_hash", "_mm_cuts", "uid", "hits", "word"):
        odd = odd.withColumn(name, F.lit(7))
    odd = P.materialise(odd, "odd")
    plain = P.materialise(edge, "plain")
    for k, (_, stage) in enumerate(P.STAGES):
        out, want = stage(spark, odd, SF), stage(spark, plain, SF)
        if k == len(P.STAGES) - 1:
            assert out.count() == want.count()
            break
        assert out.columns == odd.columns
        odd, plain = P.materialise(out, "odd"), P.materialise(want, "plain")
        core = ["doc_id", "text", "lang", "source", "n_chars"]
        assert rows_of(odd.select(core)) == rows_of(plain.select(core))


def test_each_stage_decides(spark, sample):
    from test_jaccard_join import brute
    from test_line_dedup import brute as lines
    from test_mixing import brute as mix

    kept = P.materialise(P.quality_rules(spark, sample, SF), "q")
    cut = P.materialise(P.dedup_lines(spark, kept, SF), "l")
    assert sorted([(r.doc_id, r.text) for r in cut.collect()], key=repr) == lines([(r.doc_id, r.text) for r in kept.collect()], 50)
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    alone = P.materialise(P.join_near_copies(spark, cut, SF), "j")
    groups = brute([(r.doc_id, r.text) for r in cut.collect()], jaccard_join.Measure(5, 80, 100))
    assert rows_of(alone) == sorted((tuple(r) for r in cut.collect() if groups[r.doc_id][1] == r.doc_id), key=repr)
    mixed = P.materialise(P.mix_sources(spark, alone, SF), "m")
    ids = {r[0] for r in mix(alone, queries.levels(), queries.weights, P.BUDGET_SHARE, 1, queries.SEED)}
    assert rows_of(mixed) == sorted((tuple(r) for r in alone.collect() if r.doc_id in ids), key=repr)
    packed = P.pack_sequences(spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    assert mixing.words_of is not None


def cells(df):
    """Rows in order; nulls and numbers alike in both engines."""
    value = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 9)
    return sorted((tuple(map(value, row)) for row in df.astype(object).itertuples(index=False, name=None)), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


TEXT = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"v{k}" for k in range(60))


def test_near_copies_lose_no_other_row(spark):
    """Rows that share an id with a near copy, rows without an id, empty and repeated rows."""
    rows = [
        (1, TEXT, "en", "src1", 1),
        (2, TEXT + " more", "en", "src1", 1),  # the near copy
        (2, OTHER, "en", "src1", 1),  # its id, another text
        (None, TEXT, "en", "src1", 1),
        (None, TEXT, "en", "src1", 1),
        (3, None, None, None, None),
        (3, "", "en", "src1", 0),
        (1, "a b c", "en", "src1", 1),
        (4, "q r s", "de", "src2", 1),
        (4, "q r s", "en", "src1", 1),  # repeats with other columns: one of both
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = rows_of(P.join_near_copies(spark, df, SF))
    twins = [r for r in got if r[0] == 4]
    assert len(twins) == 1 and twins[0] in rows
    assert [r for r in got if r[0] != 4] == sorted((r for k, r in enumerate(rows) if k not in (1, 8, 9)), key=repr)


def test_mixing_keeps_chosen_rows_whatever_their_ids(spark, monkeypatch):
    """One leaf: twins are chosen one by one, rows without an id and rows that share one by themselves."""
    word = lambda n: " ".join(["w"] * n)
    rows = [(7, word(10), "en", "src4", 1)] * 3 + [(None, word(9), "en", "src4", 1), (8, word(8), "en", "src4", 1), (8, word(11), "en", "src4", 1), (9, None, "en", "src4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    total = sum(len((r[1] or "").split()) for r in rows)
    seen = set()
    for share in (0.0, 0.2, 0.4, 0.5, 0.7, 0.8, 0.9, 1.0):
        monkeypatch.setattr(P, "BUDGET_SHARE", share)
        got = rows_of(P.mix_sources(spark, df, SF))
        chosen = mixing.mix(df, queries.levels(), queries.weights, share, 1, queries.SEED).collect()
        assert sorted(((r[0], len((r[1] or "").split())) for r in got), key=repr) == sorted(((r.id, r.tokens) for r in chosen), key=repr)
        assert sum(len((r[1] or "").split()) for r in got) <= share * total
        seen.add(sum(r[0] == 7 for r in got))
    assert len(seen) > 2 and rows_of(df) == got  # with the whole budget, every row


def test_empty_and_null_tables(spark, empty):
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert cells(got[columns]) == cells(want[columns])


def test_all_queries_are_registered():
    names = entry.queries()
    assert [n for n in (f"op{k}_" for k in range(1, 11)) if not any(x.startswith(n) for x in names)] == []
    assert names["pipeline"] is P.run
