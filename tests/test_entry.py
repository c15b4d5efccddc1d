"""Driver contract, recall of the approximate search, encoder shape, streaming equals batch."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import registry
from conftest import SF_CHECK

ROWS_ONLY = {"ann_topk", "ann_recall"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "similarity_score" in df.columns


def test_every_query_has_an_oracle_but_the_rows_only_ones():
    qs, sql = registry.queries(), registry.oracle_sql()
    assert set(qs) - set(sql) == ROWS_ONLY
    assert set(sql) <= set(qs)


@pytest.mark.parametrize("sf_dir", [SF_CHECK, "/root/testdata/sf0.1"])
def test_ann_recall(spark, sf_dir):
    r = entry.queries()["ann_recall"](spark, sf_dir).agg(F.avg("recall")).first()[0]
    assert r >= 0.9


def test_encoder_unit_norm(spark):
    df = entry.queries()["embed_catalog"](spark, SF_CHECK)
    row = df.agg(F.min("dim"), F.max("dim"), F.min("norm"), F.max("norm")).first()
    assert row[0] == row[1] == 256
    assert abs(row[2] - 1.0) < 1e-5 and abs(row[3] - 1.0) < 1e-5


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_upsert_equals_batch(spark):
    qs = entry.queries()
    assert _rows(qs["stream_upsert"](spark, SF_CHECK)) == _rows(qs["catalog_upsert"](spark, SF_CHECK))


def test_oracle_match_topk(spark, duck):
    df = entry.queries()["match_topk"](spark, SF_CHECK)
    got = sorted((r["query_id"], r["rank"], r["product_id"]) for r in df.collect())
    exp = sorted((r[0], r[1], r[2]) for r in duck.execute(
        f"SELECT query_id, rank, product_id FROM ({entry.oracle_sql()['match_topk']})").fetchall())
    assert got == exp
