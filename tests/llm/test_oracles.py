"""The queries that SQL can express, and the pipeline, on small tables."""

import os

import duckdb
import pytest

from quillgate.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM read_parquet('{SF}/{table}')")
    ref = con.execute(ORACLES[name])
    columns = [c[0] for c in ref.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect()) == sorted(repr([plain(v) for v in r]) for r in ref.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        after = docs.count()
        if name != "packing":
            assert docs.columns == names and 0 < after
        if name in ("toxicity", "near_dedup"):
            assert after <= before
        if name == "line_dedup":
            assert after == before
        before = after
    assert before > 0
