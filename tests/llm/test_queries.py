"""The registered queries on the smallest tables, the pipeline's stages, and the SQL that some have."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import parity_join, secrets

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_neighbours", "op4_parity_join", "op8_mixing"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert columns == sorted(want.columns)
    assert sorted(map(plain, df.select(*columns).collect()), key=repr) == sorted((plain(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_oracle_sql_is_sql_that_runs():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str), name
        con.execute(sql).fetchone()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        kept[name] = out.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "n-gram Jaccard join":
            found = parity_join.near_duplicates(out).filter("n_shingles > 0")
            assert found.filter("doc_id <> component_id").isEmpty()
        if name == "secret scans":
            assert secrets.secrets(out).filter("size(base) > 0").isEmpty()
        docs = out
    assert kept["toxicity"] > 150 and kept["secret scans"] == kept["n-gram Jaccard join"] and kept["BPE encoding and decoding"] == kept["mixing sources to target weights"]
