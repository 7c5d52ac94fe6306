import os

import pytest

import corpus_pipeline
from runlens.llm import queries

OPS = sorted(queries.QUERIES, key=lambda k: int(k[2:].split("_")[0]))


def test_operators():
    assert [int(k[2:].split("_")[0]) for k in OPS] == list(range(1, 14))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]


@pytest.mark.parametrize("name", OPS)
def test_query_covers_its_whole_table(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    key = next(k for k in ("page_id", "conv_id", "doc_id") if k in df.columns)
    whole = spark.read.parquet(f"{sf}/{ {'page_id': 'pages', 'conv_id': 'conversations', 'doc_id': 'documents'}[key] }.parquet").select(key).distinct()
    if key == "conv_id":  # a row per node: every conversation is a member of the root
        assert df.where("depth = 0").first()["n_convs"] == whole.count()
        return
    assert df.select(key).distinct().count() == whole.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf, name, at):
    import duckdb
    path = os.path.join(os.path.dirname(sf), at)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    df = queries.QUERIES[name](spark, path)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(repr, df.select(*rel.columns).collect())) == sorted(
        "Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(rel.columns, r)) + ")" for r in rel.fetchall())


def test_sql_of_the_mixture_on_edges(spark, edge, tmp_path):
    """The same query on nulls, empty texts and clashing columns (ids made unique)."""
    import duckdb
    rows = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.QUERIES["op1_mixture"](spark, str(tmp_path))
    rel = con.sql(queries.ORACLES["op1_mixture"])
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
