import duckdb
import pytest

from faceoff.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op4_ngram_jaccard_join", "op7_substring_dedup", "op8_embedding_near_dedup", "op12_hard_negatives"])
def test_query_equals_sql(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(sorted(zip(names, r, strict=True))) for r in result.fetchall())
    assert sorted(tuple(sorted(r.asDict().items())) for r in QUERIES[name](spark, path).collect()) == want
