"""The subpackage's SQL against its queries, over whole tables."""

import duckdb
import pytest

from candela.llm import registry


def cells(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations", "labels", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/sf0.001/{table}.parquet'")
    df = registry.QUERIES[name](spark, f"{data}/sf0.001")
    columns = sorted(df.columns)
    expected = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert cells(map(tuple, df.select(*columns).collect())) == cells(expected)
