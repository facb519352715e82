"""Every archive query against DuckDB on the smallest tables."""

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str([int(x) for x in value]) if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and hasattr(value, "__len__") else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "events", "conversations", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_duckdb(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert found.limit(1).count() >= 0
        return
    wanted = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(tuple(plain(v) for v in r) for r in wanted.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in found.select(*columns).collect()) == rows


def test_offsets_of_chapters_without_sentences_match_duckdb(spark, tmp_path):
    texts = [(1, "One. Two two.", "a"), (2, " \n ", "a"), (3, "", "b"), (4, None, "b"), (5, "x" * 900, None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(registry.oracle_sql()["offsets_to_sentences"]).fetchall()
    found = registry.queries()["offsets_to_sentences"](spark, str(tmp_path)).select("chapter_id", "offset", "sentence_index").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert len(wanted) == 20 and (1, 100, 1) in wanted and (3, 0, None) in wanted and (4, 777, None) in wanted
