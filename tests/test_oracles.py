"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from tilewright.queries import QUERIES, SQL

TABLES = ("events", "embeddings")


def text(v):
    return str([text(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted(tuple(text(row[i]) for i in order) for row in cursor.fetchall())
    found = sorted(tuple(text(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    assert found == wanted
    assert found or sf_dir.endswith("sf0.001")


def test_queries_over_all_rows(spark, sf_dir):
    """The queries named ..._all leave out no event and no embedding."""
    found = {name: QUERIES[f"{name}_all"](spark, sf_dir) for name in ("track_resend", "track_interpolate", "track_out_and_back", "survey_wait", "run_survey", "match_hamming")}
    events, embeddings = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES)
    assert found["track_resend"].select("msg").distinct().count() == events.count()
    assert found["track_interpolate"].select("move").distinct().count() == events.count()
    assert found["track_out_and_back"].count() == 20 * events.count()
    assert found["survey_wait"].count() == events.count()
    assert found["run_survey"].count() == 5
    assert found["match_hamming"].count() == 2 * embeddings.count()
    assert not [name for name in found if "% 10 = 0" in SQL[f"{name}_all"] or "% 5 = 0" in SQL[f"{name}_all"] or "% 100 = 0" in SQL[f"{name}_all"]]


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:4] == ["photo_id", "rank", "tile_idx", "votes"]
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
