"""Every query with an SQL counterpart gives the same rows as that SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def check_engine():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_names_agree():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, check_engine, name):
    frame = entry.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted(tuple(row[c] for c in columns) for row in frame.collect())
    result = check_engine.execute(ORACLES[name])
    theirs_columns = [column[0] for column in result.description]
    assert sorted(theirs_columns) == columns
    order = [theirs_columns.index(c) for c in columns]
    assert ours == sorted(tuple(row[i] for i in order) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "repo", "path", "ord", "lang", "n_lines", "n_chars", "import_count", "importance",
    ]


def test_reference_points(spark):
    """Counts that were worked out before the jobs were written."""
    stats = entry.queries()["file_stats"](spark, "/root/testdata/sf0.01").collect()
    assert sum(row.import_count for row in stats) == 871
    scores = [row.importance for row in stats]
    assert {score: scores.count(score) for score in set(scores)} == {10: 1, 8: 334, 7: 6, 5: 598, 3: 61}
