"""Every registered query against its reference SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from conftest import SF_DIR

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(round(value, 9))
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, db, name):
    found = QUERIES[name](spark, SF_DIR)
    rows, columns = canonical([tuple(r) for r in found.collect()], found.columns)
    if name not in ORACLES:
        assert rows
        return
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected, expected_columns = canonical(result.fetchall(), names)
    assert columns == expected_columns
    assert len(rows) == len(expected)
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    assert not different, f"{len(different)} rows differ, first: {str(different[0])[:1500]}"


def test_entry(spark):
    answers = driver.entry(spark)
    assert answers.columns == [
        "question_id", "question", "classification", "answer", "citations", "agents_used", "is_mock",
    ]
    assert answers.count() > 0
