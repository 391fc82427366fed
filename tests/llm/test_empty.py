from pathlib import Path

import duckdb
import pytest

from symvane.llm.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for p in Path(SMALL).glob("*.parquet"):
        duckdb.sql(f"COPY (SELECT * FROM '{p}' LIMIT 0) TO '{d}/{p.name}' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
