import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

NAMES = [n for n, f in entry.queries().items() if n[0] == "p" and n[1].isdigit() and "llm" not in f.__module__]


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    from pathlib import Path

    for p in Path(SMALL).glob("*.parquet"):
        duckdb.sql(f"COPY (SELECT * FROM '{p}' LIMIT 0) TO '{d}/{p.name}' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).collect() == []
