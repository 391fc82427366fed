import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import canon, duck
from tests.conftest import SMALL

SLOW = {"e10_bench", "e1_recall", "o3_candidates", "g8_pagerank_refs", "st3_touching"}
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and n not in SLOW]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "fault", "root_id"]


def test_works_without_the_text_package():
    code = "import sys\nsys.modules['symvane.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p7_ids' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    from collections import Counter

    df = entry.queries()[name](spark, SMALL)
    got = Counter(canon(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert got == Counter(canon(tuple(r[i] for i in order)) for r in res.fetchall())
