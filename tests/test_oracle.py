"""Every registered query equals its oracle SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest

from compare import check, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()
#: Reports of problems that sound tables do not have.
REPORTS = {name for name in QUERIES if "problems" in name or "check" in name or "validate" in name or name.startswith("unknown")}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, _, count, note = check(spark, con, SF_DIR, name, QUERIES[name], ORACLE.get(name))
    # Only reports of problems may be empty, and only queries without SQL go by their rows.
    allowed = {"ok"} | ({"EMPTY"} if name in REPORTS else set()) | (set() if name in ORACLE else {"rows-only"})
    assert status in allowed, f"{status} {note}"


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
