"""Every bound query against its SQL on the tables that the results are judged on, cell by cell."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from heliosite.plans import audit, bindings, exports, ordered, places, runs, scoring, screening  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(rows, columns):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted([tuple(r[i] for i in by) for r in rows], key=lambda r: [(x is None, str(type(x)), round(x, 5) if isinstance(x, float) else x if x is not None else 0) for x in r])


def same(a, b):
    """Floats by a tolerance, all else exactly."""
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(bindings.queries()))
def test_query_matches_sql(name, spark, duck):
    got = bindings.queries()[name](spark, SF)
    want = duck.execute(bindings.oracle_sql()[name])
    got_columns, got_rows = canonical([tuple(r) for r in got.collect()], got.columns)
    want_columns, want_rows = canonical(want.fetchall(), [d[0] for d in want.description])
    assert got_columns == want_columns
    assert len(got_rows) == len(want_rows) > 0
    wrong = [(a, b) for a, b in zip(got_rows, want_rows, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]
