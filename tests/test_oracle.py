"""The correctness gate: every query with a DuckDB twin matches it at sf0.01."""

from __future__ import annotations

from tests.conftest import SF01
from tests.oracle_runner import compare


def test_all_sql_twins_match(spark):
    res = compare(spark, SF01, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")}
    assert not bad, bad
