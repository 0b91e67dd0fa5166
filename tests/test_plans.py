"""Initial plans evaluate their inputs once: few scans and exchanges, and no Cartesian product."""

from pathlib import Path

import pytest

from bookflow.plans import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SCANS, EXCHANGES = 8, 20
NAMES = (
    "previous_summaries", "book_epub", "consistency_issues", "write_book_text", "translate_batch", "fingerprint",
    "job_report", "top_context",
)


def counts(df) -> tuple[int, int, int]:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    full = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), full.count("Exchange "), plan.count("CartesianProduct")


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    scans, exchanges, cartesian = counts(load().QUERIES[name](spark, SF))
    assert scans <= SCANS and exchanges <= EXCHANGES and cartesian == 0
