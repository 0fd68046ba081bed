"""Every query with SQL gives the SQL's rows; the rest run; the library stands without its llm part."""

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = ["p1_found", "p2_found", "p5_found", "p5_totals", "rolling_corr", "graph_metrics", "h0_features", "gated_signal", "compare_strategies", "wf_splits", "stress_aggregate", "stream_bars"]

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, DIR).toPandas(), connection(DIR).execute(entry.oracle_sql()[name]).df()) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    root = Path(entry.__file__).parent / "marketshape"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import)\s+[\w.]*llm", p.read_text()), p
