"""Every registered query with a SQL statement must give the statement's rows."""

import os
import re

import pytest

from compare import connect, differences
from scholion.plans import collect
from scholion.plans.base import table, whole_requests
from scholion.plans.passages import NAMES

SF = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = collect()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert differences(spark, SF, QUERIES[name], ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def plan_text(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


@pytest.mark.parametrize("name", ["q2_vector_topk", "q8_keyword_topk", "q9_hybrid_rrf", "g10_recent_searches"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    text = plan_text(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(QUERIES["f1_literal_filters"](spark, SF))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "documents" in line)
    assert re.search(r"PushedFilters: \[.*In\(lang|PushedFilters: \[.*source", scan)
    assert "text" not in scan.split("ReadSchema")[1]


def test_a_stored_index_is_searched_without_reading_texts(spark):
    text = plan_text(QUERIES["q8_stored_index"](spark, SF))
    scans = [line for line in text.splitlines() if "FileScan" in line and "documents" in line]
    assert scans and all("text" not in line.split("ReadSchema")[1] for line in scans)


def test_whole_passages_are_asked(spark):
    asked = {r.query_id: r.query_text for r in whole_requests(spark, SF).collect()}
    texts = {str(r.item_id): r.text for r in table(spark, SF, "benchmark").collect()}
    assert asked == texts and max(len(t.split()) for t in texts.values()) > 10
    for name in NAMES:
        assert f"{name}_whole_passages" in QUERIES and f"{name}_whole_passages" in ORACLES
    # Some requests of many terms are answered.
    assert QUERIES["q7_keyword_rank_whole_passages"](spark, SF).count() > 0
