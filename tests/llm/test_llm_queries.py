"""Every registered query of the subpackage next to its SQL, and what SQL cannot say."""

import pytest
from compare import compare, duck

from workloom.llm.checks import CHECKS
from workloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_operators():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) - set(CHECKS) == {"op2_language_id", "op6_quality_rules", "op8_token_histogram"}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_check(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, CHECKS[name]) == ""


def test_native_plan_of_chat(spark):
    plan = QUERIES["op3_chat_formatting"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_language_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and held
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
