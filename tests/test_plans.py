"""Physical plans: no nested-loop or Cartesian joins, Python only where stated."""

import pytest

from workloom.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
PLANNED = ["flagship_pay_and_suitability", "jo1_semi_join_satellites", "jo2_company_enrichment", "jo9_ownership", "dd2_same_keys", "ag1_table_profile",
           "ag8_documentation", "ag9_income_range", "ag13_dashboard_counts", "ag17_organisation_dashboard", "fi4_course_search", "ml1_tfidf",
           "ml2_cosine_top_k", "ml3_profile_matching", "ml4_tiered_jobs", "ml8_stratified_split", "wi3_quintile_label", "wi6_last_n_per_user",
           "fe5_skill_match_target", "st1_recent_failures", "st5_skill_upsert", "cr20_skill_gap_report"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_plan(spark, name):
    text = plan(all_queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in text, word


def test_column_pruning(spark):
    text = plan(all_queries()["wi1_keep_first"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_rank_limit_before_shuffle(spark):
    assert "WindowGroupLimit" in plan(all_queries()["wi6_last_n_per_user"](spark, FOLDER))
