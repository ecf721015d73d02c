"""The star check of the class search, and its number of jobs."""

import pytest

from workloom.llm.classes import _is_forest_of_stars, connected_classes
from workloom.llm.scratch import Scratch


@pytest.mark.parametrize("edges, stars", [
    ([], True), ([(2, 1)], True), ([(2, 1), (3, 1), (5, 4)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False),
    ([(4, 1), (4, 2), (4, 3)], False), ([(2, 1), (5, 4), (4, 3)], False)])
def test_the_star_check_is_one_aggregate(spark, edges, stars):
    df = Scratch(spark, "test-classes").keep(spark.createDataFrame(edges, "u long, v long"), "edges")
    group = f"stars-{edges}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert _is_forest_of_stars(df) is stars
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 2


def test_a_chain_and_a_star_become_classes(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    found = connected_classes(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test-classes"))
    assert {r.node: r.comp for r in found.collect()} == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}}
