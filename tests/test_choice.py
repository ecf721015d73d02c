"""Comparison and choice of models against plain counting."""

import hashlib
import random
from collections import Counter

import pytest

from workloom.learn import choice


def test_majority_scores(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice("abc"), draw.choice(["x", "y", None]), draw.choice("uvw")) for i in range(120)] + [(500, "only once", "x", "u")]
    df = spark.createDataFrame(rows, "profile_id long, f string, g string, target string")
    fold = {r[0]: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:7], 16) % 5 for r in rows}
    want = {}
    for k, name in ((1, "f"), (2, "g")):
        for f in set(fold.values()):
            held = [r for r in rows if fold[r[0]] == f]
            hits = 0
            for r in held:
                seen = Counter(o[3] for o in rows if fold[o[0]] != f and o[k] == r[k])
                hits += bool(seen) and min(seen, key=lambda c: (-seen[c], c)) == r[3]
            want[name, f] = hits / len(held)
    got = {(r.model, r.fold): r.score for r in choice.majority_scores(df, ["f", "g"]).collect()}
    assert got == pytest.approx(want)


def test_ties_go_to_the_first_name(spark):
    scores = spark.createDataFrame([("p", m, f, s) for m, s in (("b", 0.5), ("a", 0.5), ("c", 0.4)) for f in range(2)], "pipeline string, model string, fold int, score double")
    assert {r.model: (r.mean, r.std, r.best) for r in choice.compared(scores).collect()} == {"a": (0.5, 0.0, True), "b": (0.5, 0.0, False), "c": (0.4, 0.0, False)}


@pytest.mark.parametrize(("name", "kinds"), [("career", ("forest", "logistic")), ("income", ("huber", "ridge"))])
def test_matrix(spark, name, kinds):
    from workloom.learn import pipelines as pl
    from workloom.session import written
    from workloom.sources.catalog import Tables
    size = {"trees": 5, "depth": 4, "rounds": 2}
    fitted = pl.fit(Tables(spark, "/root/testdata/sf0.001").profiles, pl.SPECS[name], kinds, store=written, **size)
    held = written(choice.out_of_fold(fitted, kinds, 3, **size), "held")
    # Every training row is guessed once per model, by a model that has not seen its fold.
    assert held.count() == len(kinds) * fitted.train.count() == held.select("profile_id", "model").distinct().count()
    scores = {(r.model, r.fold): r.score for r in choice.fold_scores(held, fitted.spec).collect()}
    assert set(scores) == {(k, f) for k in kinds for f in range(3)}
    rows = {r.model: r for r in choice.report(fitted, kinds, 3, **size).collect()}
    assert set(rows) == {*kinds, "voting", "stacking"} and sum(bool(r.chosen) for r in rows.values()) == 1
    best = max(kinds, key=lambda k: rows[k].cv_mean)
    assert rows[best].chosen and rows["stacking"].chosen is None
    metric = "r2" if fitted.spec.regression else "accuracy"
    assert rows["stacking"][metric] >= min(rows[k][metric] for k in kinds) - 0.1


def test_fits_of_a_large_table_use_all_cores(spark):
    """A narrow table in one file is one task, however many rows; small tables stay in few tasks."""
    from workloom.session import spread_over_cores, written
    cores = spark.sparkContext.defaultParallelism
    rows = written(spark.range(40 * cores).coalesce(1), "narrow")
    assert rows.rdd.getNumPartitions() == 1
    assert spread_over_cores(rows, 10).rdd.getNumPartitions() == cores
    assert spread_over_cores(rows, 1_000_000).rdd.getNumPartitions() == 1
    # However large the table, no task has more rows than the bound.
    wide = spread_over_cores(rows, 10, most=5)
    assert wide.rdd.getNumPartitions() == 8 * cores and max(wide.rdd.glom().map(len).collect()) <= 10
    assert spread_over_cores(rows, 10).agg({"id": "sum"}).first()[0] == 40 * cores * (40 * cores - 1) // 2
    assert [choice.fits_at_once(n, 12) for n in (1, 3, 12, 200)] == [8, 4, 2, 2]


def test_forests_that_keep_nodes_are_the_same_forests(spark):
    from pyspark.ml.linalg import Vectors

    from workloom.learn import pipelines as pl
    draw = random.Random(4)
    rows = [(Vectors.dense([draw.random(), draw.random(), draw.randrange(3)]), draw.random(), float(draw.randrange(3)), draw.choice([0.5, 2.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, ["features", "number", "label", "weight"])
    for name, label in (("income", "number"), ("career", "label")):
        new = pl.estimator("forest", pl.SPECS[name], 3, 3, trees=5, depth=5).setLabelCol(label)
        assert new.getCacheNodeIds()
        old = new.copy().setCacheNodeIds(False)
        assert [t.toDebugString.split("\n")[1:] for t in new.fit(df).trees] == [t.toDebugString.split("\n")[1:] for t in old.fit(df).trees]


def test_five_best_classes_are_scored_once(spark):
    """The sum of the shares reads the stored classes; before, every row was scored for the list and again for the sum."""
    from pyspark.sql import functions as F

    from workloom.learn import pipelines as pl
    seen = spark.sparkContext.accumulator(0)

    def score(i):
        seen.add(1)
        return [0.1, 0.2, 0.3, 0.1, 0.1, 0.2] if i % 2 else [0.0] * 6

    df = spark.range(10, numPartitions=2).select(F.col("id").alias("profile_id"), F.udf(score, "array<double>")("id").alias("p"))
    got = pl.top_five_shares(df, list("abcdef"), "p").collect()
    assert seen.value == 10 and len(got) == 50
    one = sorted((r["rank"], r.job_title, round(r.share, 6)) for r in got if r.profile_id == 1)
    assert one == [(1, "c", 0.333333), (2, "b", 0.222222), (3, "f", 0.222222), (4, "a", 0.111111), (5, "d", 0.111111)]
    assert {r.share for r in got if r.profile_id == 2} == {0.0}


def test_fits_fill_the_cores_with_few_tasks_each():
    """Every task of a forest sends the counts of all nodes: eight fits of a task take the place of two of eight tasks."""
    assert choice.tasks_and_fits(72_000, 8, 10, 100, 10) == (1, 8)
    assert choice.tasks_and_fits(72_000, 8, 60, 100, 10) == (2, 4)  # the driver holds four forests of 60 classes
    assert choice.tasks_and_fits(240_000, 8, 10, 100, 10) == (3, 3)
    assert choice.tasks_and_fits(720_000, 8, 10, 100, 10) == (8, 2)
    assert choice.tasks_and_fits(1_200, 8, 3, 100, 10) == (1, 8)
    assert choice.tasks_and_fits(4_300_000, 64, 3, 100, 10) == (43, 2)


def _prepared(spark, n=400, rare=0):
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    draw = random.Random(8)
    rows = [(i, float(3 if i < rare else draw.randrange(3)), draw.random(), draw.random()) for i in range(n)]
    df = spark.createDataFrame([(*r, float((r[1] + (r[2] > 0.4)) % 3), float(1 + i % 3)) for i, r in enumerate(rows)],
                               "profile_id long, c double, x double, y double, label double, weight double")
    df = OneHotEncoder(inputCols=["c"], outputCols=["h"], dropLast=False).fit(df).transform(df)
    return VectorAssembler(inputCols=["h", "x", "y"], outputCol="features").transform(df)


def test_zeros_and_ones_as_numbers_give_the_same_guesses(spark, monkeypatch):
    from workloom.learn import pipelines as pl
    told = _prepared(spark).coalesce(1).cache()
    assert pl.as_numbers(told).schema["features"].metadata == told.schema["features"].metadata  # few rows stay as they are
    monkeypatch.setattr(pl, "SPLIT_ROWS", 300)
    plain = pl.as_numbers(told)
    assert told.schema["features"].metadata and not plain.schema["features"].metadata
    model = pl.estimator("forest", pl.SPECS["career"], 3, 5, trees=8, depth=6)
    a, b = [{r.profile_id: r.prediction for r in model.fit(df).transform(df).collect()} for df in (told, plain)]
    assert a == b
    # A column that a sample may miss keeps all as they are told.
    few = _prepared(spark, 1500, 2)
    assert pl.as_numbers(few).schema["features"].metadata == few.schema["features"].metadata


def test_guesses_run_the_model_once_per_row(spark):
    """Padded class by class in a lambda before, with the model in it."""
    from workloom.learn import pipelines as pl
    df = _prepared(spark).coalesce(1)
    model = pl.estimator("forest", pl.SPECS["career"], 3, 5, trees=3, depth=3).fit(df)
    out = choice._guesses(model, df, pl.SPECS["career"], "forest", 5).select("profile_id", "p")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r.profile_id: [*r.probability.toArray(), 0.0, 0.0] for r in model.transform(df).collect()}
    assert {r.profile_id: r.p for r in out.collect()} == want
    assert {len(r.p) for r in choice._guesses(model, df, pl.SPECS["career"], "forest", 2).select("p").collect()} == {2}


def test_a_report_fits_the_models_that_are_missing(spark):
    from workloom.learn import pipelines as pl
    from workloom.session import written
    from workloom.sources.catalog import Tables
    size = {"trees": 3, "depth": 3, "rounds": 2}
    kinds = ("forest", "logistic")
    profiles = Tables(spark, "/root/testdata/sf0.001").profiles
    found = []
    for given in (kinds, ()):
        fitted = pl.fit(profiles, pl.SPECS["career"], given, store=written, **size)
        found.append(sorted(tuple(r) for r in choice.report(fitted, kinds, 2, **size).collect()))
        assert set(fitted.models) == set(kinds)
    assert str(found[0]) == str(found[1])
