"""Tables in few splits are spread by their rows; singular axes read their rows once."""

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.linalg import Vectors

from workloom.learn import pipelines as pl
from workloom.session import spread_by_rows
from workloom.sources import catalog


def test_tables_in_few_splits_are_spread_by_rows(spark):
    few = spark.range(0, 1000, 1, 2)
    assert spread_by_rows(few, 100).rdd.getNumPartitions() == 10
    assert sorted(r.id for r in spread_by_rows(few, 100).collect()) == list(range(1000))
    assert spread_by_rows(few, 500).rdd.getNumPartitions() == 2
    assert spread_by_rows(few.limit(0), 100).count() == 0


def test_customers_are_spread_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "ROWS_PER_TASK", 10)
    spark.range(95).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = catalog.Tables(spark, str(tmp_path)).customer
    assert found.rdd.getNumPartitions() == 10
    assert sorted(r.c_custkey for r in found.collect()) == list(range(95))


def test_singular_axes_are_those_of_the_rows_and_read_them_once(spark):
    rng = np.random.default_rng(3)
    width, k = 120, 5
    rows = rng.random((300, width)) * (rng.random((300, width)) < 0.3) * np.linspace(3, 0.1, width)
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    data = spark.sparkContext.parallelize([(Vectors.dense(r),) for r in rows], 3).map(counted)
    df = spark.createDataFrame(data, spark.createDataFrame([(Vectors.dense(rows[0]),)], ["x"]).schema, verifySchema=False)
    axes, values = pl.singular_axes(df, "x", k)
    _, expected, right = np.linalg.svd(rows)
    assert np.allclose(values, expected[:k], rtol=1e-6)
    assert np.allclose(np.abs((axes * right[:k].T).sum(axis=0)), 1, atol=1e-6)
    assert seen.value <= 2 * len(rows)


def test_singular_axes_of_several_fits_at_the_same_time(spark):
    """Solves of different widths shared the solver's state: wrong axes, or an index out of bounds."""
    rng = np.random.default_rng(5)
    tables = [rng.random((60, width)) * np.linspace(3, 0.1, width) for width in (104, 200, 150, 120, 180, 130)]
    frames = [spark.createDataFrame([(Vectors.dense(r),) for r in rows], ["x"]) for rows in tables]
    with ThreadPool(len(frames)) as pool:
        found = pool.map(lambda df: pl.singular_axes(df, "x", 20), frames)
    for rows, (axes, values) in zip(tables, found):
        _, expected, right = np.linalg.svd(rows)
        assert np.allclose(values, expected[:20], rtol=1e-6)
        assert np.allclose(np.abs((axes * right[:20].T).sum(axis=0)), 1, atol=1e-5)
