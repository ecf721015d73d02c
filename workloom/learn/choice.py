"""Comparison and choice of models: a matrix of models and folds, out-of-fold predictions, ensembles."""

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from workloom.learn import evaluate
from workloom.learn import pipelines as pl
from workloom.session import in_tasks, written

#: Rows of a task of a fit that shares the cores with other fits, at most.
MOST_ROWS = 100_000
#: Fits at the same time: at most, and of a table that fills the cores alone (two, as every fit ends in steps of few tasks).
MOST_AT_ONCE, LEAST_AT_ONCE = 8, 2
#: Bytes that the driver may hold for the forests that grow at the same time, and bytes of a class in a node (three counts).
GROWING_BYTES, CLASS_BYTES = 640_000_000, 24
#: Kinds of models, the longest fit first, so that the last ones to end are short.
LONGEST = ("forest", "boosting", "network", "huber", "logistic", "ridge")
#: Base models of every pipeline.
MATRIX = {
    "job": ("forest", "network", "logistic"), "income": ("forest", "boosting", "huber", "ridge"), "suitability": ("forest", "network", "logistic"),
    "balance": ("forest", "network", "logistic"), "skill_match": ("forest", "network", "logistic"), "skill_gap": ("forest", "boosting", "logistic"),
    "career": ("forest", "network", "logistic"), "quality": ("forest", "boosting", "logistic"),
}


# --- scores of models, whatever they are ----------------------------------------------------------

def compared(scores):
    """``pipeline, model, mean, std, best`` from one row per pipeline, model and fold (``score``): the best mean wins, ties
    go to the model that sorts first."""
    table = scores.groupBy("pipeline", "model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    best = table.groupBy("pipeline").agg(F.min_by("model", F.struct(-F.col("mean"), F.col("model"))).alias("winner"))
    return table.join(best, "pipeline").select("pipeline", "model", "mean", "std", (F.col("model") == F.col("winner")).alias("best"))


def majority_scores(rows, features, folds=5, target="target", row_id=pl.ROW):
    """Base line models, one per feature: the class that most rows of the other folds have at the same value.

    ``model, fold, score``: the share of the fold that is guessed right. Ties go to the class that sorts first;
    a value that only one fold has is not guessed. Rows are counted by value, class and fold first.
    """
    fold = F.pmod(F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 7), 16, 10).cast("long"), F.lit(folds)).cast("int")
    long = rows.select(fold.alias("fold"), F.col(target).alias("class"), *features).unpivot(["fold", "class"], list(features), "model", "value")
    cells = long.groupBy("model", "value", "class", "fold").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.groupBy("model", "value", "class").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("of"))
    votes = counts.select("model", "value", "class", "total", "of", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    votes = votes.withColumn("own", F.coalesce(F.col("of")[F.col("fold")], F.lit(0))).withColumn("votes", F.col("total") - F.col("own"))
    guessed = votes.groupBy("model", "value", "fold").agg(
        F.sum("own").alias("n"), F.max("votes").alias("most"), F.min_by("own", F.struct(-F.col("votes"), F.col("class"))).alias("hit"))
    hits = F.sum(F.when(F.col("most") > 0, F.col("hit")).otherwise(0))
    return guessed.groupBy("model", "fold").agg((hits / F.sum("n")).alias("score"), F.sum("n").alias("n")).filter("n > 0").drop("n")


# --- Spark ML models ------------------------------------------------------------------------------

def _guesses(model, df, spec, name, classes):
    """Adds ``p``: class probabilities, one per class, or the estimate as the only entry."""
    if spec.regression:
        return model.copy().setPredictionCol("estimate").transform(df).withColumn("p", F.array("estimate")).drop("estimate")
    out = pl.with_probabilities(model, df, name)
    # Named once and outside of a lambda: Spark puts the model in place of the name and would run it once per class.
    every = F.concat(F.col(f"p_{name}"), F.array_repeat(F.lit(0.0), classes))
    return out.withColumn("p", F.slice(every, 1, classes)).drop(f"p_{name}")


def fits_at_once(tasks, cores):
    """Fits that share the cores. Each keeps its own copy of the rows in memory, so that of a large table more of them
    at the same time are no faster and take as many times the memory."""
    return max(LEAST_AT_ONCE, min(MOST_AT_ONCE, cores // max(tasks, 1)))


def tasks_and_fits(n, cores, classes, trees=20, depth=8):
    """Tasks of a fit of ``n`` rows, and fits at the same time.

    Every task of a forest sends the counts of all nodes and classes, however few its rows are, so the cores are filled by
    several fits of few tasks rather than by one fit; a task has ``MOST_ROWS`` rows at most, and the driver keeps the
    forests that grow within ``GROWING_BYTES``.
    """
    forest = trees * 2 ** depth * (classes + 1) * CLASS_BYTES
    most = max(LEAST_AT_ONCE, min(MOST_AT_ONCE, GROWING_BYTES // forest))
    tasks = max(1, -(-n // MOST_ROWS), min(-(-n // pl.ROWS_PER_TASK), cores // most))
    return tasks, max(LEAST_AT_ONCE, min(most, -(-cores // tasks)))


def out_of_fold(fitted, kinds, folds=5, at_once=None, whole=False, **size):
    """Every model of ``kinds`` fitted without every fold, ``at_once`` at the same time, from one stored table.

    Returns the stored predictions of the rows of each left out fold: row id, label, fold, model, p. With ``whole`` the
    models of all training rows that ``fitted`` lacks are fitted next to those of the folds and added to it.
    """
    spec, classes = fitted.spec, max(len(fitted.labels), 1)
    rows = written(fitted.train.withColumn("fold", evaluate.fold_of(pl.ROW, folds)), "folds")
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    count, fits = tasks_and_fits(n, cores, classes, **{k: v for k, v in size.items() if k in ("trees", "depth")})
    rows = in_tasks(rows if spec.regression else pl.as_numbers(rows), count)
    # A small table stays in the tasks that its fit has alone.
    train = in_tasks(fitted.train, count) if n > pl.ROWS_PER_TASK else fitted.train
    train = train.withMetadata("features", dict(rows.schema["features"].metadata))
    first = rows.select("features").first()
    width = first.features.size if first else 0

    def one(task):
        kind, fold = task
        model = pl.estimator(kind, spec, classes, width, **size)
        if fold is None:
            fitted.models[kind] = model.fit(train)
            return None
        model = model.fit(rows.filter(F.col("fold") != fold))
        held = _guesses(model, rows.filter(F.col("fold") == fold), spec, kind, classes)
        return written(held.select(pl.ROW, "label", "fold", F.lit(kind).alias("model"), "p"), f"held-{kind}-{fold}")

    missing = [k for k in kinds if k not in fitted.models] if whole else []
    tasks = sorted([(k, None) for k in missing] + [(k, f) for f in range(folds) for k in kinds], key=lambda x: LONGEST.index(x[0]))
    with ThreadPool(at_once or fits) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one), tasks, chunksize=1)
    return reduce(lambda a, b: a.unionByName(b), [p for p in parts if p is not None])


def fold_scores(held, spec):
    """``pipeline, model, fold, score``: accuracy, or R2 of the logarithm."""
    if spec.regression:
        error = F.col("label") - F.col("p")[0]
        score = 1 - F.sum(error * error) / (F.var_pop("label") * F.count(F.lit(1)))
        return held.groupBy("model", "fold").agg(score.alias("score")).withColumn("pipeline", F.lit(spec.name))
    score = F.avg((pl.argmax("p") == F.col("label")).cast("double"))
    return held.groupBy("model", "fold").agg(score.alias("score")).withColumn("pipeline", F.lit(spec.name))


def _together(rows, kinds):
    """One row per row id with the guesses of all models side by side as a vector."""
    wide = rows.groupBy(pl.ROW, "label").pivot("model", list(kinds)).agg(F.first("p"))
    return wide.withColumn("stacked", array_to_vector(F.concat(*[F.col(k) for k in kinds])))


def stacked(fitted, held, tested, kinds):
    """Predictions of a logistic or ridge model over the out-of-fold guesses, for the test part."""
    meta = (LinearRegression(featuresCol="stacked", regParam=0.1, elasticNetParam=0.0) if fitted.spec.regression
            else LogisticRegression(featuresCol="stacked", maxIter=50))
    return meta.fit(written(_together(held, kinds), "stacked")).transform(_together(tested, kinds))


def averaged(tested, spec):
    """Mean of the guesses of all models: soft voting, or the mean estimate."""
    total = F.aggregate(F.collect_list("p"), F.transform(F.first("p"), lambda x: F.lit(0.0)), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    mean = tested.groupBy(pl.ROW, "label").agg(total.alias("p"))
    return mean.withColumn("prediction", F.col("p")[0] / F.lit(1.0) if spec.regression else pl.argmax("p"))


def _measured(rows, spec):
    if spec.regression:
        return evaluate.regression_metrics(rows.select(F.expm1("label").alias("actual"), F.expm1("prediction").alias("estimate")))
    return evaluate.classification_metrics(rows)


def report(fitted, kinds, folds=5, **size):
    """One row per base model, and for the ensembles of all of them: mean and deviation of the fold scores (base models),
    metrics of the test part, and which base model is chosen. Models that ``fitted`` lacks are fitted with those of the folds."""
    spec, classes = fitted.spec, max(len(fitted.labels), 1)
    held = out_of_fold(fitted, kinds, folds, whole=True, **size)
    chosen = compared(fold_scores(held, spec))
    tested = [_guesses(fitted.models[k], fitted.test, spec, k, classes).select(pl.ROW, "label", F.lit(k).alias("model"), "p") for k in kinds]
    tested = written(reduce(lambda a, b: a.unionByName(b), tested), "tested")
    parts = {k: tested.filter(F.col("model") == k).withColumn("prediction", F.col("p")[0] if spec.regression else pl.argmax("p")) for k in kinds}
    mean = averaged(tested, spec)
    parts["voting"] = mean.withColumn("prediction", F.col("prediction") / len(kinds)) if spec.regression else mean
    parts["stacking"] = stacked(fitted, held, tested, kinds)
    rows = reduce(lambda a, b: a.unionByName(b), [_measured(df, spec).withColumn("model", F.lit(name)) for name, df in parts.items()])
    return rows.join(chosen.select("model", F.col("mean").alias("cv_mean"), F.col("std").alias("cv_std"), F.col("best").alias("chosen")), "model", "left")
