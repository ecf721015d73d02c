"""Splits, weights, scaling and metrics as plain aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.operators.ranking import sums_before
from workloom.operators.statistics import quantiles


def stratified_split(df, label, row_id, share=0.2, digits=3):
    """Adds ``part`` (test/train): per label the rows with the smallest hashes are the test part.

    Only the hash bucket in which the cut falls is ranked, so a label that holds most of the
    table is still spread over many tasks. The hash depends on the row id alone.
    """
    keyed = df.withColumn("__h", F.md5(F.col(row_id).cast("string"))).withColumn("__b", F.substring("__h", 1, digits))
    sizes = keyed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_label = Window.partitionBy(label)
    before = by_label.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # One row per label and bucket: labels are classes, so this stays small.
    bounds = sizes.select(label, "__b", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                          (F.sum("__n").over(by_label) * share).alias("__want"))
    placed = keyed.join(F.broadcast(bounds), [label, "__b"])
    split = F.col("__before") + F.col("__n") > F.col("__want")
    cut = placed.filter(split & (F.col("__before") < F.col("__want"))).withColumn(
        "__r", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", row_id)) + F.col("__before"))
    whole = placed.filter(~(split & (F.col("__before") < F.col("__want")))).withColumn("__r", F.col("__before") + F.lit(1))
    return cut.unionByName(whole).select(*df.columns, F.when(F.col("__r") <= F.col("__want"), "test").otherwise("train").alias("part"))


def fold_of(row_id, folds=5):
    """Fold number from a hash of the row id; independent of the partitioning."""
    return F.pmod(F.xxhash64(F.col(row_id)), F.lit(folds)).cast("int")


def class_weights(df, label):
    """n / (classes * n_class) per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(label, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def standard_scaled(df, columns):
    """(x - mean) / population deviation; a constant column becomes zero."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns})


def robust_scaled(df, columns):
    """(x - median) / interquartile range."""
    row = quantiles(df, columns, [0.25, 0.5, 0.75])
    return df.withColumns({c: (F.col(c) - F.lit(row[c][1])) / F.lit((row[c][2] - row[c][0]) or 1.0) for c in columns})


def classification_metrics(df, truth="label", guess="prediction"):
    """Accuracy and support-weighted precision, recall and F1 from the confusion counts."""
    cells = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    hits = F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("support"), hits.alias("hit"))
    guessed = cells.groupBy(F.col(guess).alias("c")).agg(F.sum("n").alias("guessed"))
    per = actual.join(guessed, "c", "left").na.fill(0).select(
        "support", "hit", F.try_divide("hit", "guessed").alias("p"), (F.col("hit") / F.col("support")).alias("r"))
    per = per.select("support", "hit", F.coalesce("p", F.lit(0.0)).alias("p"), "r").withColumn(
        "f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    n = F.sum("support")
    return per.agg((F.sum("hit") / n).alias("accuracy"), (F.sum(F.col("p") * F.col("support")) / n).alias("precision"),
                   (F.sum(F.col("r") * F.col("support")) / n).alias("recall"), (F.sum(F.col("f") * F.col("support")) / n).alias("f1"))


def roc_auc(df, truth="label", score="score"):
    """Area under the curve by rank sums over distinct scores; ties count half."""
    per = df.groupBy(score).agg(F.sum(truth).cast("double").alias("pos"), F.sum(1 - F.col(truth)).cast("double").alias("neg"))
    ranked = sums_before(per, score, ["neg"])
    return ranked.agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def top_k_accuracy(df, truth, probabilities, k):
    """Share of rows whose true class is among the ``k`` most likely ones."""
    pairs = F.transform(F.col(probabilities), lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])
    return df.agg(F.avg(F.array_contains(best, F.col(truth).cast("int")).cast("double")).alias(f"top{k}_accuracy"))


def regression_metrics(df, truth="actual", guess="estimate"):
    """MAE, RMSE, median AE and MAPE in money, R2 and explained variance on the log scale."""
    y, p = F.log1p(F.col(truth)), F.log1p(F.greatest(F.col(guess), F.lit(0.0)))
    error = F.col(truth) - F.greatest(F.col(guess), F.lit(0.0))
    middle = quantiles(df.select(F.abs(error).alias("e")), ["e"], [0.5])["e"][0]
    return df.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
                  (1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).alias("r2"), F.lit(middle).alias("median_ae"),
                  (1 - F.var_pop(y - p) / F.var_pop(y)).alias("explained_var"),
                  (F.avg(F.when(F.col(truth) > 0, F.abs(error / F.col(truth)))) * 100).alias("mape"))
