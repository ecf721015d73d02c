"""Training, comparison and choice of models, ensembles and batch scoring. Sizes are parameters."""

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from workloom import lexicon
from workloom.features import sets
from workloom.features.profiles import clean_profiles
from workloom.functions.text import pretty_label
from workloom.learn import choice, evaluate
from workloom.learn import pipelines as pl
from workloom.operators import merging, postings, requests, scoring
from workloom.plans import sqlparts as s
from workloom.plans.registry import check_view, query
from workloom.session import scratch_path, spread_over_cores, written
from workloom.sources.files import write_report

SIZE = {"trees": 100, "depth": 10, "rounds": 20}


def _fit(t, name, kinds=("forest",)):
    """The fitted pipeline. Every query fits its own, so its time and rows depend on nothing that ran before."""
    return pl.fit(t.profiles, pl.SPECS[name], kinds, store=written, **SIZE)


def _fit_all(t, names, at_once=3):
    """Fitted pipelines, ``at_once`` at the same time: a fit is many short steps, most of them smaller than the cluster."""
    with ThreadPool(at_once) as pool:
        return pool.map(inheritable_thread_target(t.spark)(lambda name: _fit(t, name)), list(names))


def _rounded(df):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def _report(t, name, kinds=("forest",)):
    fitted = _fit(t, name, kinds)
    parts = [pl.metrics(fitted, k).withColumn("model", F.lit(k)) for k in kinds]
    return _rounded(reduce(lambda a, b: a.unionByName(b), parts))


def _compared(t, name, kinds=None):
    """Every base model of a pipeline with fold scores and test metrics, the chosen one, and the ensembles."""
    kinds = kinds or choice.MATRIX[name]
    return _rounded(choice.report(_fit(t, name, ()), kinds, 5, **SIZE).withColumn("pipeline", F.lit(name)))


def _model_query(name):
    @query(f"train_{name}_model")
    def _(t):
        return _report(t, name)

    @query(f"choose_{name}_model")
    def _(t):
        return _compared(t, name)


for _name in pl.SPECS:
    _model_query(_name)


@query("io7_model_persistence", "SELECT profile_id, true AS same_label, true AS same_confidence FROM profiles")
def _(t):
    """A pipeline with texts is saved, loaded from its path alone, and scores every profile as before."""
    fitted = _fit(t, "job")
    path = scratch_path(t.spark, "model")
    pl.save_fitted(t.spark, fitted, path)
    again = pl.load_fitted(t.spark, path, fitted.spec)
    rows = written(fitted.spec.features(clean_profiles(t.profiles)), "to-score")
    first = fitted.scored(rows).select("profile_id", "predicted", "confidence")
    second = again.scored(rows).select("profile_id", F.col("predicted").alias("again"), F.col("confidence").alias("confidence_again"))
    return first.join(second, "profile_id").select("profile_id", (F.col("predicted") == F.col("again")).alias("same_label"),
                                                   (F.abs(F.col("confidence") - F.col("confidence_again")) < 1e-9).alias("same_confidence"))


@query("io8_training_metadata")
def _(t):
    path = scratch_path(t.spark, "training-metadata")
    write_report(_compared(t, "suitability", ("forest", "logistic")), path)
    return t.spark.read.json(path)


@query("ml5_truncated_svd")
def _(t):
    fitted = _fit(t, "job", ())
    rows = fitted.preparation.model.transform(fitted.rows)
    axes, values = pl.singular_axes(rows, "__tfidf", 10)
    pairs = [(i + 1, float(v)) for i, v in enumerate(values)]
    assert axes.shape[1] == len(pairs)
    return _rounded(t.spark.createDataFrame(pairs, "component INT, singular_value DOUBLE"))


@query("ml7_encoding")
def _(t):
    from pyspark.ml.functions import vector_to_array
    fitted = _fit(t, "suitability", ())
    rows = fitted.preparation.transform(fitted.rows)
    return rows.select("profile_id", F.size(vector_to_array("features")).alias("width"),
                       F.round(F.aggregate(vector_to_array("__h_domain"), F.lit(0.0), lambda a, x: a + x), 1).alias("domain_ones"))


@query("ml9_random_forest")
def _(t):
    return _report(t, "job")


@query("ml10_boosting")
def _(t):
    return _report(t, "income", ("boosting",))


@query("ml11_network")
def _(t):
    return _report(t, "balance", ("network",))


@query("ml12_linear_models")
def _(t):
    return _report(t, "income", ("huber", "ridge"))


@query("ml14_soft_voting")
def _(t):
    fitted = _fit(t, "balance", ("forest", "network", "logistic"))
    return _rounded(evaluate.classification_metrics(pl.voting(fitted, fitted.test)))


@query("ml15_stacking")
def _(t):
    """Classes by a logistic model and incomes by a ridge model over out-of-fold guesses."""
    parts = [_compared(t, name, kinds).filter("model = 'stacking'").select("pipeline", F.col(metric).alias("score"))
             for name, kinds, metric in (("balance", ("forest", "logistic"), "accuracy"), ("income", ("forest", "huber", "ridge"), "r2"))]
    return parts[0].unionByName(parts[1])


@query("ml16_cross_validation")
def _(t):
    fitted = _fit(t, "suitability", ())
    return _rounded(choice.fold_scores(choice.out_of_fold(fitted, ("forest", "logistic"), 5, **SIZE), fitted.spec))


# --- base lines of every class pipeline: a model per feature, compared and chosen like the others -
_BASE_FEATURES = ["domain", "sector", "education", "city_tier", "work_mode", "work_type"]
_BASE_TARGETS = {
    "job": f"domain || '_' || {s.lookup('seniority_level', lexicon.SIMPLE_SENIORITY, 'Entry')}",
    "career": s.lookup("lower(seniority_level)", lexicon.SENIORITY_STANDARD, "KEEP").replace("'KEEP'", s.title_case("seniority_level")),
    "skill_gap": "CASE WHEN training_provided = 1 THEN 'yes' ELSE 'no' END", "quality": "CASE WHEN mother_suitability_score >= 8 THEN '1' ELSE '0' END"}
check_view("base_rows", " UNION ALL ".join(
    f"SELECT '{p}' AS pipeline, '{f}' AS model, {f} AS value, {x} AS class, ('0x' || substr(md5(profile_id::VARCHAR), 1, 7))::BIGINT % 5 AS fold FROM clean_profiles"
    for p, x in _BASE_TARGETS.items() for f in _BASE_FEATURES))
check_view("base_scores", """
  SELECT pipeline, model, fold, sum(CASE WHEN class = guess THEN n ELSE 0 END)::DOUBLE / sum(n) AS score FROM
   (SELECT pipeline, model, value, class, fold, count(*) AS n FROM base_rows GROUP BY ALL) LEFT JOIN
   (SELECT pipeline, model, value, fold, class AS guess FROM (SELECT a.pipeline, a.model, a.value, f.fold, a.class, count(*) AS votes FROM base_rows a, (SELECT unnest(range(5)) AS fold) f
      WHERE a.fold <> f.fold GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pipeline, model, value, fold ORDER BY votes DESC, class) = 1)
   USING (pipeline, model, value, fold) GROUP BY pipeline, model, fold""")
check_view("base_means", "SELECT pipeline, model, avg(score) AS mean, stddev_pop(score) AS std FROM base_scores GROUP BY pipeline, model")


def _base_scores(t):
    rows = written(clean_profiles(t.profiles).select("profile_id", *_BASE_FEATURES, "seniority_level", "training_provided", "mother_suitability_score"), "base-rows")
    targets = {"job": F.expr(sets.job_category_target()), "career": sets.seniority_standard(F.col("seniority_level")),
               "skill_gap": F.expr("CASE WHEN training_provided = 1 THEN 'yes' ELSE 'no' END"), "quality": F.expr(sets.quality_target()).cast("string")}
    parts = [choice.majority_scores(rows.withColumn("target", x), _BASE_FEATURES).withColumn("pipeline", F.lit(p)) for p, x in targets.items()]
    return written(reduce(lambda a, b: a.unionByName(b), parts), "base-scores")


@query("wi13_best_model", """
  SELECT pipeline, model AS best, round(mean, 9) AS score FROM base_means QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY round(mean, 9) DESC, model) = 1""")
def _(t):
    """The best base line model per pipeline by its 5-fold score; ``train_*`` choose among their models in the same way."""
    table = choice.compared(_base_scores(t).withColumn("score", F.col("score")))
    return table.filter("best").select("pipeline", F.col("model").alias("best"), F.round("mean", 9).alias("score"))


@query("ml25_model_comparison", "SELECT pipeline, model, round(mean, 9) AS mean, round(std, 9) AS std FROM base_means")
def _(t):
    return choice.compared(_base_scores(t)).select("pipeline", "model", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def _incomes(t):
    fitted = _fit(t, "income")
    spread = fitted.train.agg(F.stddev_samp(F.expm1("label"))).first()[0]
    return fitted, spread


def _price_rules(df):
    """What holds for every priced row: bounds of the prediction, order of the ranges, a bracket."""
    p = F.col("predicted_income")
    return df.select("profile_id", p.between(5000, 500000).alias("in_bounds"), ((F.col("salary_min") <= p) & (p <= F.col("salary_max"))).alias("salary_around"),
                     ((F.col("lower") <= p) & (p <= F.col("upper")) & (F.col("lower") >= 0)).alias("range_around"),
                     ((F.col("income_low") < p) & (p < F.col("income_high"))).alias("income_around"), F.col("salary_bracket").isNotNull().alias("has_bracket"))


@query("ml20_batch_income", "SELECT profile_id, true AS in_bounds, true AS salary_around, true AS range_around, true AS income_around, true AS has_bracket FROM profiles")
def _(t):
    fitted, spread = _incomes(t)
    return _price_rules(pl.priced_income(fitted.scored(fitted.spec.features(clean_profiles(t.profiles))), spread))


def _rank_rules(df, value):
    """What holds for every list of classes: its length, falling values, distinct labels, the sum of the values."""
    rows = F.sort_array(F.collect_list(F.struct("rank", value, "job_title")))
    lists = df.groupBy("profile_id").agg(rows.alias("r"))
    values = F.col(f"r.{value}")
    falling = F.forall(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: a >= b), lambda x: x)
    return lists.select("profile_id", F.size("r").cast("long").alias("listed"), falling.alias("falling"),
                        (F.size(F.array_distinct("r.job_title")) == F.size("r")).alias("distinct_labels"),
                        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("mass"))


@query("ml21_batch_recommendation", "SELECT profile_id, 10 AS listed, true AS falling, true AS distinct_labels, true AS mass_to_one FROM profiles")
def _(t):
    fitted = _fit(t, "job")
    out = pl.top_classes(fitted.scored(fitted.spec.features(clean_profiles(t.profiles))), fitted.labels, "p_forest", 10)
    return _rank_rules(out, "confidence").withColumn("mass_to_one", (F.col("mass") > 0) & (F.col("mass") <= 1.000001)).drop("mass")


@query("wi8_top_k_classes", "SELECT profile_id, 3 AS listed, true AS falling, true AS distinct_labels, true AS mass_to_one FROM profiles")
def _(t):
    fitted = _fit(t, "career")
    out = pl.top_classes(fitted.scored(fitted.spec.features(clean_profiles(t.profiles))), fitted.labels, "p_forest", 3)
    return _rank_rules(out, "confidence").withColumn("mass_to_one", (F.col("mass") > 0) & (F.col("mass") <= 1.000001)).drop("mass")


@query("wi9_top_five_shares", "SELECT profile_id, 5 AS listed, true AS falling, true AS distinct_labels, 1.0e0 AS mass FROM profiles")
def _(t):
    fitted = _fit(t, "job")
    out = pl.top_five_shares(fitted.scored(fitted.spec.features(clean_profiles(t.profiles))), fitted.labels, "p_forest")
    return _rank_rules(out.withColumn("job_title", pretty_label(F.col("job_title"))), "share")


@query("ml22_role_quick_score")
def _(t):
    fitted, spread = _incomes(t)
    roles = sets.role_profiles(t.profiles.select("profile_id", "job_title", "experience_years", "city_tier"))
    ready = clean_profiles(sets.with_form_defaults(roles.withColumns({
        "work_type": F.lit("Full-time"), "shift_type": F.lit("Day Shift"), "sector": F.lit("General")})))
    return pl.priced_income(fitted.scored(fitted.spec.features(ready)), spread)


@query("ml23_profile_report")
def _(t):
    """Eight scores per profile in one row, each with its fallback. Income comes first: its
    prediction replaces the asked-for income before the other models run."""
    fitted, spread = _incomes(t)
    base = clean_profiles(sets.with_form_defaults(t.profiles))
    money = pl.priced_income(fitted.scored(fitted.spec.features(base)), spread).select(
        "profile_id", F.col("predicted_income").alias("income"), "income_low", "income_high")
    people = written(base.drop("income").join(money, "profile_id"), "scored-income")
    report = people.select("profile_id", "income", "income_low", "income_high", "seniority_level", "domain")
    fallbacks = {"job": None, "suitability": "Good", "balance": "Good", "career": None, "skill_gap": "yes", "quality": "0"}
    for (name, fallback), model in zip(fallbacks.items(), _fit_all(t, fallbacks)):
        guess = model.scored(model.spec.features(people)).select("profile_id", F.col("predicted").alias(name), F.col("confidence").alias(f"{name}_confidence"))
        report = report.join(guess, "profile_id", "left")
        if fallback:
            report = report.withColumn(name, F.coalesce(name, F.lit(fallback)))
    report = report.withColumns({"job": pretty_label(F.coalesce("job", F.concat("domain", F.lit("_Entry")))),
                                 "career": F.coalesce("career", "seniority_level")})
    match = scoring.skill_match(people).select("profile_id", F.col("level").alias("skill_match"))
    complete = scoring.form_completeness(people.join(report.select("profile_id", "quality"), "profile_id"), "CAST(quality AS INT)")
    seekers = people.select(F.col("profile_id").alias("request_id"), "domain", "sector", "primary_skill", "work_mode", "work_type")
    jobs = requests.tiered_jobs(seekers, t.profiles).groupBy(F.col("request_id").alias("profile_id")).agg(
        F.array_join(F.array_sort(F.collect_list(F.format_string("%02d:%d", "rank", "profile_id"))), ",").alias("matched_jobs"))
    return _rounded(report.join(match, "profile_id", "left").join(complete, "profile_id", "left").join(jobs, "profile_id", "left"))


@query("ml24_retrain")
def _(t):
    """Work mode and salary from age, hours and encoded education."""
    rows = clean_profiles(t.profiles).select("profile_id", "age", F.col("hours_available").alias("hours"), F.expr(sets.SCORING_EDUCATION).alias("education"),
                                             "work_mode", F.col("salary_min").alias("salary"))
    ready = VectorAssembler(inputCols=["age", "hours", "education"], outputCol="features").transform(rows)
    modes = StringIndexer(inputCol="work_mode", outputCol="label", stringOrderType="alphabetAsc").fit(ready)
    ready = spread_over_cores(written(modes.transform(ready), "retrain"), pl.ROWS_PER_TASK)
    work = RandomForestClassifier(numTrees=50, maxDepth=6, seed=42).fit(ready)
    pay = RandomForestRegressor(labelCol="salary", numTrees=50, maxDepth=6, seed=42, predictionCol="pay").fit(ready)
    out = pay.transform(work.transform(ready))
    return out.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pay"), 2).alias("mean_pay"))


@query("master_table_export", """
  SELECT is_synthetic, job_category, count(*) AS n, (SELECT count(*) FROM postings) AS total_records FROM (SELECT false AS is_synthetic, job_category FROM featured_postings) GROUP BY ALL""")
def _(t):
    """Featured postings in the master schema, with the columns of the export."""
    jobs = merging.dense_ids(postings.featured(t.postings.drop("posted_at")), "row_id", "record_id").withColumn("is_synthetic", F.lit(False))
    table = merging.export_columns(merging.final_schema(jobs), t.postings.count())
    stored = written(table, "master")
    return stored.groupBy("is_synthetic", "job_category").agg(F.count(F.lit(1)).alias("n"), F.max("total_records").alias("total_records"))
