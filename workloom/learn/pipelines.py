"""The eight training pipelines on Spark ML: preparation, models, ensembles, reports."""

from dataclasses import dataclass
from functools import reduce
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import (IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, OneHotEncoder,
                                RegexTokenizer, RobustScaler, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg import Vectors as MLlibVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workloom import lexicon
from workloom.features import sets
from workloom.features.profiles import BOOLEAN, clean_profiles
from workloom.learn import evaluate
from workloom.session import spread_over_cores, written
from workloom.text.tfidf import TOKEN

ROW = "profile_id"
#: Rows from which on a task of its own is worth while in a fit.
ROWS_PER_TASK = 10_000
#: Rows that a forest looks at for the splits of a number, at least, and share of the rows from which on a value is not missed.
SPLIT_ROWS, RARE = 10_000, 0.002
BINARY = [c for c in BOOLEAN if c != "is_verified"]


@dataclass(frozen=True)
class Text:
    """A text block: column, vocabulary size, n-gram range and document frequency bounds."""
    column: str
    features: int
    ngrams: tuple = (1, 1)
    min_df: float = 1.0
    max_df: float = 1.0


@dataclass(frozen=True)
class Spec:
    name: str
    target: object
    features: object
    numeric: tuple
    categorical: tuple
    texts: tuple = ()
    components: int = 0
    regression: bool = False
    robust: bool = False

    def columns(self):
        """Columns of the labelled profiles that the preparation, the split and the models read."""
        texts = [t.column for t in self.texts]
        return list(dict.fromkeys([ROW, "target", *self.numeric, *self.categorical, *texts]))


def _target(expression):
    return lambda df: df.withColumn("target", F.expr(expression) if isinstance(expression, str) else expression)


def _class(maker, column):
    return lambda df: maker(df).withColumn("target", F.col(column))


def _match_target(df):
    # The score first, as a column of its own: the class tests it several times.
    return df.withColumn("__score", F.expr(sets.skill_match_target())).withColumn(
        "target", F.expr(sets.skill_match_class("__score"))).drop("__score")


WORK = ("domain", "sector", "education", "city_tier", "work_mode", "work_type", "seniority_level", "marital_status", "shift_type")
SPECS = {s.name: s for s in [
    Spec("job", _target(sets.job_category_target()), sets.job_features,
         ("age", "kids", "hours_available", "experience_years", "has_kids", "is_remote", "skills_count"),
         WORK + ("age_group", "exp_level", "hours_category", "computed_seniority"), (Text("all_skills", 100),), 20),
    Spec("income", _target(f"log1p({sets.income_target()})"), sets.income_features,
         ("age", "kids", "hours_available", "experience_years", "age_squared", "exp_squared", "exp_age_ratio", "flexibility_score",
          "benefits_score", "city_tier_num", "has_kids", "kids_impact", "seniority_num", "career_growth_num", "education_num",
          "mother_suitability_score", "skill_match_score", "work_life_balance", *BINARY),
         ("domain", "sector", "city_tier", "work_mode", "work_type", "shift_type", "age_group", "exp_level"),
         (Text("all_skills", 50), Text("job_title", 30)), 15, regression=True, robust=True),
    Spec("suitability", _class(sets.suitability_class, "suitability_class"), sets.suitability_features,
         ("age", "kids", "hours_available", "experience_years", "income", "flexibility_score", "family_support_score", "total_benefits",
          "work_stress", "mother_friendly_composite", "kids_factor", "kids_count_impact", "day_shift", "hours_suitable", *BINARY), WORK),
    Spec("balance", _class(sets.balance_class, "wlb_class"), sets.balance_features,
         ("age", "kids", "hours_available", "experience_years", "income", "flexibility_score", "hours_stress", "reasonable_hours", "no_travel",
          "day_shift", "night_shift", "family_friendly_score", "benefits_score", "work_mode_score", "balance_composite", "has_kids",
          "multiple_kids", *BINARY), WORK + ("travel_required",)),
    Spec("skill_match", _match_target, sets.match_features,
         ("age", "experience_years", "hours_available", "skills_count", "flexibility_score", "benefits_score", "exp_age_ratio", "hours_util",
          *BINARY), ("domain", "sector", "education", "seniority_level", "exp_level", "age_group", "income_level"),
         (Text("all_skills", 100, (1, 2), 3.0, 0.95), Text("job_title", 50, (1, 2), 3.0, 0.95)), 30),
    Spec("skill_gap", _target("CASE WHEN training_provided = 1 THEN 'yes' ELSE 'no' END"), sets.gap_features,
         ("age", "experience_years", "income", "skills_count", "skill_diversity", "skill_exp_ratio", "skill_gap_indicator", "growth_gap",
          "expected_skills", "skill_deficiency", "domain_complexity", "training_likelihood"),
         ("domain", "sector", "education", "seniority_level", "work_mode"),
         (Text("all_skills", 150, (1, 2), 3.0, 0.95), Text("job_title", 50, (1, 2), 3.0, 0.95)), 40),
    Spec("career", _target("seniority_level"), sets.career_features,
         ("age", "experience_years", "income", "skills_count", "exp_age_ratio", "career_velocity", "income_per_exp", "education_level",
          "growth_potential", "job_stability", "leadership_indicator"), ("domain", "sector", "education", "work_mode", "work_type"),
         (Text("all_skills", 100, (1, 2), 3.0, 0.95),), 25),
    Spec("quality", _target(f"CAST({sets.quality_target()} AS STRING)"), sets.quality_features,
         ("age", "experience_years", "income", "hours_available", "kids", "salary_min", "salary_max", "education_level", "seniority_num",
          "skills_count", "exp_edu_interaction", "income_per_exp", "benefits_count", "hours_bucket", "age_group", "city_tier_num",
          "has_secondary_skill", *BINARY), ("education", "domain", "sector", "seniority_level", "city_tier", "work_mode", "work_type"),
         (Text("all_skills", 50, (1, 2), 5.0, 0.95),), 15),
]}


def labelled(profiles, spec):
    """Cleaned profiles with target and features."""
    df = clean_profiles(profiles)
    if spec.name == "career":
        df = df.withColumn("target", sets.seniority_standard(F.col("seniority_level")))
    else:
        df = spec.target(df)
    return spec.features(df)


def split(df, spec, share=0.2):
    """Test and train part: stratified for classes, by hash alone for a number."""
    if spec.regression:
        return df.withColumn("part", F.when(evaluate.fold_of(ROW, 100) < int(share * 100), "test").otherwise("train"))
    return evaluate.stratified_split(df, "target", ROW, share)


# --- preparation ---------------------------------------------------------------
def _text_stages(text, i):
    words, kept, two, both, counts, idf = (f"__{n}{i}" for n in ("words", "kept", "two", "both", "counts", "idf"))
    stages = [RegexTokenizer(inputCol=text.column, outputCol=words, pattern=TOKEN, gaps=False),
              StopWordsRemover(inputCol=words, outputCol=kept, stopWords=lexicon.STOP_WORDS)]
    source = kept
    if text.ngrams[1] > 1:
        stages += [NGram(n=2, inputCol=kept, outputCol=two),
                   SQLTransformer(statement=f"SELECT *, concat({kept}, {two}) AS {both} FROM __THIS__")]
        source = both
    return stages + [CountVectorizer(inputCol=source, outputCol=counts, vocabSize=text.features, minDF=text.min_df,
                                     maxDF=text.max_df if text.max_df < 1 else 2.0 ** 63 - 1025),
                     IDF(inputCol=counts, outputCol=idf)]


AXES = "term INT, weights ARRAY<DOUBLE>"
#: Columns from which on Spark's solver of singular values passes over the rows in every iteration.
LOCAL_WIDTH = 100
#: Spark's solver keeps its state in static fields of the driver's JVM: of two solves at the same time each spoils the other's.
SOLVER = Lock()


class Preparation:
    """Fitted preparation: structured block, text block and its reduced form."""

    def __init__(self, model, axes, final):
        self.model, self.axes, self.final = model, axes, final

    def transform(self, df):
        out = self.model.transform(df)
        if self.axes is not None:
            out = out.withColumn("__reduced", array_to_vector(project(self.axes)(vector_to_array("__tfidf"))))
        return self.final.transform(out)

    def save(self, spark, path):
        """Stages, and the singular axes as a table of one row per term (none without texts)."""
        self.model.write().overwrite().save(f"{path}/model")
        self.final.write().overwrite().save(f"{path}/final")
        rows = [] if self.axes is None else [(i, [float(x) for x in row]) for i, row in enumerate(self.axes)]
        spark.createDataFrame(rows, AXES).write.mode("overwrite").parquet(f"{path}/axes")

    @staticmethod
    def load(spark, path):
        rows = sorted(spark.read.schema(AXES).parquet(f"{path}/axes").collect())  # vocabulary times components, small by construction
        axes = np.array([r.weights for r in rows]) if rows else None
        return Preparation(PipelineModel.load(f"{path}/model"), axes, VectorAssembler.load(f"{path}/final"))


def projected(rows, axes):
    """Rows times the axes, summed term by term: the last bits of a row do not depend on its neighbours,
    as they do in a matrix product, which picks its order of sums by the shape of the batch."""
    out = np.zeros((len(rows), axes.shape[1]))
    for term, weights in enumerate(axes):
        out += rows[:, term:term + 1] * weights
    return out


def project(axes):
    """Arrow function: rows times the singular axes."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(projected(np.stack(rows.to_numpy()), axes)))
    return product


def gram_rows(df, column, width):
    """``i, values``: the rows of the matrix product of a column of arrays with itself, summed in one pass over ``df``.
    A task sends one row per term, whatever its rows."""
    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = df.select(vector_to_array(column)).mapInArrow(sums, "i INT, v ARRAY<DOUBLE>")
    return parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("values"))


def singular_axes(df, column, k):
    """Right singular vectors of the uncentred matrix; vocabulary times k, small by construction.

    The solver forms the product of a narrow matrix in one pass. On a wide one every iteration would be a pass; as the axes
    are those of any matrix with the same product, it gets a square factor of that, of one row per term, instead.
    """
    width = df.select(F.size(vector_to_array(column))).first()[0]
    if width < LOCAL_WIDTH:
        rows = MLUtils.convertVectorColumnsFromML(df.select(column), column).rdd.map(lambda r: r[0])
        with SOLVER:
            found = RowMatrix(rows).computeSVD(min(k, width), computeU=False)
        return found.V.toArray(), found.s.toArray()
    product = np.array([r["values"] for r in sorted(gram_rows(df, column, width).collect())])
    powers, axes = np.linalg.eigh(product)
    factor = np.sqrt(np.maximum(powers, 0.0))[:, None] * axes.T
    rows = df.sparkSession.sparkContext.parallelize([MLlibVectors.dense(row) for row in factor], 1)
    with SOLVER:
        found = RowMatrix(rows).computeSVD(min(k, width), computeU=False)
    return found.V.toArray(), found.s.toArray()


def fit_preparation(train, spec):
    index = [f"__i_{c}" for c in spec.categorical]
    onehot = [f"__h_{c}" for c in spec.categorical]
    scaler = (RobustScaler(inputCol="__numbers", outputCol="__scaled", withCentering=True) if spec.robust
              else StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True))
    stages = [StringIndexer(inputCols=list(spec.categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True, handleInvalid="error"),
              VectorAssembler(inputCols=list(spec.numeric), outputCol="__numbers", handleInvalid="keep"), scaler]
    for i, text in enumerate(spec.texts):
        stages += _text_stages(text, i)
    fitted = Pipeline(stages=stages).fit(train)
    more, blocks, axes = [], ["__scaled", *onehot], None
    if spec.texts:
        units = []
        for i, text in enumerate(spec.texts):
            idf = next(m for m in fitted.stages if getattr(m, "getOutputCol", lambda: "")() == f"__idf{i}")
            more += [ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol=f"__counts{i}", outputCol=f"__w{i}"),
                     Normalizer(inputCol=f"__w{i}", outputCol=f"__unit{i}")]
            units.append(f"__unit{i}")
        more.append(VectorAssembler(inputCols=units, outputCol="__tfidf"))
        blocks.append("__reduced")
    model = PipelineModel(stages=fitted.stages + more)
    if spec.texts:
        axes, _ = singular_axes(model.transform(train), "__tfidf", spec.components)
    return Preparation(model, axes, VectorAssembler(inputCols=blocks, outputCol="features"))


# --- models --------------------------------------------------------------------
def estimator(kind, spec, classes, width, trees=20, depth=8, rounds=10):
    """One model. Forests keep the node of every row and tree from level to level, instead of walking all trees again."""
    if spec.regression:
        return {"forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True),
                "boosting": GBTRegressor(maxIter=rounds, maxDepth=5, seed=42),
                "huber": LinearRegression(loss="huber", maxIter=100, regParam=0.001),
                "ridge": LinearRegression(regParam=0.1)}[kind]
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, weightCol="weight", cacheNodeIds=True)
    if kind == "boosting":
        gbt = GBTClassifier(maxIter=rounds, maxDepth=5, seed=42)
        return gbt if classes == 2 else OneVsRest(classifier=gbt, parallelism=4)
    if kind == "network":
        return MultilayerPerceptronClassifier(layers=[width, 64, 32, classes], maxIter=60, seed=42)
    return LogisticRegression(maxIter=50, regParam=0.01, weightCol="weight")


def with_probabilities(model, df, name):
    """Adds ``p_<name>``: class probabilities as an array. One-vs-rest scores are squashed and normalised."""
    raw = f"__raw_{name}"
    model = model.copy()
    model.setPredictionCol(f"__hat_{name}").setRawPredictionCol(raw)
    if model.hasParam("probabilityCol"):
        model.setProbabilityCol(f"__prob_{name}")
        return model.transform(df).withColumn(f"p_{name}", vector_to_array(f"__prob_{name}")).drop(raw, f"__hat_{name}", f"__prob_{name}")
    out = model.transform(df).withColumn(f"p_{name}", F.transform(vector_to_array(raw), lambda x: 1 / (1 + F.exp(-2 * x))))
    mass = F.aggregate(F.col(f"p_{name}"), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn(f"p_{name}", F.transform(f"p_{name}", lambda x: x / mass)).drop(raw, f"__hat_{name}")


def argmax(probabilities):
    """Place of the largest probability; of equal ones the first, which is the label that sorts first."""
    p = F.col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("double")


class Fitted:
    """One pipeline fitted on its train part: preparation, labels and models by name. ``rows`` are the labelled profiles."""

    def __init__(self, spec, preparation, labels, models, train, test, rows=None):
        self.spec, self.preparation, self.labels, self.models, self.train, self.test = spec, preparation, labels, models, train, test
        self.rows = rows

    def scored(self, df, name="forest"):
        ready = self.preparation.transform(df)
        if self.spec.regression:
            return self.models[name].copy().setPredictionCol("prediction").transform(ready)
        out = with_probabilities(self.models[name], ready, name)
        return out.withColumns({"prediction": argmax(f"p_{name}"), "predicted": F.element_at(F.lit(self.labels), (argmax(f"p_{name}") + 1).cast("int")),
                                "confidence": F.array_max(f"p_{name}")})


LOADERS = {"forest": (RandomForestClassificationModel, RandomForestRegressionModel), "boosting": (GBTClassificationModel, GBTRegressionModel)}


def save_fitted(spark, fitted, path):
    """Preparation, label list and tree models; ``load_fitted`` needs nothing but the path and the spec."""
    fitted.preparation.save(spark, path)
    spark.createDataFrame(list(enumerate(fitted.labels)), "place INT, label STRING").write.mode("overwrite").parquet(f"{path}/labels")
    for name, model in fitted.models.items():
        model.write().overwrite().save(f"{path}/models/{name}")


def load_fitted(spark, path, spec, names=("forest",)):
    """A fitted pipeline for scoring, without its train and test parts."""
    labels = [r.label for r in sorted(spark.read.schema("place INT, label STRING").parquet(f"{path}/labels").collect())]
    models = {n: LOADERS[n][spec.regression].load(f"{path}/models/{n}") for n in names}
    return Fitted(spec, Preparation.load(spark, path), labels, models, None, None)


def as_numbers(df):
    """``df`` of many rows with features told as numbers. The columns of a one-hot code are told as categories, which a forest
    of several classes tests by sets, value by value. A column of zeros and ones has the same only split as a number, so the
    trees are alike but for splits of equal gain, which the order of sums decides. Splits of numbers come from a sample of
    ``SPLIT_ROWS`` rows: where a column has a value in fewer than ``RARE`` of the rows, all stay as they are told, and so do
    tables that are no larger than the sample."""
    attributes = df.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    places = [a["idx"] for a in attributes.get("binary", ())]
    if not places or attributes.get("nominal"):
        return df
    row = df.select(Summarizer.metrics("numNonZeros", "count").summary(F.col("features")).alias("s")).first().s
    ones = row.numNonZeros.toArray()[places]
    fewest = np.minimum(ones, row["count"] - ones)
    if row["count"] <= SPLIT_ROWS or ((fewest > 0) & (fewest < RARE * row["count"])).any():
        return df
    return df.withMetadata("features", {})


def _weighted(train, spec):
    if spec.regression:
        return train
    return train.join(F.broadcast(evaluate.class_weights(train, "label")), "label")


def fit(profiles, spec, kinds=("forest",), store=None, **size):
    """Split, prepare on the train part and fit the named models.

    ``store`` writes the prepared rows once; every model reads that table. Stored are the columns that the spec names only.
    """
    rows = labelled(profiles, spec).select(*spec.columns())
    if store:
        # Stored before the split: the label is a long expression, and the joins of the split
        # would push null tests of it into every scan.
        rows = store(rows, f"labelled-{spec.name}")
        df = store(split(rows, spec), f"split-{spec.name}")
    else:
        df = split(rows, spec)
    train = df.filter("part = 'train'")
    preparation = fit_preparation(train, spec)
    ready = preparation.transform(df)
    if spec.regression:
        labels, ready = [], ready.withColumn("label", F.col("target"))
    else:
        indexer = StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
        labels, ready = list(indexer.labels), indexer.transform(ready)
    ready = ready.select(ROW, "features", "label", "part")
    if store:
        ready = store(ready, f"ready-{spec.name}")
    train = spread_over_cores(_weighted(ready.filter("part = 'train'"), spec), ROWS_PER_TASK)
    width = ready.select(F.size(vector_to_array("features"))).first()[0]
    models = {k: estimator(k, spec, len(labels), width, **size).fit(train) for k in kinds}
    return Fitted(spec, preparation, labels, models, train, ready.filter("part = 'test'"), rows)


def metrics(fitted, name):
    """Test metrics of one model as one row."""
    if fitted.spec.regression:
        out = fitted.models[name].transform(fitted.test).select(F.expm1("label").alias("actual"), F.expm1("prediction").alias("estimate"))
        return evaluate.regression_metrics(out)
    out = with_probabilities(fitted.models[name], fitted.test, name)
    return evaluate.classification_metrics(out.withColumn("prediction", argmax(f"p_{name}")))


def voting(fitted, df, names=None):
    """Mean of the class probabilities of several models."""
    names = list(names or fitted.models)
    for n in names:
        df = with_probabilities(fitted.models[n], df, n)
    mean = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(f"p_{n}") for n in names])
    return df.withColumn("p_vote", F.transform(mean, lambda x: x / len(names))).withColumn("prediction", argmax("p_vote"))


def top_classes(df, labels, probabilities, k):
    """One row per recommendation: rank, label and confidence."""
    pairs = F.transform(F.col(probabilities), lambda p, i: F.struct((-p).alias("neg"), i.alias("at")))
    best = F.slice(F.array_sort(pairs), 1, k)
    rows = df.select(ROW, F.posexplode(best).alias("pos", "s"))
    return rows.select(ROW, (F.col("pos") + 1).alias("rank"), F.element_at(F.lit(labels), F.col("s.at") + 1).alias("job_title"),
                       (-F.col("s.neg")).alias("confidence"), F.format_string("%.1f%%", -F.col("s.neg") * 100).alias("confidence_percent"))


def top_five_shares(df, labels, probabilities):
    """Best five classes with their probabilities rescaled to sum to one. They are stored, so that their sum does not
    score every row a second time."""
    top = written(top_classes(df, labels, probabilities, 5), "top-five")
    total = top.groupBy(ROW).agg(F.sum("confidence").alias("mass"))
    return top.join(total, ROW).select(ROW, "rank", "job_title", F.when(F.col("mass") > 0, F.col("confidence") / F.col("mass"))
                                       .otherwise(F.col("confidence")).alias("share"))


def priced_income(df, spread):
    """Money columns from a log-scale prediction."""
    from workloom.functions.pay import income_bracket
    income = F.least(F.greatest(F.expm1("prediction"), F.lit(5000.0)), F.lit(500000.0))
    out = df.withColumn("income_pred", income)
    return out.select(ROW, F.bround("income_pred", 0).alias("predicted_income"), F.expr(income_bracket("income_pred")).alias("salary_bracket"),
                      F.bround(F.col("income_pred") * 0.85, 0).alias("salary_min"), F.bround(F.col("income_pred") * 1.15, 0).alias("salary_max"),
                      F.bround(F.greatest(F.lit(0.0), F.col("income_pred") - spread), 0).alias("lower"),
                      F.bround(F.col("income_pred") + spread, 0).alias("upper"),
                      F.floor(F.floor("income_pred") * 0.80).alias("income_low"), F.floor(F.floor("income_pred") * 1.25).alias("income_high"))
