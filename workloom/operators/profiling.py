"""Table profiles and quality scores, as long metric tables from few passes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.operators.cleaning import _pandas_kind
from workloom.operators.statistics import quantiles

SALARY_RANGE = (10000, 10000000)
EXPERIENCE_RANGE = (0, 50)


def value_counts(df, columns=None):
    """(column, value, n) over the given columns; every other statistic builds on it."""
    columns = columns or df.columns
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def table_profile(df):
    """Rows, type, null count and share, distinct values per column."""
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    return (value_counts(df).groupBy("column_name")
            .agg(F.sum("n").alias("row_count"), nulls.alias("null_count"), F.count("value").alias("distinct_values"))
            .select("column_name", types[F.col("column_name")].alias("data_type"), "row_count", "null_count",
                    F.round(100.0 * F.col("null_count") / F.col("row_count"), 2).alias("null_pct"), "distinct_values"))


def describe(df, columns):
    """count, mean, std, min, quartiles and max per numeric column, all exact."""
    parts, quarters = [], quantiles(df, columns, [0.25, 0.5, 0.75])
    for c in columns:
        q = F.array(*[F.lit(x).cast("double") for x in quarters[c]])
        parts.append(F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                              F.min(c).cast("double").alias("min"), q.alias("q"),
                              F.max(c).cast("double").alias("max")).alias(c))
    row = df.agg(*parts)
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in columns])).alias("r"))
    return stacked.select("r.column_name", "r.s.count", "r.s.mean", "r.s.std", "r.s.min", F.col("r.s.q")[0].alias("q25"),
                          F.col("r.s.q")[1].alias("q50"), F.col("r.s.q")[2].alias("q75"), "r.s.max")


def top_values(df, columns, k, most_distinct):
    """Most frequent ``k`` values per column with fewer than ``most_distinct`` values."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    few = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") < most_distinct)
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (counts.join(F.broadcast(few.select("column_name")), "column_name", "left_semi")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def class_distribution(df, label):
    """Count and share per class. The window sees one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4).alias("pct"))


def _text_and_numbers(df):
    kinds = {c: _pandas_kind(t) for c, t in df.dtypes}
    return [c for c, k in kinds.items() if k == "text"], [c for c, k in kinds.items() if k in ("number", "flag")]


def validation(df, name):
    """One row of quality, business and readiness findings with the overall status.

    Two passes over the data: one plain aggregate (counts, ranges) and one that counts
    distinct rows and values.
    """
    texts, numbers = _text_and_numbers(df)
    pay = [c for c, t in df.dtypes if "salary" in c.lower() and c.lower() not in ("salary_bracket", "salary_category")
           and _pandas_kind(t) == "number"]
    years = [c for c, t in df.dtypes if (("experience" in c.lower() and "min" in c.lower()) or "max" in c.lower())
             and _pandas_kind(t) == "number"]
    wrong_types = sum(1 for c, t in df.dtypes if "salary" in c.lower() and "bracket" not in c.lower() and _pandas_kind(t) != "number")
    wrong_types += sum(1 for c, t in df.dtypes if ("flag" in c.lower() or c.lower().startswith("is_"))
                       and _pandas_kind(t) not in ("flag", "text"))
    exprs = [F.count(F.lit(1)).alias("rows"), sum((F.count(c) for c in df.columns), F.lit(0)).alias("filled")]
    exprs += [F.min(c).alias(f"lo_{c}") for c in set(pay + years)] + [F.max(c).alias(f"hi_{c}") for c in set(pay + years)]
    if "is_india" in df.columns:
        exprs.append(F.count_if("is_india").alias("home"))
    if "mother_suitability_score" in df.columns:
        exprs += [F.min("mother_suitability_score").alias("lo_score"), F.max("mother_suitability_score").alias("hi_score")]
    seen = df.agg(*exprs).first().asDict()
    rows, width = seen["rows"], len(df.columns)
    distinct = df.groupBy(*df.columns).agg(F.lit(1)).count()
    wide = value_counts(df, texts).filter("value IS NOT NULL").groupBy("column_name").count().filter("count > 1000").count() if texts else 0

    structure = "PASS"
    if rows > 1000000:
        structure = "WARNING"
    if rows < 100 or width < 10 or not {"job_title", "company"} <= set(df.columns):
        structure = "FAIL"
    complete = seen["filled"] / max(rows * width, 1)
    repeated = (rows - distinct) / max(rows, 1)
    issues = int(complete < 0.95) + int(repeated > 0.05) + wrong_types
    quality = min(complete * 50 + (1 - repeated) * 30 + (1 if issues == 0 else 0.5) * 20, 100)

    def outside(columns, low, high):
        return sum((seen[f"lo_{c}"] is not None and seen[f"lo_{c}"] < low) + (seen[f"hi_{c}"] is not None and seen[f"hi_{c}"] > high)
                   for c in columns)

    pay_issues, year_issues = outside(pay, *SALARY_RANGE), outside(years, *EXPERIENCE_RANGE)
    home_issue = int("home" in seen and seen["home"] / max(rows, 1) * 100 < 10)
    score_issue = int("hi_score" in seen and seen["hi_score"] is not None and (seen["hi_score"] > 10 or seen["lo_score"] < 0))
    business = pay_issues + year_issues + home_issue + score_issue

    targets = [c for c in df.columns if any(w in c.lower() for w in ("salary", "suitability", "category", "bracket"))]
    balanced = len(texts) >= 5 and len(numbers) >= 5
    ml_issues = wide + int(len(texts) < 5) + int(len(numbers) < 5)
    ready = max(min((len(texts) + len(numbers)) / 20 * 40, 40) + (20 if targets else 0) + (20 if balanced else 10) - 5 * ml_issues, 0)
    overall = (25 if structure == "PASS" else 0) + quality * 0.25 + (25 if business == 0 else 15) + ready * 0.25
    status = "EXCELLENT" if overall >= 80 else "GOOD" if overall >= 65 else "ACCEPTABLE" if overall >= 50 else "NEEDS_IMPROVEMENT"
    fields = {"dataset": name, "row_count": rows, "column_count": width, "size_validation": structure,
              "completeness": round(float(complete), 6), "duplicate_rate": round(float(repeated), 6),
              "quality_score": round(float(quality), 4),
              "salary_validation": "WARNING" if pay_issues else "PASS",
              "experience_validation": "WARNING" if year_issues else "PASS",
              "india_jobs_validation": "WARNING" if home_issue else "PASS", "business_issues": business,
              "target_count": len(targets), "ml_issues": ml_issues, "ml_readiness_score": round(float(ready), 4),
              "validation_score": round(float(overall), 4), "validation_status": status}
    return df.sparkSession.createDataFrame([tuple(fields.values())], ", ".join(
        f"{k} {'STRING' if isinstance(v, str) else 'DOUBLE' if isinstance(v, float) else 'BIGINT'}" for k, v in fields.items()))
