"""Profiles, summaries, quality scores and rankings over whole tables."""

from functools import reduce

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.operators import cleaning, postings, profiling, ranking, runlog, sketches
from workloom.operators.selection import grouped_quantiles
from workloom.operators.statistics import quantiles
from workloom.plans.registry import query
from workloom.session import written


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


_PROFILED = [("row_id", "bigint"), ("job_title", "string"), ("company", "string"), ("location", "string"), ("views", "bigint")]


@query("ag1_table_profile", " UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count,
    round(100.0e0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_values FROM postings""" for c, t in _PROFILED))
def _(t):
    return profiling.table_profile(t.postings.select(*[c for c, _ in _PROFILED]))


_NUMBERS = ["age", "hours_available", "income", "salary_min", "skill_match_score"]


@query("ag2_describe", " UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
    CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75,
    CAST(max({c}) AS DOUBLE) AS max FROM profiles""" for c in _NUMBERS))
def _(t):
    return profiling.describe(t.profiles, _NUMBERS).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("ag3_top_values", " UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, value, n, rank FROM (SELECT {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank
    FROM postings WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3 AND (SELECT count(DISTINCT {c}) FROM postings) < 1000""" for c in ("job_title", "location", "job_description")))
def _(t):
    return profiling.top_values(t.postings, ["job_title", "location", "job_description"], 3, 1000)


_SETS = ["companies", "company_industries", "company_specialities", "employee_counts", "gender_stats", "postings", "salary_rows", "profiles",
         "user_activities", "organization_jobs", "job_applications", "training_courses"]


@query("ag4_dataset_summary", "SELECT dataset, row_count, relevant FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS row_count, {str(any(w in n for w in ('job', 'company', 'skill', 'salary', 'india', 'gender', 'employee'))).lower()} AS relevant FROM {n}" for n in _SETS)
    + ") ORDER BY row_count DESC, dataset LIMIT 10")
def _(t):
    relevant = ["job", "company", "skill", "salary", "india", "gender", "employee"]
    sizes = _union([getattr(t, n).agg(F.count(F.lit(1)).alias("row_count")).withColumn("dataset", F.lit(n)) for n in _SETS])
    return sizes.select("dataset", "row_count", F.col("dataset").rlike("|".join(relevant)).alias("relevant")).orderBy(
        F.desc("row_count"), "dataset").limit(10)


_INDIA = "SELECT company_id FROM companies WHERE upper(country) = 'IN'"


@query("ag5_filtered_counts", f"""
  SELECT 'companies' AS dataset, count(*) AS total, count(*) FILTER (upper(country) = 'IN') AS kept FROM companies
  UNION ALL SELECT 'company_industries', count(*), count(*) FILTER (company_id IN ({_INDIA})) FROM company_industries
  UNION ALL SELECT 'employee_counts', count(*), count(*) FILTER (company_id IN ({_INDIA})) FROM employee_counts""")
def _(t):
    chosen = t.companies.filter(F.upper("country") == "IN").select("company_id", F.lit(True).alias("home"))

    def counted(df, name):
        return df.join(chosen, "company_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("home").alias("kept")).withColumn("dataset", F.lit(name))
    first = t.companies.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.upper("country") == "IN").alias("kept")).withColumn("dataset", F.lit("companies"))
    return _union([first, counted(t.company_industries, "company_industries"), counted(t.employee_counts, "employee_counts")]).select("dataset", "total", "kept")


@query("ag6_distinct_values", "SELECT DISTINCT country FROM companies")
def _(t):
    return t.companies.select("country").distinct()


_SKETCHED = ["user_id", "event_id", "ts"]


@query("ag6_distinct_sketches", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n, true AS close FROM events" for c in _SKETCHED) + ") WHERE n > 0")
def _(t):
    """Estimates from stored sketches per type of event, beside the exact counts: ``close`` is within 7 % of them."""
    stored = written(sketches.distinct_sketches(t.events, _SKETCHED, F.col("event_type")), "sketches")
    exact = _union([t.events.agg(F.countDistinct(c).alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct") for c in _SKETCHED])
    error = F.abs(F.col("estimate") - F.col("n_distinct")) / F.greatest("n_distinct", F.lit(1))
    return sketches.distinct_estimates(stored).join(F.broadcast(exact), "column").select("column", "n_distinct", "n", (error <= 0.07).alias("close"))


@query("ag7_master_metrics", """
  SELECT count(*) AS row_count, count(*) FILTER (company IS NULL) AS null_companies, count(*) - (SELECT count(*) FROM (SELECT DISTINCT job_title, company, location FROM featured_postings)) AS duplicate_rows,
    count(DISTINCT company) AS unique_companies, count(*) FILTER (is_india) AS india_jobs, count(*) FILTER (remote_flag) AS remote_jobs FROM featured_postings""")
def _(t):
    rows = postings.featured(t.postings.drop("posted_at"))
    # Equal spellings collapse first; the flags travel along as counts.
    per_key = rows.groupBy("job_title", "company", "location").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_india").alias("home"), F.count_if("remote_flag").alias("remote"))
    return per_key.agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("company").isNull(), F.col("n"))), F.lit(0)).alias("null_companies"),
                       (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"), F.countDistinct("company").alias("unique_companies"),
                       F.sum("home").alias("india_jobs"), F.sum("remote").alias("remote_jobs"))


_DIMS = ["job_category", "salary_bracket", "experience_category", "city_tier"]


@query("ag8_documentation", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS label, count(*) AS n, count(*) FILTER (is_india) AS india_jobs, count(*) FILTER (remote_flag) AS remote_jobs, count(*) FILTER (female_friendly) AS friendly_jobs FROM featured_postings GROUP BY {d}" for d in _DIMS)
    + " UNION ALL SELECT 'all', 'all', count(*), count(*) FILTER (is_india), count(*) FILTER (remote_flag), count(*) FILTER (female_friendly) FROM featured_postings")
def _(t):
    rows = postings.featured(t.postings.drop("posted_at")).select(*_DIMS, "is_india", "remote_flag", "female_friendly")
    # A small cube base first, so that the grouping sets expand few rows.
    base = rows.groupBy(*_DIMS).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_india").alias("home"),
                                    F.count_if("remote_flag").alias("remote"), F.count_if("female_friendly").alias("friendly"))
    sets = base.groupingSets([[F.col(d)] for d in _DIMS] + [[]], *_DIMS).agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("home").alias("india_jobs"), F.sum("remote").alias("remote_jobs"),
        F.sum("friendly").alias("friendly_jobs"))
    which = F.when(F.col("g") == 15, "all")
    for i, d in enumerate(_DIMS):
        which = which.when(F.col("g") == 15 - (8 >> i), d)
    return sets.select(which.alias("dimension"), F.when(F.col("g") == 15, "all").otherwise(F.coalesce(*_DIMS)).alias("label"),
                       "n", "india_jobs", "remote_jobs", "friendly_jobs")


@query("ag10_title_quantiles", """
  SELECT job_title, CAST(quantile_cont(salary_min, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont(salary_min, 0.75) AS DOUBLE) AS q75 FROM profiles GROUP BY job_title""")
def _(t):
    found = grouped_quantiles(t.profiles.select("job_title", "salary_min"), ["job_title"], "salary_min", [0.25, 0.75])
    return found.select("job_title", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))


@query("ag11_salary_statistics", """
  SELECT round(avg(salary_avg), 2) AS mean, median(salary_avg) AS median, round(stddev_samp(salary_avg), 2) AS std, min(salary_avg) AS min, max(salary_avg) AS max,
    quantile_cont(salary_avg, 0.25) AS q25, quantile_cont(salary_avg, 0.75) AS q75 FROM priced_postings""")
def _(t):
    v = "salary_avg"
    priced = written(postings.priced(t.postings.select("row_id", "salary_text")).select(v), "priced")
    q25, median, q75 = quantiles(priced, [v], [0.25, 0.5, 0.75])[v]
    return priced.agg(
        F.round(F.avg(v), 2).alias("mean"), F.lit(median).alias("median"), F.round(F.stddev_samp(v), 2).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.lit(q25).alias("q25"), F.lit(q75).alias("q75"))


@query("ag14_admin_totals", " UNION ALL ".join(f"SELECT '{a}' AS item, count(*) AS n FROM {b}" for a, b in [
    ("users", "users"), ("job_searches", "job_search_history"), ("skill_searches", "skill_search_history"), ("tasks", "tasks"),
    ("reminders", "reminders"), ("organizations", "organizations"), ("calls", "consultation_requests")]))
def _(t):
    tables = {"users": t.users, "job_searches": t.job_search_history, "skill_searches": t.skill_search_history, "tasks": t.tasks,
              "reminders": t.reminders, "organizations": t.organizations, "calls": t.consultation_requests}
    return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("item"), "n") for n, df in tables.items()])


@query("ag15_class_distribution", """
  SELECT domain, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM profiles), 4) AS pct FROM profiles GROUP BY domain""")
def _(t):
    return profiling.class_distribution(t.profiles, "domain")


_STEPS = """
  SELECT 'critical_columns' AS step, (SELECT count(*) FROM postings) AS rows_in, (SELECT count(*) FROM postings WHERE job_title IS NOT NULL AND company IS NOT NULL) AS rows_out
  UNION ALL SELECT 'same_keys', (SELECT count(*) FROM postings), (SELECT count(*) FROM (SELECT DISTINCT job_title, company, location FROM postings))
  UNION ALL SELECT 'companies_without_size', (SELECT count(*) FROM companies), (SELECT count(*) FROM companies WHERE company_size IS NOT NULL)
  UNION ALL SELECT 'no_such_column', (SELECT count(*) FROM postings), NULL"""


@query("ag16_run_summary", f"""
  WITH l AS (SELECT *, CASE WHEN rows_out IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status, round(100.0e0 * rows_out / rows_in, 4) AS score FROM ({_STEPS}))
  SELECT step, status, rows_in, rows_out, rows_in - rows_out AS removed, score, NULL::BIGINT AS succeeded, NULL::BIGINT AS failed FROM l
  UNION ALL SELECT 'ALL', CASE WHEN count(*) FILTER (rows_out IS NULL) > 0 THEN 'FAILED' ELSE 'SUCCESS' END, sum(rows_in)::BIGINT, sum(rows_out)::BIGINT,
    sum(rows_in - rows_out)::BIGINT, round(avg(score), 4), count(*) FILTER (rows_out IS NOT NULL), count(*) FILTER (rows_out IS NULL) FROM l""")
def _(t):
    steps = {"critical_columns": (t.postings, lambda df: cleaning.drop_missing(df, ["job_title", "company"])),
             "same_keys": (t.postings, lambda df: df.select("job_title", "company", "location").distinct()),
             "companies_without_size": (t.companies, lambda df: cleaning.drop_missing(df, ["company_size"])),
             "no_such_column": (t.postings, lambda df: df.dropna(subset=["rank_of_nothing"]))}
    return runlog.summary(runlog.run_steps(t.spark, steps))


# --- quality rules -------------------------------------------------------------
_RULED = ["row_id", "job_title", "company", "location", "salary_min", "salary_max", "salary_avg", "salary_bracket", "required_experience_max",
          "experience_category", "remote_flag", "is_india", "mother_suitability_score"]
_FILLED = " + ".join(f"count({c})" for c in _RULED)
_V = f"""
  WITH v AS (SELECT row_id, job_title, company, location, salary_min, salary_max, salary_avg, salary_bracket, job_description_experience_max AS required_experience_max,
      experience_category, remote_flag, is_india, mother_suitability_score FROM featured_postings),
  m AS (SELECT count(*) AS n, ({_FILLED}) / (count(*) * 13.0e0) AS complete,
      (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v))) / (1.0e0 * count(*)) AS repeated,
      (CASE WHEN min(salary_min) < 10000 THEN 1 ELSE 0 END + CASE WHEN max(salary_min) > 10000000 THEN 1 ELSE 0 END + CASE WHEN min(salary_max) < 10000 THEN 1 ELSE 0 END
        + CASE WHEN max(salary_max) > 10000000 THEN 1 ELSE 0 END + CASE WHEN min(salary_avg) < 10000 THEN 1 ELSE 0 END + CASE WHEN max(salary_avg) > 10000000 THEN 1 ELSE 0 END) AS pay_issues,
      (CASE WHEN min(salary_max) < 0 THEN 1 ELSE 0 END + CASE WHEN max(salary_max) > 50 THEN 1 ELSE 0 END + CASE WHEN min(required_experience_max) < 0 THEN 1 ELSE 0 END
        + CASE WHEN max(required_experience_max) > 50 THEN 1 ELSE 0 END) AS year_issues,
      CASE WHEN 100.0e0 * count(*) FILTER (is_india) / count(*) < 10 THEN 1 ELSE 0 END AS home_issue,
      (SELECT count(*) FROM (SELECT count(DISTINCT job_title) AS d FROM v UNION ALL SELECT count(DISTINCT company) FROM v UNION ALL SELECT count(DISTINCT location) FROM v) WHERE d > 1000) AS wide FROM v),
  q AS (SELECT *, CASE WHEN n < 100 THEN 'FAIL' WHEN n > 1000000 THEN 'WARNING' ELSE 'PASS' END AS size_validation,
      least(complete * 50 + (1 - repeated) * 30 + CASE WHEN complete >= 0.95 AND repeated <= 0.05 THEN 20 ELSE 10 END, 100) AS quality,
      pay_issues + year_issues + home_issue AS business, greatest(least(13 / 20.0e0 * 40, 40) + 20 + 20 - 5 * wide, 0) AS ready FROM m),
  o AS (SELECT *, CASE WHEN size_validation = 'PASS' THEN 25 ELSE 0 END + quality * 0.25e0 + CASE WHEN business = 0 THEN 25 ELSE 15 END + ready * 0.25e0 AS overall FROM q)
"""


def _validated(t):
    rows = postings.featured(t.postings.drop("posted_at")).select(*_RULED)
    # Several passes follow, so the featured rows are stored once.
    return profiling.validation(written(rows, "featured"), "postings")


@query("cr9_structure_rules", _V + "SELECT n AS row_count, CAST(13 AS BIGINT) AS column_count, size_validation FROM o")
def _(t):
    return _validated(t).select("row_count", "column_count", "size_validation")


@query("cr10_quality_score", _V + "SELECT round(complete, 6) AS completeness, round(repeated, 6) AS duplicate_rate, round(quality, 4) AS quality_score FROM o")
def _(t):
    return _validated(t).select("completeness", "duplicate_rate", "quality_score")


@query("cr11_business_rules", _V + """SELECT CASE WHEN pay_issues > 0 THEN 'WARNING' ELSE 'PASS' END AS salary_validation,
  CASE WHEN year_issues > 0 THEN 'WARNING' ELSE 'PASS' END AS experience_validation, CASE WHEN home_issue > 0 THEN 'WARNING' ELSE 'PASS' END AS india_jobs_validation,
  CAST(business AS BIGINT) AS business_issues FROM o""")
def _(t):
    return _validated(t).select("salary_validation", "experience_validation", "india_jobs_validation", "business_issues")


@query("cr12_ml_readiness", _V + "SELECT CAST(wide AS BIGINT) AS ml_issues, CAST(6 AS BIGINT) AS target_count, round(ready, 4) AS ml_readiness_score FROM o")
def _(t):
    return _validated(t).select("ml_issues", "target_count", "ml_readiness_score")


@query("cr13_overall_status", _V + """SELECT round(overall, 4) AS validation_score,
  CASE WHEN overall >= 80 THEN 'EXCELLENT' WHEN overall >= 65 THEN 'GOOD' WHEN overall >= 50 THEN 'ACCEPTABLE' ELSE 'NEEDS_IMPROVEMENT' END AS validation_status FROM o""")
def _(t):
    return _validated(t).select("validation_score", "validation_status")


# --- windows and rankings ------------------------------------------------------
@query("wi1_keep_first", """
  SELECT row_id, company_id FROM (SELECT row_id, company_id, row_number() OVER (PARTITION BY company_id ORDER BY row_id) AS rn FROM postings) WHERE rn = 1""")
def _(t):
    # The first row of a key is its least id, so a mergeable aggregate does it.
    return t.postings.groupBy("company_id").agg(F.min("row_id").alias("row_id")).select("row_id", "company_id")


@query("wi2_best_record", """
  SELECT company_id, row_id FROM (SELECT company_id, row_id, row_number() OVER (PARTITION BY company_id
    ORDER BY (CASE WHEN salary_text IS NULL THEN 0 ELSE 1 END) + (CASE WHEN views IS NULL THEN 0 ELSE 1 END) DESC, row_id) AS rn FROM postings) WHERE rn = 1""")
def _(t):
    filled = F.col("salary_text").isNotNull().cast("int") + F.col("views").isNotNull().cast("int")
    return t.postings.groupBy("company_id").agg(F.max_by("row_id", F.struct(filled, -F.col("row_id"))).alias("row_id"))


def _quintile_sql(value, table, labels):
    return (f"SELECT profile_id, CASE greatest(1, CAST(ceil((r - 1) * 5 / (n - 1.0e0)) AS INT)) " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(labels))
            + f" END AS class FROM (SELECT profile_id, row_number() OVER (ORDER BY {value}, profile_id) AS r, count(*) OVER () AS n FROM {table})")


@query("wi3_quintile_label", _quintile_sql("mother_suitability_score", "profiles", lexicon.SUITABILITY_CLASSES))
def _(t):
    return ranking.quintile_labels(t.profiles.select("profile_id", "mother_suitability_score"), "mother_suitability_score", "profile_id",
                                   lexicon.SUITABILITY_CLASSES, "class").select("profile_id", "class")


@query("wi4_value_quantile_cut", """
  SELECT profile_id, CASE WHEN income >= e[1] AND income <= e[2] THEN 'Very_Low' WHEN income > e[2] AND income <= e[3] THEN 'Low' WHEN income > e[3] AND income <= e[4] THEN 'Medium'
    WHEN income > e[4] AND income <= e[5] THEN 'High' WHEN income > e[5] AND income <= e[6] THEN 'Very_High' END AS income_level
  FROM clean_profiles, (SELECT quantile_cont(income, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM clean_profiles)""")
def _(t):
    from workloom.features.profiles import clean_profiles
    from workloom.features.sets import income_level
    return income_level(clean_profiles(t.profiles).select("profile_id", "income")).select("profile_id", "income_level")


@query("wi14_null_ranking", "SELECT column_name, null_count FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM profiles" for c in
    ["age", "hours_available", "income", "secondary_skill", "education", "city", "career_growth", "device", "all_skills", "language", "kids", "domain"])
    + ") ORDER BY null_count DESC, column_name LIMIT 10")
def _(t):
    from workloom.operators.cleaning import null_shares
    columns = ["age", "hours_available", "income", "secondary_skill", "education", "city", "career_growth", "device", "all_skills", "language", "kids", "domain"]
    return null_shares(t.profiles.select(*columns)).select("column_name", "null_count").orderBy(F.desc("null_count"), "column_name").limit(10)


@query("wi15_newest_first", "SELECT id, user_id, status FROM consultation_requests")
def _(t):
    return t.consultation_requests.orderBy(F.desc("created_at"), "id").select("id", "user_id", "status")
