"""Sources, sinks, projections and filters."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions import text as tx
from workloom.functions.rules import is_filled
from workloom.operators import cleaning, naming
from workloom.operators.merging import dense_ids, final_schema
from workloom.plans.registry import query
from workloom.session import scratch_path, written
from workloom.sources import files

COMPANY_SCHEMA = ("company_id BIGINT, name STRING, description STRING, company_size STRING, state STRING, "
                  "country STRING, city STRING, zip_code STRING, url STRING")


# --- sources and sinks ---------------------------------------------------------
@query("io1_csv_scan", "SELECT company_id, name, city, zip_code FROM companies")
def _(t):
    path = scratch_path(t.spark, "companies-csv")
    files.write_csv(t.companies, path)
    return files.read_csv(t.spark, path, COMPANY_SCHEMA).select("company_id", "name", "city", "zip_code")


@query("io2_prefix_scan", """
  SELECT count(*) AS n, count(DISTINCT lower(country)) AS countries FROM companies""")
def _(t):
    path = scratch_path(t.spark, "prefixed")
    files.write_csv(t.companies, f"{path}/cleaned_companies")
    files.write_csv(t.companies.filter("country = 'US'"), f"{path}/raw_companies")
    found = files.read_matching(t.spark, f"{path}/cleaned_companies", "part-*.csv", COMPANY_SCHEMA)
    return found.filter(F.col("source_file").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("country")).alias("countries"))


@query("io3_preview", "SELECT row_id, job_title, company FROM postings ORDER BY row_id LIMIT 20")
def _(t):
    return files.preview(t.postings.select("row_id", "job_title", "company"), "row_id", 20)


@query("io4_optional_read", "SELECT count(*) AS companies, CAST(0 AS BIGINT) AS extra FROM companies")
def _(t):
    missing = files.read_if_present(t.spark, scratch_path(t.spark, "absent"), "company_id BIGINT, note STRING")
    return t.companies.agg(F.count(F.lit(1)).alias("companies"), F.lit(missing.count()).cast("long").alias("extra"))


@query("io5_table_sink", "SELECT company_id, count(*) AS postings FROM postings GROUP BY company_id")
def _(t):
    stored = written(t.postings.select("row_id", "company_id"), "postings")
    return stored.groupBy("company_id").agg(F.count(F.lit(1)).alias("postings"))


@query("io6_report_sink", """
  SELECT 'company' AS column_name, count(*) FILTER (company IS NULL) AS null_count FROM postings
  UNION ALL SELECT 'job_title', count(*) FILTER (job_title IS NULL) FROM postings
  UNION ALL SELECT 'location', count(*) FILTER (location IS NULL) FROM postings""")
def _(t):
    from workloom.operators.cleaning import null_shares
    path = scratch_path(t.spark, "report")
    files.write_report(null_shares(t.postings.select("job_title", "company", "location")), path)
    return t.spark.read.schema("column_name STRING, null_count BIGINT").json(path)


@query("io9_sampled_scan", "SELECT row_id, job_title FROM postings WHERE CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10")
def _(t):
    return files.hash_sample(t.postings, "row_id", 10, 100).select("row_id", "job_title")


# --- projection, rename, cast --------------------------------------------------
@query("pr1_name_normaliser", """
  SELECT row_id AS row_id, job_title AS job_title, company AS company_name, salary_text AS salary_est_inr FROM postings""")
def _(t):
    raw = t.postings.select(F.col("row_id").alias(" Row ID "), F.col("job_title").alias("Job Title"),
                            F.col("company").alias("Company_Name "), F.col("salary_text").alias("Salary Est. (INR)"))
    return naming.normalise_names(raw)


@query("pr2_synonym_rename", """
  SELECT row_id AS user_id, job_title AS job_title, company AS company, location AS location, 'x' AS address FROM postings""")
def _(t):
    raw = t.postings.select(F.col("row_id").alias("profile_id"), F.col("job_title").alias("position"),
                            F.col("company").alias("employer"), F.col("location").alias("city"),
                            F.lit("x").alias("address"))
    return raw.withColumnsRenamed(naming.synonym_plan(raw.columns))


@query("pr3_kind_renames", """
  SELECT row_id, minsalary AS salary_min, maxsalary AS salary_max, hourly AS is_hourly,
    employerprovided AS employer_provided FROM salary_rows""")
def _(t):
    raw = t.salary_rows.select("row_id", "minsalary", "maxsalary", "hourly", "employerprovided")
    return naming.standardise(raw, "salary_data.csv")


@query("pr4_coercing_cast", """
  SELECT row_id, TRY_CAST(founded AS BIGINT) AS founded, minsalary AS salary_min FROM salary_rows""")
def _(t):
    raw = t.salary_rows.select("row_id", "founded", F.col("minsalary").cast("string").alias("salary_min"))
    return naming.coerce_types(raw)


@query("pr5_final_schema", """
  SELECT row_number() OVER (ORDER BY row_id) AS record_id, job_title, company,
    'Not Available' AS job_id, CAST(NULL AS DOUBLE) AS salary_min, 'INR' AS currency, false AS remote_flag,
    false AS is_metro, 'India' AS country, 0.0e0 AS company_rating, 0 AS mother_suitability_score, '2026-03-04' AS processing_date,
    'Not Available' AS industry FROM postings""")
def _(t):
    final = final_schema(dense_ids(t.postings.select("row_id", "job_title", "company"), "row_id", "record_id"))
    return final.select("record_id", "job_title", "company", "job_id", "salary_min", "currency", "remote_flag", "is_metro",
                        "country", "company_rating", "mother_suitability_score", "processing_date", "industry")


@query("pr6_priority_order", "SELECT job_title, company, location, row_id, salary_text FROM postings")
def _(t):
    return naming.priority_order(t.postings.select("row_id", "location", "salary_text", "company", "job_title"))


@query("pr7_dense_id", "SELECT row_number() OVER (ORDER BY row_id) AS record_id, row_id FROM posting_copies")
def _(t):
    return dense_ids(t.posting_copies.select("row_id"), "row_id", "record_id")


@query("pr8_lineage", """
  SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'featured_postings.csv' WHEN row_id % 3 = 1 THEN 'Glassdoor_jobs.csv' ELSE 'eda_data.csv' END AS source_file,
    CASE WHEN row_id % 3 = 0 THEN 'Job Postings' WHEN row_id % 3 = 1 THEN 'Glassdoor' ELSE 'EDA Dataset' END AS data_source,
    '2026-03-04' AS processing_date FROM postings""")
def _(t):
    # Three raw exports, read back as one folder; where a row comes from is what the reader says.
    folder = scratch_path(t.spark, "lineage")
    for k, name in enumerate(["featured_postings.csv", "Glassdoor_jobs.csv", "eda_data.csv"]):
        files.write_csv(t.postings.filter(F.col("row_id") % 3 == k).select("row_id"), f"{folder}/{name}")
    rows = t.spark.read.options(**files.CSV, recursiveFileLookup=True).schema("row_id BIGINT").csv(folder)
    return naming.with_lineage(rows, naming.table_file(F.col("_metadata.file_path")))


@query("pr9_row_text", """
  SELECT company_id, CAST(company_id AS VARCHAR) || ' | ' || name || ' | ' || coalesce(company_size, '') || ' | ' || coalesce(state, '') AS row_text FROM companies""")
def _(t):
    return t.companies.select("company_id", tx.row_text(["company_id", "name", "company_size", "state"]).alias("row_text"))


@query("pr10_drop_target_columns", "SELECT profile_id, age, kids, domain FROM profiles")
def _(t):
    some = t.profiles.select("profile_id", "age", "kids", "domain", "mother_suitability_score", "career_growth")
    return some.drop("mother_suitability_score", "career_growth")


# --- filters -------------------------------------------------------------------
@query("fi1_country_equality", "SELECT company_id, name, country FROM companies WHERE upper(country) = 'IN'")
def _(t):
    return t.companies.filter(F.upper("country") == "IN").select("company_id", "name", "country")


@query("fi2_country_and_series", """
  SELECT stat_id, series_code FROM gender_stats WHERE country_code = 'IND' AND strpos(series_code, 'FE') > 0""")
def _(t):
    return t.gender_stats.filter((F.col("country_code") == "IND") & F.col("series_code").contains("FE")).select("stat_id", "series_code")


@query("fi3_critical_not_null", """
  SELECT 'clean' AS phase, row_id FROM postings WHERE job_title IS NOT NULL AND company IS NOT NULL
  UNION ALL SELECT 'missing', row_id FROM postings WHERE job_title IS NOT NULL AND company IS NOT NULL AND location IS NOT NULL""")
def _(t):
    # The cleaning phase asks for two columns, the missing-data phase for all critical ones that the table has.
    phases = {"clean": lexicon.CRITICAL_COLUMNS, "missing": lexicon.IMPUTE_CRITICAL}
    parts = [cleaning.drop_missing(t.postings, columns).select(F.lit(phase).alias("phase"), "row_id") for phase, columns in phases.items()]
    return parts[0].unionByName(parts[1])


@query("fi5_active_jobs", "SELECT id, org_id, title FROM organization_jobs WHERE is_active")
def _(t):
    return t.organization_jobs.filter("is_active").select("id", "org_id", "title")


@query("fi7_minimum_support", """
  SELECT row_id, job_title FROM (SELECT row_id, job_title, count(*) OVER (PARTITION BY job_title) AS n FROM postings
    WHERE job_title IS NOT NULL) WHERE n >= 5""")
def _(t):
    rows = t.postings.filter(F.col("job_title").isNotNull()).select("row_id", "job_title")
    # Counting first keeps a hot title from being gathered into one window partition.
    rare = rows.groupBy("job_title").count().filter("count < 5").select("job_title")
    return rows.join(rare, "job_title", "left_anti").select("row_id", "job_title")


@query("fi9_filled_test", """
  SELECT profile_id, education IS NOT NULL AND trim(education) NOT IN ('', 'nan', 'None', 'null', 'Unknown') AS education_filled,
    language IS NOT NULL AND trim(language) NOT IN ('', 'nan', 'None', 'null', 'Unknown') AS language_filled,
    hours_available IS NOT NULL AS hours_filled FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", F.expr(is_filled("education")).alias("education_filled"),
                             F.expr(is_filled("language")).alias("language_filled"),
                             F.expr(is_filled("hours_available", is_text=False)).alias("hours_filled"))
