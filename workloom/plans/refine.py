"""Cleaning, extraction, classification and missing data."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions import pay, tenure
from workloom.functions import text as tx
from workloom.operators import cleaning, postings
from workloom.operators.ranking import first_per_key
from workloom.plans import sqlparts as s
from workloom.plans.registry import check_view, query

check_view("clean_postings", f"""
  SELECT row_id, company_id, {s.clean_title('job_title')} AS job_title, {s.clean_company('company')} AS company,
    {s.clean_location('location')} AS location, salary_text, nullif({s.clean_text('job_description')}, '') AS job_description, views
  FROM postings""")
check_view("priced_postings", f"""
  SELECT *, (salary_min + salary_max) / 2 AS salary_avg FROM (SELECT *, {s.salary_bound('salary_text', 1)} AS salary_min,
    {s.salary_bound('salary_text', 2)} AS salary_max, CASE WHEN {s.salary_bound('salary_text', 1)} IS NULL THEN 'INR' ELSE {s.currency('salary_text')} END AS currency
  FROM clean_postings)""")
_BLOB = "lower(concat_ws(' ', {}))"
_LEVEL = s.experience_level("job_description_experience_min", "job_description_experience_max")
check_view("enriched_postings", f"""
  SELECT *, {s.bands('salary_avg', lexicon.SALARY_CATEGORIES, lexicon.SALARY_CATEGORY_TOP).replace('CASE', "CASE WHEN salary_avg IS NULL THEN 'Not Disclosed'", 1)} AS salary_category,
    {_LEVEL} AS experience_category, 'postings' AS source_file, 'Job Postings' AS data_source, '2026-03-04' AS processing_date
  FROM (SELECT *,
      coalesce({s.experience_bound('job_description', 1)}, {s.title_bound('job_title', 1)}) AS job_description_experience_min,
      coalesce({s.experience_bound('job_description', 2)}, {s.title_bound('job_title', 2)}) AS job_description_experience_max
    FROM priced_postings)""")
_TITLE = "lower(coalesce(job_title, ''))"
_SUB = "CASE " + " ".join(
    f"WHEN {s.has_any(_TITLE, words)} THEN " + "CASE " + " ".join(
        f"WHEN strpos({_TITLE}, {s.q(w)}) > 0 THEN {s.title_case(s.q(w))}" for w in words) + " END"
    for words in lexicon.JOB_CATEGORIES.values()) + " ELSE 'General' END"
_PLACE = "lower(coalesce(location, ''))"
check_view("featured_postings", f"""
  SELECT *, CASE WHEN is_competitive IS NULL THEN false ELSE is_competitive END AS is_competitive_salary,
    least((CASE WHEN remote_flag THEN 3 ELSE 0 END) + (CASE WHEN flexible_hours THEN 2 ELSE 0 END)
      + (CASE WHEN part_time_available THEN 2 ELSE 0 END) + (CASE WHEN female_friendly THEN 1 ELSE 0 END)
      + (CASE WHEN job_category IN ('Education', 'Healthcare', 'Customer Service') THEN 1 ELSE 0 END), 10) AS mother_suitability_score
  FROM (SELECT *, {s.has_any('late_blob', lexicon.FRIENDLY_WORDS)} AS female_friendly,
      {s.has_any('late_blob', lexicon.FLEXIBLE_WORDS)} AS flexible_hours,
      {s.has_any('late_blob', lexicon.PART_TIME_WORDS)} AS part_time_available,
      salary_avg > (SELECT median(salary_avg) FROM enriched_postings) AS is_competitive
    FROM (SELECT *, lower(concat_ws(' ', early_blob, work_arrangement, job_category, job_subcategory, seniority_level, city_tier, salary_bracket)) AS late_blob
      FROM (SELECT *, {s.has_any('early_blob', lexicon.REMOTE_WORDS)} AS remote_flag,
          CASE WHEN {s.has_any('early_blob', lexicon.REMOTE_WORDS)} THEN 'Remote' WHEN {s.has_any('early_blob', lexicon.HYBRID_WORDS)} THEN 'Hybrid' ELSE 'On-site' END AS work_arrangement,
          {s.first_match(_TITLE, lexicon.JOB_CATEGORIES, 'Other')} AS job_category, {_SUB} AS job_subcategory,
          {s.first_match(_TITLE, lexicon.SENIORITY_WORDS, 'Mid-Level')} AS seniority_level,
          CASE WHEN {s.has_any(_PLACE, lexicon.METRO_CITIES)} THEN 'Metro' WHEN {s.has_any(_PLACE, lexicon.TIER1_CITIES)} THEN 'Tier-1'
            WHEN {s.has_any(_PLACE, lexicon.TIER2_CITIES)} THEN 'Tier-2' WHEN {s.has_any(_PLACE, lexicon.COUNTRY_WORDS)} THEN 'Other India' ELSE 'Unknown' END AS city_tier,
          {s.has_any(_PLACE, lexicon.METRO_CITIES)} AS is_metro,
          {s.has_any(_PLACE, lexicon.METRO_CITIES + lexicon.TIER1_CITIES + lexicon.TIER2_CITIES + lexicon.COUNTRY_WORDS)} AS is_india,
          CASE WHEN salary_avg IS NULL THEN 'Not Disclosed' ELSE {s.bands('salary_avg / 100000', lexicon.LAKH_BRACKETS, lexicon.LAKH_BRACKET_TOP)} END AS salary_bracket
        FROM (SELECT *, {_BLOB.format('job_title, company, location, salary_text, job_description, currency, salary_category, ' + _LEVEL + ', experience_category, source_file, data_source, processing_date')} AS early_blob
          FROM enriched_postings))))""")


@query("flagship_pay_and_suitability", """
  SELECT job_category, salary_bracket, count(*) AS postings, round(median(salary_avg), 2) AS median_salary,
    round(avg(mother_suitability_score), 4) AS mean_score
  FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company, location ORDER BY row_id) AS rn FROM featured_postings)
  WHERE rn = 1 GROUP BY job_category, salary_bracket""")
def _(t):
    rows = first_per_key(postings.featured(t.postings.drop("posted_at")), ["job_title", "company", "location"], ["row_id"])
    keys = ["job_category", "salary_bracket"]
    # Equal salaries meet first, so the median of a large group is taken from a histogram.
    counts = rows.groupBy(*keys, "salary_avg").agg(F.count(F.lit(1)).alias("n"), F.sum("mother_suitability_score").alias("score"),
                                                   F.count("mother_suitability_score").alias("scored"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("postings"), F.round(F.percentile("salary_avg", 0.5, F.col("n")), 2).alias("median_salary"),
        F.round(F.sum("score") / F.sum("scored"), 4).alias("mean_score"))


# --- cleaning ------------------------------------------------------------------
@query("cl1_text_clean", f"SELECT doc_id, {s.clean_text('text')} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query("cl2_job_title", "SELECT row_id, job_title FROM clean_postings")
def _(t):
    return t.postings.select("row_id", tx.clean_title(F.col("job_title")).alias("job_title"))


@query("cl3_company", "SELECT row_id, company FROM clean_postings")
def _(t):
    return t.postings.select("row_id", tx.clean_company(F.col("company")).alias("company"))


@query("cl4_location", "SELECT row_id, location FROM clean_postings")
def _(t):
    return t.postings.select("row_id", tx.clean_location(F.col("location")).alias("location"))


@query("cl5_skill_names", f"""
  SELECT profile_id, array_to_string(list_transform(string_split(all_skills, ','),
    lambda e: {s.lookup(s.title_case('trim(e)'), lexicon.SKILL_BRANDS, 'KEEP').replace("'KEEP'", s.title_case('trim(e)').replace('lambda r', 'lambda z').replace('r[', 'z['))}), ', ') AS skills FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", tx.clean_skills(F.col("all_skills")).alias("skills"))


@query("cl6_cleaning_plan", f"""
  SELECT company_id, {s.clean_company('name')} AS name, {s.clean_location('city')} AS city, {s.clean_location('state')} AS state, country FROM companies""")
def _(t):
    return cleaning.clean_table(t.companies.select("company_id", "name", "city", "state", "country"), "companies_india.csv company")


_SPARSE = "CASE WHEN row_id % 10 = 0 THEN row_id ELSE NULL END"


@query("cl7_smart_nulls", """
  SELECT row_id, job_title, company, coalesce(location, 'Unknown') AS location, coalesce(salary_text, 'Not Disclosed') AS salary_text,
    job_description, coalesce(CAST(views AS DOUBLE), (SELECT median(views) FROM postings WHERE job_title IS NOT NULL AND company IS NOT NULL)) AS views
  FROM postings WHERE job_title IS NOT NULL AND company IS NOT NULL""")
def _(t):
    rows = t.postings.select("row_id", "job_title", "company", "location", "salary_text", "job_description", "views",
                             F.when(F.col("row_id") % 10 == 0, F.col("row_id")).alias("fax"))
    return cleaning.smart_null_policy(rows)


def _null_sql(columns, template):
    return " UNION ALL ".join(template.replace("$c", c) for c in columns)


_ANALYSED = {"row_id": "FILL_MEDIAN", "job_title": "", "company": "", "location": "", "salary_text": "FILL_MODE", "views": "FILL_MEDIAN"}


@query("cl8_missing_analysis", " UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count,
    round(100.0e0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_pct, count(DISTINCT {c}) AS distinct_values,
    CASE WHEN 100.0e0 * count(*) FILTER ({c} IS NULL) / count(*) >= 80 THEN 'DROP' WHEN '{c}' IN ('job_title', 'company', 'company_name', 'location', 'job_category', 'seniority_level') THEN 'DROP_ROWS'
      WHEN count(*) FILTER ({c} IS NULL) = 0 THEN 'NONE' ELSE '{a}' END AS action FROM postings""" for c, a in _ANALYSED.items()))
def _(t):
    return cleaning.recommended_action(t.postings.select(*_ANALYSED))


@query("cl9_sparse_columns", "SELECT row_id, job_title, location FROM postings")
def _(t):
    rows = t.postings.select("row_id", "job_title", "location",
                             F.when(F.col("row_id") % 10 < 2, F.lit("x")).alias("rarely_set"))
    return cleaning.drop_sparse_columns(rows)


_IMP = """CASE WHEN row_id % 7 = 2 THEN NULL ELSE {} END"""


@query("cl10_imputation", f"""
  WITH gaps AS (SELECT row_id, {_IMP.format('city_tier')} AS city_tier, {_IMP.format('location')} AS location,
      {_IMP.format('remote_flag')} AS remote_flag, salary_min, views AS views, company AS company FROM featured_postings)
  SELECT row_id,
    coalesce(city_tier, (SELECT city_tier FROM gaps WHERE city_tier IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, city_tier LIMIT 1)) AS city_tier,
    coalesce(location, 'Unknown Location') AS location, coalesce(remote_flag, false) AS remote_flag,
    coalesce(salary_min, (SELECT median(salary_min) FROM gaps)) AS salary_min, coalesce(views, 0) AS views, coalesce(company, 'Not Available') AS company
  FROM gaps""")
def _(t):
    rows = postings.featured(t.postings.drop("posted_at"))
    keep = F.col("row_id") % 7 != 2
    gaps = rows.select("row_id", *[F.when(keep, F.col(c)).alias(c) for c in ("city_tier", "location", "remote_flag")],
                       "salary_min", "views", "company")
    return cleaning.impute(gaps)


@query("cl11_completeness", """
  SELECT count(*) * 4 AS cells, count(row_id) + count(job_title) + count(company) + count(location) AS filled_cells,
    round(100.0e0 * (count(row_id) + count(job_title) + count(company) + count(location)) / (count(*) * 4), 6) AS completeness_pct FROM postings""")
def _(t):
    return cleaning.completeness(t.postings.select("row_id", "job_title", "company", "location"))


check_view("profile_medians", """SELECT median(hours_available) AS hours, median(income) AS income FROM profiles""")
check_view("clean_profiles", f"""
  SELECT profile_id, CAST(age AS DOUBLE) AS age, CAST(kids AS DOUBLE) AS kids,
    coalesce(CAST(hours_available AS DOUBLE), (SELECT hours FROM profile_medians)) AS hours_available,
    CAST(experience_years AS DOUBLE) AS experience_years, coalesce(income, (SELECT income FROM profile_medians)) AS income,
    salary_min, salary_max, mother_suitability_score, skill_match_score, work_life_balance,
    domain, sector, primary_skill, coalesce(secondary_skill, 'Unknown') AS secondary_skill, coalesce(education, 'Unknown') AS education,
    coalesce(city, 'Unknown') AS city, city_tier, work_mode, work_type, seniority_level, marital_status, shift_type,
    coalesce(career_growth, 'Unknown') AS career_growth, travel_required, coalesce(language, 'Unknown') AS language, coalesce(device, 'Unknown') AS device,
    {', '.join(f'CAST({c} AS INT) AS {c}' for c in ['remote_available', 'flexible_timing', 'childcare_compatible', 'women_friendly', 'maternity_benefits', 'training_provided', 'health_insurance', 'pf_available', 'is_verified'])},
    coalesce(all_skills, '') AS all_skills, job_title, company FROM profiles""")


@query("cl12_training_nulls", """
  SELECT profile_id, age, hours_available, income, education, career_growth, remote_available, all_skills FROM clean_profiles""")
def _(t):
    from workloom.features.profiles import clean_profiles
    return clean_profiles(t.profiles).select("profile_id", "age", "hours_available", "income", "education", "career_growth",
                                             "remote_available", "all_skills")


# --- extraction ----------------------------------------------------------------
@query("ex1_currency", f"SELECT row_id, {s.currency('salary_text')} AS currency FROM postings")
def _(t):
    low = t.postings.select("row_id", F.lower("salary_text").alias("low"))
    return low.select("row_id", F.expr(pay.currency("low")).alias("currency"))


@query("ex2_salary_parse", f"""
  SELECT row_id, {s.salary_bound('salary_text', 1)} AS lo, {s.salary_bound('salary_text', 2)} AS hi FROM postings""")
def _(t):
    out = pay.with_salary_columns(t.postings.select("row_id", "salary_text"))
    return out.select("row_id", F.col("salary_text_min").alias("lo"), F.col("salary_text_max").alias("hi"))


@query("ex3_salary_columns", f"""
  SELECT row_id, salary_text, wage_note, {s.salary_bound('salary_text', 1)} AS salary_text_min, {s.salary_bound('salary_text', 2)} AS salary_text_max,
    CASE WHEN {s.salary_bound('salary_text', 1)} IS NULL THEN 'INR' ELSE {s.currency('salary_text')} END AS salary_text_currency,
    CAST(row_id % 90 + 10 AS DOUBLE) * 2080 * 83.0e0 AS wage_note_min, CAST(row_id % 90 + 10 AS DOUBLE) * 2080 * 83.0e0 AS wage_note_max, 'USD' AS wage_note_currency
  FROM (SELECT row_id, salary_text, CAST(row_id % 90 + 10 AS VARCHAR) || '/hour usd' AS wage_note FROM postings)""")
def _(t):
    rows = t.postings.select("row_id", "salary_text", F.concat((F.col("row_id") % 90 + 10).cast("string"), F.lit("/hour usd")).alias("wage_note"))
    return pay.with_salary_columns(rows)


@query("ex4_average_and_category", """
  SELECT row_id, salary_avg, salary_category FROM enriched_postings""")
def _(t):
    return postings.priced(t.postings.select("row_id", "salary_text")).select("row_id", "salary_avg", "salary_category")


@query("ex5_experience_parse", f"""
  SELECT row_id, {s.experience_bound('job_description', 1)} AS lo, {s.experience_bound('job_description', 2)} AS hi FROM postings""")
def _(t):
    out = tenure.with_experience_columns(t.postings.select("row_id", "job_description"), ["job_description"])
    return out.select("row_id", F.col("job_description_experience_min").alias("lo"), F.col("job_description_experience_max").alias("hi"))


@query("ex6_experience_from_title", f"""
  SELECT row_id, coalesce({s.experience_bound('job_description', 1)}, {s.title_bound('job_title', 1)}) AS lo,
    coalesce({s.experience_bound('job_description', 2)}, {s.title_bound('job_title', 2)}) AS hi FROM postings""")
def _(t):
    out = tenure.with_experience_columns(t.postings.select("row_id", "job_title", "job_description"), ["job_description"], "job_title")
    return out.select("row_id", F.col("required_experience_min").alias("lo"), F.col("required_experience_max").alias("hi"))


@query("ex7_experience_level", "SELECT row_id, experience_category FROM enriched_postings")
def _(t):
    rows = postings.cleaned(t.postings.select("row_id", "job_title", "job_description"))
    return tenure.with_experience_columns(rows, ["job_description"], "job_title").select("row_id", "experience_category")


_LO = [s.experience_bound("job_description", 1), s.experience_bound("note", 1)]
_HI = [s.experience_bound("job_description", 2), s.experience_bound("note", 2)]


@query("ex8_experience_summary", f"""
  SELECT row_id, required_experience_min, required_experience_max, {s.experience_level('required_experience_min', 'required_experience_max')} AS experience_category
  FROM (SELECT row_id, least({_LO[0]}, {_LO[1]}) AS required_experience_min, greatest({_HI[0]}, {_HI[1]}) AS required_experience_max
    FROM (SELECT row_id, job_description, CAST(row_id % 6 AS VARCHAR) || '+ years' AS note FROM postings))""")
def _(t):
    rows = t.postings.select("row_id", "job_description", F.concat((F.col("row_id") % 6).cast("string"), F.lit("+ years")).alias("note"))
    return tenure.with_experience_columns(rows, ["job_description", "note"]).select(
        "row_id", "required_experience_min", "required_experience_max", "experience_category")


_MAIL = "CASE WHEN email IS NULL OR email = '' THEN 'Email is required' WHEN NOT regexp_matches(lower(trim(email)), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN 'Invalid email format' WHEN length(trim(email)) > 254 THEN 'Email is too long' END"
_PHONE = "CASE WHEN phone IS NULL OR phone = '' THEN 'Phone number is required' WHEN NOT regexp_matches(regexp_replace(phone, '[\\s\\-]', '', 'g'), '^(?:\\+91|91|0)?[6-9]\\d{9}$') THEN 'Invalid phone number. Please enter a valid 10-digit Indian mobile number' END"
_NAME = "CASE WHEN name IS NULL OR name = '' THEN 'Name is required' WHEN length(trim(name)) < 2 THEN 'Name must be at least 2 characters long' WHEN length(trim(name)) > 100 THEN 'Name is too long' WHEN NOT regexp_matches(trim(name), '^[a-zA-Z\\s\\.''-]+$') THEN 'Name contains invalid characters' END"


@query("ex9_contact_rules", f"""
  SELECT field, reason, count(*) AS n FROM (SELECT 'email' AS field, {_MAIL} AS reason FROM contacts UNION ALL
    SELECT 'phone', {_PHONE} FROM contacts UNION ALL SELECT 'name', {_NAME} FROM contacts) GROUP BY field, reason""")
def _(t):
    issues = t.contacts.select(tx.email_issue(F.col("email")).alias("email"), tx.phone_issue(F.col("phone")).alias("phone"),
                               tx.name_issue(F.col("name")).alias("name"))
    return issues.unpivot([], ["email", "phone", "name"], "field", "reason").groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("ex10_escape_markup", """
  SELECT contact_id, replace(replace(replace(replace(trim(name), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe_name FROM contacts""")
def _(t):
    return t.contacts.select("contact_id", tx.escape_markup(F.col("name")).alias("safe_name"))


@query("ex11_skill_lists", f"""
  SELECT profile_id, {s.skills_count('all_skills')} AS skills_count, CASE WHEN all_skills IS NULL THEN 0.0e0 ELSE
    round(len(list_distinct(string_split(lower(all_skills), ','))) / greatest(len(string_split(all_skills, ',')), 1), 6) END AS skill_diversity FROM profiles""".replace(
        "len(list_distinct", "CAST(len(list_distinct").replace("lower(all_skills), ','))) /", "lower(all_skills), ','))) AS DOUBLE) /").replace(
        f"{s.skills_count('all_skills')} AS", f"CAST({s.skills_count('all_skills')} AS INT) AS"))
def _(t):
    skills = F.col("all_skills")
    return t.profiles.select("profile_id", tx.skills_count(skills).alias("skills_count"),
                             F.round(tx.skill_diversity(skills), 6).alias("skill_diversity"))


@query("ex12_pretty_label", """
  SELECT profile_id, domain || ' - ' || CASE profile_id % 4 WHEN 0 THEN 'Entry Level' WHEN 1 THEN 'Mid Level' WHEN 2 THEN 'Senior Level' ELSE 'Chief' END AS label FROM profiles""")
def _(t):
    level = F.element_at(F.array(*[F.lit(x) for x in ["Entry", "Mid", "Senior", "Chief"]]), (F.col("profile_id") % 4 + 1).cast("int"))
    raw = F.concat_ws("_", F.replace("domain", F.lit(" "), F.lit("_")), level)
    return t.profiles.select("profile_id", tx.pretty_label(raw).alias("label"))


@query("ex13_salary_text", """
  SELECT profile_id, '₹' || format('{:,}', CAST(salary_min AS BIGINT)) || ' - ₹' || format('{:,}', CAST(salary_max AS BIGINT)) AS salary FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", tx.rupee_range(F.col("salary_min"), F.col("salary_max")).alias("salary"))


# --- classification ------------------------------------------------------------
def _featured(t):
    return postings.featured(t.postings.drop("posted_at"))


@query("cr1_work_arrangement", "SELECT row_id, remote_flag, work_arrangement FROM featured_postings")
def _(t):
    return _featured(t).select("row_id", "remote_flag", "work_arrangement")


@query("cr2_job_category", "SELECT row_id, job_category, job_subcategory FROM featured_postings")
def _(t):
    return postings.with_category(postings.cleaned(t.postings.select("row_id", "job_title"))).select("row_id", "job_category", "job_subcategory")


@query("cr3_seniority", "SELECT row_id, seniority_level, seniority_level IN ('Management', 'Executive') AS leadership_role FROM featured_postings")
def _(t):
    return postings.with_seniority(postings.cleaned(t.postings.select("row_id", "job_title"))).select("row_id", "seniority_level", "leadership_role")


@query("cr4_place", "SELECT row_id, city_tier, is_metro, is_india FROM featured_postings")
def _(t):
    return postings.with_place(postings.cleaned(t.postings.select("row_id", "location"))).select("row_id", "city_tier", "is_metro", "is_india")


@query("cr5_pay_bracket", "SELECT row_id, salary_bracket, is_competitive_salary FROM featured_postings")
def _(t):
    priced = postings.priced(t.postings.select("row_id", "salary_text"))
    return postings.with_pay_bracket(priced, "salary_avg").select("row_id", "salary_bracket", "is_competitive_salary")


@query("cr6_friendly_flags", "SELECT row_id, female_friendly, flexible_hours, part_time_available FROM featured_postings")
def _(t):
    return _featured(t).select("row_id", "female_friendly", "flexible_hours", "part_time_available")


@query("cr7_suitability_score", "SELECT row_id, mother_suitability_score FROM featured_postings")
def _(t):
    return _featured(t).select("row_id", "mother_suitability_score")


_GEN = """SELECT row_id, {title} AS job_title, {city} AS location, 100000.0e0 + row_id % 1700 * 1000 AS salary_min, 150000.0e0 + row_id % 1900 * 1000 AS salary_max,
  CAST(row_id % 5 AS DOUBLE) AS required_experience_min, CAST(row_id % 5 + row_id % 9 AS DOUBLE) AS required_experience_max FROM postings"""


def _pick(values):
    from workloom.sources.catalog import pick
    return pick("row_id", values)


@query("cr8_generated_rules", f"""
  SELECT row_id, {s.first_match('lower(job_title)', lexicon.GENERATED_CATEGORIES, 'Other')} AS job_category,
    {s.first_match('lower(job_title)', lexicon.GENERATED_SENIORITY, 'Mid-Level')} AS seniority_level,
    {s.bands('((salary_min + salary_max) / 2 / 100000)', lexicon.GENERATED_SALARY_BANDS, '15+ LPA')} AS salary_bracket,
    {s.bands('((required_experience_min + required_experience_max) / 2)', lexicon.GENERATED_EXPERIENCE_BANDS, 'Senior Level', '<=')} AS experience_category,
    CASE WHEN location IN ('Mumbai', 'Delhi', 'Bangalore', 'Hyderabad', 'Chennai', 'Kolkata') THEN 'Tier-1' WHEN location IN ('Pune', 'Ahmedabad', 'Jaipur', 'Surat') THEN 'Tier-2' ELSE 'Tier-3' END AS city_tier,
    {s.lookup('location', lexicon.CITY_STATES, 'Unknown')} AS state, {s.first_match('job_title', lexicon.GENERATED_INDUSTRIES, 'General Services')} AS industry,
    {s.lookup('job_title', lexicon.TITLE_SKILLS, lexicon.DEFAULT_TITLE_SKILLS)} AS required_skills
  FROM ({_GEN.format(title=_pick(lexicon.GENERATOR_TITLES), city=_pick(lexicon.GENERATOR_CITIES + ['Patna']))})""")
def _(t):
    rows = t.spark.sql(_GEN.format(title=_pick(lexicon.GENERATOR_TITLES), city=_pick(lexicon.GENERATOR_CITIES + ["Patna"])).replace("FROM postings", "FROM {postings}"),
                       postings=t.postings)
    return postings.generated_features(rows).select("row_id", "job_category", "seniority_level", "salary_bracket", "experience_category",
                                                    "city_tier", "state", "industry", "required_skills")
