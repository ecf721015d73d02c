"""Joins, unions and duplicate removal."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions.rules import lookup
from workloom.operators import dedupe, merging, postings, skills
from workloom.operators.brackets import bracket_join
from workloom.operators.selection import grouped_quantiles
from workloom.plans import sqlparts as s
from workloom.plans.registry import check_view, query
from workloom.session import written


# --- joins ---------------------------------------------------------------------
@query("jo1_semi_join_satellites", """
  SELECT company_id, 'industry' AS kind, industry AS item FROM company_industries WHERE company_id IN (SELECT company_id FROM companies WHERE upper(country) = 'IN')
  UNION ALL SELECT company_id, 'speciality', speciality FROM company_specialities WHERE company_id IN (SELECT company_id FROM companies WHERE upper(country) = 'IN')
  UNION ALL SELECT company_id, 'employees', CAST(employee_count AS VARCHAR) FROM employee_counts WHERE company_id IN (SELECT company_id FROM companies WHERE upper(country) = 'IN')""")
def _(t):
    chosen = t.companies.filter(F.upper("country") == "IN").select("company_id")
    parts = [t.company_industries.select("company_id", F.lit("industry").alias("kind"), F.col("industry").alias("item")),
             t.company_specialities.select("company_id", F.lit("speciality").alias("kind"), F.col("speciality").alias("item")),
             t.employee_counts.select("company_id", F.lit("employees").alias("kind"), F.col("employee_count").cast("string").alias("item"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(chosen, "company_id", "left_semi")


@query("jo2_company_enrichment", """
  SELECT p.row_id, p.company, p.location, c.location AS company_location, c.company_size
  FROM (SELECT row_id, company, location FROM clean_postings) p
  LEFT JOIN (SELECT CASE WHEN company_id % 50 = 0 THEN NULL ELSE name || ' PVT. LTD' END AS company, city AS location, company_size FROM companies) c
    ON p.company IS NOT DISTINCT FROM c.company""")
def _(t):
    jobs = postings.cleaned(t.postings.select("row_id", "company", "location"))
    companies = t.companies.select(
        F.when(F.col("company_id") % 50 != 0, F.concat("name", F.lit(" PVT. LTD"))).alias("company"),
        F.col("city").alias("location"), "company_size")
    return merging.enrich_with_companies(jobs, companies)


@query("jo5_map_lookup", f"""
  SELECT profile_id, {s.lookup('city_tier', lexicon.TIER_ORDINAL, 1)} AS city_tier_num, {s.lookup('education', lexicon.EDUCATION_ORDINAL, 3)} AS education_num,
    {s.lookup('seniority_level', lexicon.SENIORITY_ORDINAL, 1)} AS seniority_num FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", F.expr(lookup("city_tier", lexicon.TIER_ORDINAL, 1)).alias("city_tier_num"),
                             F.expr(lookup("education", lexicon.EDUCATION_ORDINAL, 3)).alias("education_num"),
                             F.expr(lookup("seniority_level", lexicon.SENIORITY_ORDINAL, 1)).alias("seniority_num"))


_BRACKETS = "CASE " + " ".join(f"WHEN income >= {a}" + (f" AND income < {b}" if b else "") + f" THEN '{n}'" for a, b, n in lexicon.INCOME_BRACKETS) + " ELSE 'Unknown' END"


@query("jo6_bracket_range", f"SELECT profile_id, {_BRACKETS} AS bracket FROM profiles")
def _(t):
    table = t.spark.createDataFrame([(float(a), None if b is None else float(b), n) for a, b, n in lexicon.INCOME_BRACKETS], "low double, high double, bracket string")
    found = bracket_join(t.profiles.select("profile_id", "income"), table, "income")
    return found.select("profile_id", F.coalesce("bracket", F.lit("Unknown")).alias("bracket"))


@query("jo6_quintile_brackets", """
  WITH e AS (SELECT domain, quantile_cont(income, [0, 0.25, 0.5, 0.75, 1]) AS q FROM profiles WHERE income IS NOT NULL GROUP BY domain),
  b AS (SELECT domain, i::INTEGER AS place, q[i] AS low, CASE WHEN i < 4 THEN q[i + 1] END AS high FROM e, (SELECT unnest(range(1, 5)) AS i))
  SELECT p.profile_id, count(b.place)::BIGINT AS brackets, coalesce(sum(b.place), 0)::BIGINT AS places FROM profiles p LEFT JOIN b ON p.income >= b.low AND (b.high IS NULL OR p.income < b.high) GROUP BY p.profile_id""")
def _(t):
    """Every income against the quarters of all domains: a table of brackets that overlap, made from the data."""
    quarters = grouped_quantiles(t.profiles.select("domain", "income"), ["domain"], "income", [0.0, 0.25, 0.5, 0.75, 1.0])
    edges = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(i.alias("place"), F.col("q")[i - 1].alias("low"), F.when(i < 4, F.col("q")[i]).alias("high"))))
    table = written(quarters.select(edges.alias("e")).select("e.*"), "quarters")
    found = bracket_join(t.profiles.select("profile_id", "income"), table, "income")
    return found.groupBy("profile_id").agg(F.count("place").alias("brackets"), F.coalesce(F.sum("place"), F.lit(0)).cast("long").alias("places"))


@query("jo7_user_profiles", "SELECT u.user_id, u.name, p.preferred_domain FROM users u LEFT JOIN user_profiles p ON u.user_id = p.user_id")
def _(t):
    return t.users.join(t.user_profiles.select("user_id", "preferred_domain"), "user_id", "left").select("user_id", "name", "preferred_domain")


@query("jo8_organisation_applications", """
  SELECT a.id, a.job_id, a.status, j.org_id FROM job_applications a JOIN organization_jobs j ON a.job_id = j.id""")
def _(t):
    jobs = t.organization_jobs.select(F.col("id").alias("job_id"), "org_id")
    return t.job_applications.join(jobs, "job_id").select("id", "job_id", "status", "org_id")


@query("jo9_ownership", """
  SELECT a.id, o.company_name FROM job_applications a JOIN organization_jobs j ON a.job_id = j.id JOIN organizations o ON j.org_id = o.id""")
def _(t):
    jobs = t.organization_jobs.select(F.col("id").alias("job_id"), "org_id")
    orgs = t.organizations.select(F.col("id").alias("org_id"), "company_name")
    return t.job_applications.select("id", "job_id").join(jobs.join(orgs, "org_id"), "job_id").select("id", "company_name")


def _required(x):
    return "CASE " + x + " " + " ".join(f"WHEN '{d}' THEN [{', '.join(s.q(k) for k in ks)}]" for d, ks in lexicon.DOMAIN_SKILLS.items()) + " ELSE CAST([] AS VARCHAR[]) END"


check_view("owned_skills", """SELECT profile_id, domain, list_filter(list_transform(string_split(lower(coalesce(all_skills, '')), ','), lambda x: trim(x)), lambda x: x <> '') AS owned FROM profiles""")
check_view("skill_gaps", f"""SELECT profile_id, domain, owned, required, list_filter(required, lambda x: NOT list_contains(owned, x)) AS missing
  FROM (SELECT *, {_required('domain')} AS required FROM owned_skills)""")


@query("jo10_missing_skills", "SELECT profile_id, domain, array_to_string(missing, '|') AS missing FROM skill_gaps")
def _(t):
    return skills.missing_skills(t.profiles).select("profile_id", "domain", F.array_join("missing", "|").alias("missing"))


_NEEDS = "CASE skill " + " ".join(f"WHEN '{k}' THEN [{', '.join(s.q(x) for x in v)}]" for k, v in lexicon.PREREQUISITES.items()) + " END"


@query("jo11_prerequisites", f"""
  SELECT DISTINCT profile_id, prerequisite FROM (SELECT profile_id, owned, unnest({_NEEDS}) AS prerequisite FROM (SELECT profile_id, owned, unnest(missing) AS skill FROM skill_gaps))
  WHERE NOT list_contains(owned, prerequisite)""")
def _(t):
    return skills.missing_prerequisites(t.profiles)


_ALL_DOMAINS = "|".join(sorted({d for ds in lexicon.SECTOR_DOMAINS.values() for d in ds}))


@query("jo12_navigation", f"""
  SELECT profile_id, {s.lookup('sector', {k: '|'.join(v) for k, v in lexicon.SECTOR_DOMAINS.items()}, _ALL_DOMAINS)} AS domains,
    {s.lookup('domain', {k: '|'.join(v) for k, v in lexicon.DOMAIN_TRAINING_SKILLS.items()}, '|'.join(lexicon.DOMAIN_TRAINING_SKILLS['General']))} AS skills FROM profiles""")
def _(t):
    return skills.navigation(t.profiles).select("profile_id", F.array_join("domains", "|").alias("domains"), F.array_join("skills", "|").alias("skills"))


# --- unions --------------------------------------------------------------------
@query("se1_aligned_union", """
  SELECT row_id, job_title, company, location, 'Not Specified' AS description, CAST(NULL AS DOUBLE) AS salary_min, views > 500 AS remote_flag, 'Not Specified' AS job_description, 'Not Specified' AS title FROM postings
  UNION ALL SELECT row_id, title, employer, 'Not Specified', 'Not Specified', minsalary, false, 'from salary table', 'Not Specified' FROM salary_rows""")
def _(t):
    first = t.postings.select("row_id", "job_title", "company", "location", (F.col("views") > 500).alias("remote_flag"))
    second = t.salary_rows.select("row_id", F.col("title"), F.col("employer").alias("company"),
                                  F.lit("from salary table").alias("description"), F.col("minsalary").alias("salary_min"))
    return merging.aligned_union([first, second])


@query("se2_union_with_provenance", """
  SELECT row_id, job_title, location, CAST(NULL AS DOUBLE) AS minsalary, 'postings' AS original_dataset, false AS is_synthetic FROM postings
  UNION ALL SELECT row_id, title, NULL, minsalary, 'salary', false FROM salary_rows""")
def _(t):
    return merging.union_validated({"postings": t.postings.select("row_id", "job_title", "location"),
                                    "salary": t.salary_rows.select("row_id", F.col("title").alias("job_title"), "minsalary")})


@query("se3_union_distinct", """
  SELECT row_id, job_title FROM postings WHERE row_id % 3 = 0 UNION SELECT row_id, job_title FROM postings WHERE row_id % 5 = 0""")
def _(t):
    rows = t.postings.select("row_id", "job_title")
    return rows.filter("row_id % 3 = 0").unionByName(rows.filter("row_id % 5 = 0")).dropDuplicates()


@query("se4_real_and_generated", """
  WITH n AS (SELECT (SELECT count(*) FROM postings) AS a, (SELECT count(*) FROM profiles) AS b)
  SELECT false AS is_synthetic, a AS rows, 1 AS first_id, a AS last_id, a AS ids FROM n UNION ALL SELECT true, b, a + 1, a + b, b FROM n""")
def _(t):
    # The second table stands for rows that were made: profiles told as postings.
    real = postings.featured(t.postings.drop("posted_at"))
    made = t.profiles.select("profile_id", "job_title", "company", F.col("city").alias("location"), "salary_min", "salary_max", "seniority_level")
    master = merging.continued_union(real, made, "row_id", "profile_id")
    return master.groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("rows"), F.min("record_id").alias("first_id"),
                                              F.max("record_id").alias("last_id"), F.countDistinct("record_id").alias("ids"))


@query("se5_distinct_skills", """
  SELECT profile_id, len(list_distinct(owned)) AS distinct_skills FROM owned_skills""")
def _(t):
    from workloom.functions.text import skill_array
    return t.profiles.select("profile_id", F.size(F.array_distinct(skill_array(F.col("all_skills")))).cast("long").alias("distinct_skills"))


# --- duplicates ----------------------------------------------------------------
@query("dd1_same_rows", "SELECT DISTINCT job_title, company, location, salary_text FROM posting_copies")
def _(t):
    return dedupe.drop_same_rows(t.posting_copies.select("job_title", "company", "location", "salary_text"))


@query("dd2_same_keys", """
  SELECT row_id, job_title, company, location FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company, location ORDER BY row_id) AS rn FROM posting_copies) WHERE rn = 1""")
def _(t):
    return dedupe.drop_same_keys(t.posting_copies.select("row_id", "job_title", "company", "location"))


@query("dd3_fuzzy")
def _(t):
    return dedupe.fuzzy_survivors(t.posting_copies).select("row_id", "job_title", "company")


@query("dd4_pay_only", """
  SELECT row_id, salary_text FROM (SELECT *, row_number() OVER (PARTITION BY job_title, company, location, job_description
      ORDER BY CASE WHEN salary_text IS NULL THEN 0 ELSE 1 END DESC, row_id) AS rn FROM posting_copies
    WHERE job_title IS NOT NULL AND company IS NOT NULL AND location IS NOT NULL AND job_description IS NOT NULL) WHERE rn = 1""")
def _(t):
    return dedupe.drop_pay_duplicates(t.posting_copies, ["job_title", "company", "location", "job_description"], ["salary_text"]).select("row_id", "salary_text")


@query("dd5_removal_counts")
def _(t):
    return dedupe.deduplicate(t.posting_copies, ["salary_text"]).groupBy(
        "exact_duplicates_removed", "fuzzy_duplicates_removed", "salary_duplicates_removed").agg(F.count(F.lit(1)).alias("rows"))
