"""The given tables, and the labour-market tables derived from them.

Derived tables are plain SQL over the given ones: every value is a function of integer
keys, written so that any SQL engine reads it the same way. They stand in for the raw
inputs (postings, companies, profiles, user tables) and grow with the given tables.
"""

from string import Formatter

from workloom.session import spread_by_rows

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

WIDE = ("orders", "documents")

#: Rows of one task of the other tables. They are narrow, so that a file of a few MB holds a million rows, each of which
#: becomes a wide row of a derived table; below this a table stays as it is read.
ROWS_PER_TASK = 10_000
SPREAD_BY_ROWS = ("customer",)


#: What ``pick`` wrote, and the same value read out of an array. A table of many long ``CASE`` is one method that is too
#: long for the JVM to compile, so Spark gets the arrays.
ARRAYS = {}


def pick(key, values):
    """SQL: the value at position ``key % len(values)``; ``None`` gives null, as does a key that is null or negative."""
    texts = ["NULL" if v is None else f"'{v}'" for v in values]
    place = f"CAST(({key}) % {len(values)} AS INT)"
    sql = f"CASE {place} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(texts)) + " END"
    ARRAYS[sql] = f"get(array({', '.join(texts)}), {place})"
    return sql


def with_arrays(sql):
    """The same query for Spark, every ``pick`` as a place in an array."""
    for case, place in ARRAYS.items():
        sql = sql.replace(case, place)
    return sql


def div(key, n):
    """SQL: integer quotient of a non-negative key."""
    return f"CAST(floor(({key}) / {n}) AS BIGINT)"


def null_every(n, rest, key, expr):
    return f"CASE WHEN ({key}) % {n} = {rest} THEN NULL ELSE {expr} END"


RANKS = ["", "Sr. ", "Jr ", "junior ", "LEAD ", "senior ", "Asst "]
ROLES = ["software dev", "data analyst", "HR executive", "content writer", "Customer  Service Mgr",
         "graphic designer", "ui/ux designer", "Sales  Executive", "nurse (remote)", "online tutor",
         "Accountant", "ops coordinator", "it support eng", "marketing director", "project mgr",
         "ml engineer", "tax consultant", "call center agent", "Recruiter", "Tech Lead",
         "Translator", "chief of staff", "Warehouse @ Helper!"]
FIRST = ["Amber", "Birch", "Cedar", "Delta", "Ember", "Falcon", "Granite", "Harbour", "Indigo", "Jasmine",
         "Kestrel", "Lotus", "Marigold", "Nimbus", "Orchid", "Pearl", "Quartz", "Rivulet", "Saffron",
         "Teak", "Umbra", "Verdant", "Willow", "Xenon", "Yonder", "Zephyr", "Banyan", "Coral", "Dune",
         "Elm", "Fern"]
SECOND = ["Analytics", "Biotech", "Ceramics", "Dairy", "Exports", "Foods", "Garments", "Hospitality",
          "Infotech", "Jewels", "Kitchens", "Logistics", "Media", "Networks", "Optics", "Pharma", "Quilts",
          "Retail", "Software", "Textiles", "Utilities", "Ventures", "Wellness", "Yarns", "Zinc",
          "Automation", "Broadcast", "Capital", "Design"]
SUFFIXES = [" Pvt. Ltd", " Private Limited", " Inc.", " Corp", " LLP", "", " Ltd", " Incorporated",
            " limited liability company"]
PLACES = ["Bengaluru, Karnataka", "Delhi NCR", "New Delhi", "mumbai", "Pune", "Gurgaon", "Hyderabad, Telangana",
          "chennai", "Kolkata", "Jaipur", "Lucknow", "Kochi", "Indore", "Bhopal", "Nagpur", "Remote India",
          "London, UK", "Surat,, Gujarat", "New   York", "Coimbatore"]
TENURES = ["Needs 2-4 years in a similar role", "5+ years of practice", "2 to 5 years experience",
           "upto 3 years", "at least 6 months", "3-9 months contract", "head of a small team", "freshers welcome fresher",
           "associate level", "experienced staff wanted", "manager with drive", "", "10 yrs of work"]
ARRANGEMENTS = ["work from home possible", "hybrid office", "flexible hours and maternity cover", "remote first",
                "on site only", "part time or freelance", "equal opportunity employer", "women encouraged to apply",
                "contract basis", "standard shift", "virtual team, flexible schedule"]
SKILLS = ["Python", "Java", "SQL", "Excel", "Tally", "SEO", "Google Ads", "Figma", "Photoshop", "Teaching",
          "Recruitment", "Payroll", "CRM", "Negotiation", "Docker", "Cloud", "Statistics", "Patient Care",
          "Javascript", "C++"]
DOMAINS = ["Technology", "Data Science", "Software Engineering", "Marketing", "Healthcare", "Finance", "Education",
           "HR", "Sales", "Operations", "Design", "Content Writing", "Nursing", "Data Entry", "General", "Legal",
           "Beauty Wellness", "Customer Support", "Accounting", "Childcare"]
SECTORS = ["IT & Technology", "Healthcare & Medical", "Education & E-Learning", "Banking & Finance",
           "Marketing & Sales", "Customer Service", "Content & Media", "General", "Unlisted Sector"]
EDUCATIONS = ["Below 8th/Informal Education", "8th Pass", "10th Pass (SSC)", "12th Pass (HSC)", "Diploma/ITI",
              "Graduate (BTech/BA/BCom/BSc)", "Post Graduate (MBA/MTech/MA/MSc)", "PhD/Doctorate", "MBA graduate"]
SENIORITIES = ["Entry Level/Fresher", "Junior", "Associate", "Senior Associate", "Manager", "Senior Manager",
               "Director/Executive", "Entry", "Mid", "Senior", "Lead", "team lead"]
TIERS = ["Metro", "Tier-1", "Tier-2", "Tier-3", "Rural", "Remote"]
MODES = ["Work From Home", "Remote", "Hybrid", "Office", "On-site", "Field Work"]
TYPES = ["Full-time", "Part-time", "Freelance", "Contract", "Internship"]
SHIFTS = ["Day Shift", "General Shift", "Flexible", "Night Shift", "Rotational"]
TRAVELS = ["No Travel", "Occasional", "Frequent", "Rarely"]
GROWTHS = ["Low", "Medium", "High"]


def company_name(key):
    return f"({pick(key, FIRST)} || ' ' || {pick(div(key, 31), SECOND)})"


K, C = "o_orderkey", "o_custkey"
A, B = f"CAST(3 + {K} % 12 AS STRING)", f"CAST(5 + {K} % 12 + {K} % 5 AS STRING)"
N = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
SALARY_TEXT = f"""CASE CAST({K} % 14 AS INT)
  WHEN 0 THEN '₹' || {A} || '-' || {B} || ' Lacs' WHEN 1 THEN {A} || ' - ' || {B} || ' LPA'
  WHEN 2 THEN '$' || {A} || 'K-$' || {B} || 'K' WHEN 3 THEN {A} || '-' || {B} || ' /hr'
  WHEN 4 THEN 'Not Disclosed' WHEN 5 THEN '₹3,00,000' WHEN 6 THEN '₹' || {N}
  WHEN 7 THEN '$45,000 - $' || {B} || '0,000' WHEN 8 THEN '€' || {N} WHEN 9 THEN '£' || {A} || 'k'
  WHEN 10 THEN {A} || '.5 lakhs' WHEN 11 THEN 'Competitive salary' WHEN 12 THEN {N} || '-' || {N}
  WHEN 13 THEN 'CAD ' || {N} || ' per year' END"""


def skill_at(key):
    return pick(key, SKILLS)


def flag(key, n, rest=0):
    return f"(({key}) % {n} = {rest})"


P = "c_custkey"
STANDINS = {
    "postings": f"""
      SELECT o_orderkey AS row_id, o_custkey AS company_id,
        {null_every(17, 3, K, pick(K, RANKS) + " || " + pick(div(K, 7), ROLES))} AS job_title,
        {null_every(19, 5, K, company_name(C) + " || " + pick(K, SUFFIXES))} AS company,
        {null_every(23, 7, K, pick(div(K, 3), PLACES))} AS location,
        {null_every(11, 9, K, SALARY_TEXT)} AS salary_text,
        {pick(K, TENURES)} || ', ' || {pick(div(K, 13), ARRANGEMENTS)} AS job_description,
        {null_every(6, 1, K, K + " % 1000")} AS views, o_orderdate AS posted_at
      FROM {{orders}}""",
    "posting_copies": f"""
      SELECT row_id, job_title, company, location, salary_text, job_description FROM {{postings}}
      UNION ALL
      SELECT row_id + 1000000000 AS row_id, job_title || 's' AS job_title, company || ' Ltd' AS company,
        location, CASE WHEN row_id % 4 = 0 THEN NULL ELSE salary_text END AS salary_text, job_description
      FROM {{postings}} WHERE row_id % 50 = 0
      UNION ALL
      SELECT row_id + 2000000000 AS row_id, job_title, company, location,
        CASE WHEN row_id % 3 = 0 THEN NULL ELSE salary_text END AS salary_text, job_description
      FROM {{postings}} WHERE row_id % 40 = 0""",
    "companies": f"""
      SELECT {P} AS company_id, {company_name(P)} AS name, c_mktsegment AS description,
        {null_every(9, 2, P, pick(P, ["1-10", "11-50", "51-200", "201+"]))} AS company_size,
        {pick(P, ["Karnataka", "Delhi", "Maharashtra", "Texas", None])} AS state,
        {pick("c_nationkey", ["IN", "in", "US", "GB", "In", "DE"])} AS country,
        {pick(P, PLACES)} AS city, CAST(110001 + {P} % 500 AS STRING) AS zip_code,
        {null_every(7, 6, P, "'https://example.org/' || CAST(" + P + " AS STRING)")} AS url
      FROM {{customer}}""",
    "company_industries": "SELECT DISTINCT o_custkey AS company_id, o_orderpriority AS industry FROM {orders}",
    "company_specialities": "SELECT DISTINCT o_custkey AS company_id, o_orderstatus AS speciality FROM {orders}",
    "employee_counts": """
      SELECT o_custkey AS company_id, count(*) * 10 AS employee_count,
        CAST(sum(o_orderkey % 97) AS BIGINT) AS follower_count
      FROM {orders} GROUP BY o_custkey""",
    "gender_stats": f"""
      SELECT {P} AS stat_id, {pick("c_nationkey", ["IND", "USA", "IND", "GBR", "FRA"])} AS country_code,
        {pick(P, ["SL.TLF.CACT.FE.ZS", "SL.TLF.CACT.MA.ZS", "SP.POP.TOTL", "SE.TER.ENRR.FE"])} AS series_code,
        'series for ' || c_mktsegment AS description
      FROM {{customer}}""",
    "salary_rows": """
      SELECT p_partkey AS row_id, 20000 + p_partkey % 900 * 100.0e0 AS minsalary,
        40000 + p_partkey % 700 * 150.0e0 AS maxsalary, p_partkey % 2 AS hourly, p_partkey % 3 AS employerprovided,
        CASE WHEN p_partkey % 5 = 0 THEN 'n/a' WHEN p_partkey % 5 = 1 THEN '12' || p_brand
          ELSE CAST(1950 + p_size AS STRING) END AS founded, p_name AS title, p_brand AS employer
      FROM {part}""",
    "profiles": f"""
      SELECT {P} AS profile_id, 18 + {P} % 45 AS age, {P} % 4 AS kids,
        {null_every(29, 4, P, f"2 + {P} % 11")} AS hours_available,
        CASE WHEN {P} % 45 < {P} % 16 THEN {P} % 45 ELSE {P} % 16 END AS experience_years,
        {null_every(37, 2, P, "CAST(20000 + floor(c_acctbal) * 7 AS DOUBLE)")} AS income,
        CAST(15000 + {P} % 300 * 100 AS DOUBLE) AS salary_min, CAST(30000 + {P} % 500 * 120 AS DOUBLE) AS salary_max,
        CAST({P} % 11 AS DOUBLE) AS mother_suitability_score, CAST(35 + {P} % 66 AS DOUBLE) AS skill_match_score,
        CAST({P} % 10 AS DOUBLE) AS work_life_balance,
        {pick(P, DOMAINS)} AS domain, {pick(div(P, 3), SECTORS)} AS sector,
        {skill_at(P + " * 3")} AS primary_skill,
        {null_every(5, 2, P, skill_at(div(P, 2)))} AS secondary_skill,
        {null_every(19, 7, P, pick(div(P, 5), EDUCATIONS))} AS education,
        {null_every(13, 5, P, pick(div(P, 7), PLACES))} AS city, {pick(div(P, 2), TIERS)} AS city_tier,
        'Delhi' AS state, 'India' AS country, {pick(div(P, 11), MODES)} AS work_mode, {pick(div(P, 4), TYPES)} AS work_type,
        {pick(div(P, 6), SENIORITIES)} AS seniority_level, {pick(P, ["Single", "Married"])} AS marital_status,
        {pick(div(P, 9), SHIFTS)} AS shift_type, {null_every(31, 8, P, pick(div(P, 8), GROWTHS))} AS career_growth,
        {pick(div(P, 10), TRAVELS)} AS travel_required,
        {pick(P, ["Hindi", "English", "Both English and Hindi", "null"])} AS language,
        {null_every(3, 1, P, "'Laptop'")} AS device,
        {flag(P, 2)} AS remote_available, {flag(P, 3)} AS flexible_timing, {flag(div(P, 2), 3)} AS childcare_compatible,
        {flag(P, 5, 1)} AS women_friendly, {flag(P, 7, 2)} AS maternity_benefits, {flag(div(P, 3), 2)} AS training_provided,
        {flag(P, 4, 3)} AS health_insurance, {flag(P, 6, 1)} AS pf_available, {flag(P, 8, 5)} AS is_verified,
        {null_every(41, 6, P, skill_at(P) + " || ', ' || " + skill_at(div(P, 3)) + " || ',' || " + skill_at(div(P, 20)) + " || ', ' || lower(" + skill_at(P) + ")")} AS all_skills,
        {pick(div(P, 3), ROLES)} AS job_title, {company_name(P)} AS company
      FROM {{customer}}""",
    "users": f"""
      SELECT user_id, {company_name("user_id")} AS name,
        CASE WHEN user_id % 9 = 0 THEN 'Shared@Example.org' ELSE 'user' || CAST(user_id AS STRING) || '@example.org' END AS email
      FROM (SELECT DISTINCT user_id FROM {{events}}) u""",
    "tasks": """SELECT event_id AS id, user_id, event_id % 3 = 0 AS is_completed, ts AS created_at
      FROM {events} WHERE event_type = 'click'""",
    "reminders": """SELECT event_id AS id, user_id, 'reminder ' || CAST(event_id AS STRING) AS title,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS due_date, event_id % 2 = 0 AS is_completed
      FROM {events} WHERE event_type = 'signup'""",
    "user_activities": """SELECT event_id AS id, user_id, event_type AS activity_type, value, ts AS created_at FROM {events}""",
    "job_search_history": f"""SELECT event_id AS id, user_id, {pick("event_id", ROLES)} AS predicted_job,
        {pick(div("event_id", 2), DOMAINS)} AS domain, {pick("event_id", MODES)} AS work_mode,
        20 + event_id % 40 AS age, 1 + event_id % 8 AS hours, value AS confidence_score, ts AS created_at
      FROM {{events}} WHERE event_type = 'view'""",
    "skill_search_history": f"""SELECT event_id AS id, user_id, {skill_at("event_id")} AS skill_name,
        {pick("event_id", ["Beginner", "Intermediate", "Advanced"])} AS level, ts AS created_at
      FROM {{events}} WHERE event_type = 'purchase'""",
    "user_skills": f"""SELECT user_id, {skill_at("event_id")} AS skill_name, 'Beginner' AS level,
        CAST(min(10 + event_id % 90) AS BIGINT) AS progress, max(ts) AS updated_at
      FROM {{events}} WHERE event_type = 'error' GROUP BY 1, 2""",
    "user_profiles": f"""SELECT user_id, {null_every(5, 1, "user_id", "20 + user_id % 30")} AS age,
        {null_every(7, 3, "user_id", pick("user_id", EDUCATIONS))} AS education,
        {null_every(6, 2, "user_id", pick("user_id", PLACES))} AS location, {pick("user_id", DOMAINS)} AS preferred_domain,
        {skill_at("user_id")} AS primary_skill, {skill_at("user_id + 7")} AS secondary_skill,
        {null_every(3, 0, "user_id", "'2 years'")} AS experience, {null_every(4, 1, "user_id", "'cv.pdf'")} AS resume_path
      FROM {{users}} WHERE user_id % 8 <> 5""",
    "organizations": f"""SELECT s_suppkey AS id, {company_name("s_suppkey")} AS company_name,
        CASE WHEN s_suppkey % 11 = 0 THEN 'USER' || CAST(s_suppkey AS STRING) || '@example.org'
          ELSE 'org' || CAST(s_suppkey AS STRING) || '@example.org' END AS email,
        {pick("s_suppkey", ["Pending", "Approved", "Declined", "Removed"])} AS status FROM {{supplier}}""",
    "organization_jobs": f"""SELECT p_partkey AS id, {div("p_partkey", 20)} AS org_id,
        {pick("p_partkey", ROLES)} AS title, {pick(div("p_partkey", 3), ARRANGEMENTS)} AS description,
        {skill_at("p_partkey")} || ' and ' || {skill_at(div("p_partkey", 4))} || ' for ' || {pick(div("p_partkey", 2), DOMAINS)} AS requirements,
        p_partkey % 6 <> 0 AS is_active FROM {{part}}""",
    "job_applications": f"""SELECT o_orderkey AS id, {div("o_orderkey * 2", 15)} AS job_id, o_custkey % 150 AS user_id,
        {pick("o_orderkey", ["Pending", "Reviewed", "Shortlisted", "Rejected", "Lost"])} AS status, o_orderdate AS applied_at
      FROM {{orders}}""",
    "training_courses": f"""SELECT p_partkey AS id, {div("p_partkey", 20)} AS org_id,
        'Learn ' || {skill_at(div("p_partkey", 2))} || ' with ' || p_name AS title, {skill_at("p_partkey")} AS skill_name,
        (p_partkey * 7919) % 10007 AS created_no FROM {{part}}""",
    "consultation_requests": f"""SELECT event_id AS id, user_id,
        {pick("event_id", ["Pending", "Called", "Cancelled", "Lost"])} AS status, ts AS created_at
      FROM {{events}} WHERE event_type = 'signup'""",
    "status_changes": f"""SELECT 'application' AS kind, CAST(l_orderkey AS BIGINT) AS entity_id, CAST(l_linenumber AS BIGINT) AS id,
        {pick("l_orderkey + l_linenumber", ["Pending", "Reviewed", "Shortlisted", "Rejected", "Lost"])} AS status, CAST(l_shipdate AS TIMESTAMP) AS changed_at FROM {{lineitem}}
      UNION ALL SELECT 'request', user_id, event_id, {pick("event_id", ["Pending", "Called", "Cancelled", "Lost"])}, CAST(ts AS TIMESTAMP)
        FROM {{events}} WHERE event_type = 'signup'
      UNION ALL SELECT 'organisation', CAST(s_suppkey AS BIGINT), CAST(1 AS BIGINT), {pick("s_suppkey", ["Pending", "Approved", "Declined", "Removed"])}, CAST(NULL AS TIMESTAMP)
        FROM {{supplier}}""",
    "login_attempts": """SELECT event_id AS id, user_id, ts, event_type <> 'error' AS success
      FROM {events} WHERE event_type IN ('error', 'signup', 'purchase')""",
    "contacts": f"""SELECT {P} AS contact_id,
        CASE CAST({P} % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'no-at-sign.example.org' WHEN 2 THEN ' User.Name+tag@Mail.Example.org '
          WHEN 3 THEN 'a@b' WHEN 4 THEN '' ELSE 'c' || CAST({P} AS STRING) || '@example.org' END AS email,
        CASE CAST({P} % 7 AS INT) WHEN 0 THEN '+91 98765-43210' WHEN 1 THEN '12345' WHEN 2 THEN '09876543210'
          WHEN 3 THEN NULL WHEN 4 THEN '5876543210' ELSE '98765 ' || CAST(10000 + {P} % 90000 AS STRING) END AS phone,
        CASE CAST({P} % 5 AS INT) WHEN 0 THEN c_name WHEN 1 THEN 'A' WHEN 2 THEN {company_name(P)}
          WHEN 3 THEN '<b>Bold & "quoted"</b>' ELSE ' Mary-Ann St. Clair ' END AS name
      FROM {{customer}}""",
    "scored_labels": """SELECT doc_id, quality, toxic, CASE WHEN (doc_id * 7919) % 1000 >= 450 THEN 1 ELSE 0 END AS predicted,
        ((doc_id * 7919) % 1000) / 1000.0e0 AS score, 20000.0e0 + (doc_id * 104729) % 60000 AS actual,
        21000.0e0 + (doc_id * 104729) % 60000 + (doc_id % 13 - 6) * 400.0e0 AS estimate
      FROM {labels}""",
    "requests": f"""SELECT c_custkey AS request_id,
        CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN 'c++' WHEN 1 THEN 'Goo' WHEN 2 THEN 'data juggling' WHEN 3 THEN 'excel'
          WHEN 4 THEN 'sql tuning' WHEN 5 THEN 'py' WHEN 6 THEN '[x' ELSE {skill_at("c_custkey")} END AS skill,
        1 + c_custkey % 9 AS hours, {pick(div("c_custkey", 2), ["Beginner", "Intermediate", "Advanced"])} AS level
      FROM {{customer}}""",
    "seekers": f"""SELECT c_custkey AS request_id,
        {pick("c_custkey", ["Legal", "General", "data", "Quantum", "Childcare", "HR", "zz"])} AS domain,
        {pick(div("c_custkey", 2), ["Unlisted Sector", "General", "Space", "Finance"])} AS sector,
        {pick(div("c_custkey", 3), ["C++", "Welding", "Tally", "SQL"])} AS primary_skill,
        {pick(div("c_custkey", 5), MODES)} AS work_mode, {pick(div("c_custkey", 4), TYPES)} AS work_type
      FROM {{customer}}""",
}


def needs(sql):
    """Names a derived table reads."""
    return sorted({name for _, name, _, _ in Formatter().parse(sql) if name})


class Tables:
    """Attribute access to given and derived tables below one folder."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made = {}

    def _scan(self, name):
        """One given table. A table in fewer splits than there are cores would keep every later
        step in a few tasks, so the wide ones are spread then, and ``customer`` by its rows; with
        many files nothing is added."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in WIDE and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        if name in SPREAD_BY_ROWS:
            return spread_by_rows(df, ROWS_PER_TASK)
        return df

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in GIVEN:
                self._made[name] = self._scan(name)
            elif name in STANDINS:
                sql = STANDINS[name]
                self._made[name] = self.spark.sql(with_arrays(sql), **{n: getattr(self, n) for n in needs(sql)})
            else:
                raise AttributeError(name)
        return self._made[name]
