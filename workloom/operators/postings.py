"""Posting enrichment: arrangement, category, seniority, place, pay and suitability."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions import pay, tenure
from workloom.functions.rules import bands_below, bands_upto, case, contains_any, first_match, lookup, quoted, weighted
from workloom.operators.cleaning import clean_table
from workloom.operators.naming import with_lineage
from workloom.operators.statistics import quantiles
from workloom.session import written


def text_blob(columns):
    return F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))


def _strings(df, skip=("company_id", "job_id")):
    return [c for c, t in df.dtypes if t == "string" and c not in skip]


def _ruled(df, prepared, rules):
    """Adds rule columns over prepared helper columns, which are dropped again."""
    out = df.select("*", *[column.alias(name) for name, column in prepared.items()])
    return out.select(*[c for c in df.columns if c not in rules], *[F.expr(rule).alias(c) for c, rule in rules.items()])


def with_arrangement(df):
    return _ruled(df, {"__blob": text_blob(_strings(df))}, {
        "remote_flag": contains_any("__blob", lexicon.REMOTE_WORDS),
        "work_arrangement": first_match("__blob", [("Remote", lexicon.REMOTE_WORDS), ("Hybrid", lexicon.HYBRID_WORDS)],
                                        "On-site")})


def _lower_title(title):
    return F.lower(F.coalesce(F.col(title), F.lit("")))


def _subcategory(low):
    """Title-cased first keyword of the first category with a hit."""
    arms = []
    for words in lexicon.JOB_CATEGORIES.values():
        arms += [(f"contains({low}, {quoted(w)})", quoted(w.title())) for w in words]
    return case(arms, quoted("General"))


def with_category(df, title="job_title"):
    return _ruled(df, {"__title": _lower_title(title)}, {
        "job_category": first_match("__title", lexicon.JOB_CATEGORIES, "Other"),
        "job_subcategory": _subcategory("__title")})


def with_seniority(df, title="job_title"):
    out = _ruled(df, {"__title": _lower_title(title)},
                 {"seniority_level": first_match("__title", lexicon.SENIORITY_WORDS, "Mid-Level")})
    return out.withColumn("leadership_role", F.col("seniority_level").isin(lexicon.LEADERSHIP_LEVELS))


def with_place(df, columns=("location", "city", "state", "address")):
    named = [("Metro", lexicon.METRO_CITIES), ("Tier-1", lexicon.TIER1_CITIES), ("Tier-2", lexicon.TIER2_CITIES),
             ("Other India", lexicon.COUNTRY_WORDS)]
    return _ruled(df, {"__place": text_blob([c for c in columns if c in df.columns])}, {
        "city_tier": first_match("__place", named, "Unknown"),
        "is_metro": contains_any("__place", lexicon.METRO_CITIES),
        "is_india": contains_any("__place", [w for _, words in named for w in words])})


def with_pay_bracket(df, average):
    """Bracket in lakhs, and whether the pay lies above the median (one exact aggregate)."""
    middle = quantiles(df, [average], [0.5])[average][0]
    return df.withColumns({
        "salary_bracket": F.expr(pay.lakh_bracket(average)),
        "is_competitive_salary": F.coalesce(F.col(average) > F.lit(middle), F.lit(False))})


def with_friendly_flags(df):
    return _ruled(df, {"__blob": text_blob(_strings(df, skip=()))}, {
        "female_friendly": contains_any("__blob", lexicon.FRIENDLY_WORDS),
        "flexible_hours": contains_any("__blob", lexicon.FLEXIBLE_WORDS),
        "part_time_available": contains_any("__blob", lexicon.PART_TIME_WORDS)})


def suitability_score():
    suited = ", ".join(quoted(c) for c in lexicon.SUITED_CATEGORIES)
    return F.expr("least(" + weighted([("remote_flag", 3), ("flexible_hours", 2), ("part_time_available", 2),
                                       ("female_friendly", 1), (f"job_category IN ({suited})", 1)]) + ", 10)")


def cleaned(postings):
    return clean_table(postings, "postings")


def priced(postings):
    """Salary columns from the salary text, with average and category."""
    out = pay.with_salary_columns(postings, ["salary_text"]).withColumnsRenamed({
        "salary_text_min": "salary_min", "salary_text_max": "salary_max", "salary_text_currency": "currency"})
    out = out.withColumn("salary_avg", (F.col("salary_min") + F.col("salary_max")) / 2)
    return out.withColumn("salary_category", F.expr(pay.salary_category("salary_avg")))


def featured(postings, file_name="postings"):
    """Cleaned, priced and classified postings: the job side of the master table.

    Prices are stored before they are used: the median of all and every later column would read the texts again.
    """
    df = written(priced(cleaned(postings)), "priced")
    df = tenure.with_experience_columns(df, ["job_description"], "job_title")
    df = with_lineage(df, F.lit(file_name))
    df = with_arrangement(df)
    df = with_place(with_seniority(with_category(df)))
    df = with_friendly_flags(with_pay_bracket(df, "salary_avg"))
    return df.withColumn("mother_suitability_score", suitability_score())


# --- second rule set, for generated rows ---------------------------------------
def generated_features(df):
    """Category, seniority, bands, tier, state, industry and skills of generated rows."""
    tiers = {city: tier for tier, cities in lexicon.GENERATED_TIERS.items() for city in cities}
    return _ruled(df, {"__low": F.lower("job_title"),
                       "__lpa": (F.col("salary_min") + F.col("salary_max")) / 2 / 100000,
                       "__years": (F.col("required_experience_min") + F.col("required_experience_max")) / 2}, {
        "job_category": first_match("__low", lexicon.GENERATED_CATEGORIES, "Other"),
        "seniority_level": first_match("__low", lexicon.GENERATED_SENIORITY, "Mid-Level"),
        "salary_bracket": bands_below("__lpa", lexicon.GENERATED_SALARY_BANDS, "15+ LPA"),
        "experience_category": bands_upto("__years", lexicon.GENERATED_EXPERIENCE_BANDS, "Senior Level"),
        "city_tier": lookup("location", tiers, "Tier-3"),
        "state": lookup("location", lexicon.CITY_STATES, "Unknown"),
        "industry": first_match("job_title", lexicon.GENERATED_INDUSTRIES, "General Services"),
        "required_skills": lookup("job_title", lexicon.TITLE_SKILLS, lexicon.DEFAULT_TITLE_SKILLS)})
