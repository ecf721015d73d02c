"""Targets and feature sets over the cleaned profile table.

One definition serves training and scoring; every feature is a built-in expression.
"""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions.rules import case, contains_any, cut, lookup, quoted, total
from workloom.functions.text import skill_diversity, skills_count, title_case
from workloom.operators.ranking import quintile_labels
from workloom.operators.statistics import quantiles

REMOTE = "work_mode IN (" + ", ".join(quoted(m) for m in lexicon.REMOTE_MODES) + ")"
SKILLS = "size(split(all_skills, ','))"


def _add(df, features):
    """Adds features in order; a later one may use an earlier one."""
    for name, expression in features.items():
        df = df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)
    return df


def _flag(condition):
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _word_score(text, table, default):
    """Best score among the words of a text, ``default`` if none is listed."""
    return f"coalesce(array_max(transform(split(lower({text}), ' '), w -> {lookup('w', table)})), {default})"


# --- targets -------------------------------------------------------------------
def job_category_target():
    return f"concat(domain, '_', {lookup('seniority_level', lexicon.SIMPLE_SENIORITY, 'Entry')})"


def income_target(noise=None):
    """Income from education, domain, seniority, years and city tier, without noise unless given."""
    base = (f"({lookup('education', lexicon.EDUCATION_INCOME, 0)} * 0.30D"
            f" + {lookup('domain', lexicon.DOMAIN_INCOME, lexicon.DOMAIN_INCOME_DEFAULT)} * 0.35D)")
    raised = f"({base} * (1 + {lookup('seniority_level', lexicon.SENIORITY_MULTIPLIER, 0.0)} * 0.20D) + experience_years * 300)"
    placed = f"{raised} * {lookup('city_tier', lexicon.TIER_MULTIPLIER, 1.0)}"
    return f"least(greatest({placed} * (1 + {noise or '0D'}), 8000D), 400000D)"


def balance_score():
    shift, mode = "lower(shift_type)", "lower(work_mode)"
    return total(["remote_available * 20", "flexible_timing * 20", "least(greatest(20 - (hours_available - 4) * 2, 0), 20)",
                  _flag(contains_any(shift, ["day", "general", "morning"])) + " * 15",
                  _flag("contains(lower(travel_required), 'no')") + " * 15", "childcare_compatible * 10",
                  _flag(contains_any(mode, ["remote", "home"])) + " * 15", _flag(f"contains({mode}, 'hybrid')") + " * 10"])


def skill_match_target():
    """Experience alignment 40, skills against years 30, domain keywords 30."""
    fit = case([(f"seniority_level = {quoted(k)}",
                 f"least(greatest((experience_years - {lo}) / {max(hi - lo, 1)}, 0D), 1D) * 40")
                for k, (lo, hi) in lexicon.SENIORITY_EXPERIENCE.items()], "0D")
    ratio = f"least({SKILLS} / greatest(2 + experience_years * 0.5D, 1D), 2D) / 2 * 30"
    words = case([(f"domain = {quoted(d)}", f"least({total([_flag(f'contains(lower(all_skills), {quoted(k)}) OR contains(lower(primary_skill), {quoted(k)})') for k in ks])} / {len(ks)}, 1D) * 30")
                  for d, ks in lexicon.DOMAIN_KEYWORDS.items()], "15D")
    return f"least(greatest({fit} + {ratio} + {words}, 0D), 100D)"


def skill_match_class(score):
    return cut(score, [0, 40, 60, 80, 100], ["Low", "Medium", "High", "Very_High"], True)


def seniority_standard(column):
    """Standard seniority name; unlisted names in title case."""
    low = F.lower(column)
    names = F.create_map(*[F.lit(x) for kv in lexicon.SENIORITY_STANDARD.items() for x in kv])
    return F.coalesce(F.try_element_at(names, low), title_case(low))


def quality_target():
    return _flag("mother_suitability_score >= 8")


def suitability_class(df):
    return quintile_labels(df, "mother_suitability_score", "profile_id", lexicon.SUITABILITY_CLASSES, "suitability_class")


def balance_class(df):
    scored = df.withColumn("computed_wlb_score", F.expr(balance_score()).cast("double"))
    return quintile_labels(scored, "computed_wlb_score", "profile_id", lexicon.BALANCE_CLASSES, "wlb_class")


# --- feature sets --------------------------------------------------------------
def job_features(df):
    return _add(df, {
        "age_group": cut("age", [0, 25, 35, 45, 100], ["young", "middle", "senior", "veteran"]),
        "exp_level": cut("experience_years", [-1, 2, 5, 10, 100], ["fresher", "junior", "mid", "senior"]),
        "computed_seniority": cut("experience_years", [-1, 3, 8, 100], ["Entry", "Mid", "Senior"]),
        "has_kids": _flag("kids > 0"),
        "hours_category": cut("hours_available", [0, 4, 6, 8, 100], ["part_time", "half_day", "full_day", "overtime"]),
        "is_remote": _flag(REMOTE), "skills_count": SKILLS})


def income_features(df):
    return _add(df, {
        "age_squared": "age * age",
        "age_group": cut("age", [0, 25, 30, 35, 40, 50, 100], ["<25", "25-30", "30-35", "35-40", "40-50", "50+"]),
        "exp_squared": "experience_years * experience_years", "exp_age_ratio": "experience_years / (age - 18 + 1)",
        "exp_level": cut("experience_years", [-1, 1, 3, 5, 8, 12, 100], ["fresher", "junior", "mid", "senior", "lead", "expert"]),
        "flexibility_score": f"remote_available + flexible_timing + {_flag(REMOTE)}",
        "benefits_score": "health_insurance + pf_available + maternity_benefits + training_provided",
        "mother_friendly_composite": "(mother_suitability_score + childcare_compatible + women_friendly + flexible_timing) / 4",
        "city_tier_num": lookup("city_tier", lexicon.TIER_ORDINAL, 1), "has_kids": _flag("kids > 0"),
        "kids_impact": "kids * hours_available", "seniority_num": lookup("seniority_level", lexicon.SENIORITY_ORDINAL, 1),
        "career_growth_num": lookup("career_growth", lexicon.GROWTH_ORDINAL, 1),
        "education_num": lookup("education", lexicon.EDUCATION_ORDINAL, 3)})


def suitability_features(df, travel=lexicon.TRAVEL_STRESS, day_words=("day", "morning")):
    return _add(df, {
        "flexibility_score": "(remote_available + flexible_timing + childcare_compatible) * 25",
        "family_support_score": "(maternity_benefits + women_friendly + childcare_compatible) * 33",
        "total_benefits": "health_insurance + pf_available + maternity_benefits + training_provided",
        "work_stress": f"{lookup('travel_required', travel, 10)} + greatest(12 - hours_available, 0) * 5",
        "mother_friendly_composite": "flexibility_score * 0.4D + family_support_score * 0.3D + work_life_balance * 0.3D",
        "kids_factor": _flag("kids > 0"), "kids_count_impact": "least(kids, 4) * 10",
        "day_shift": _flag(contains_any("lower(shift_type)", day_words)), "hours_suitable": _flag("hours_available <= 8")})


def balance_features(df, day_words=("day", "morning"), mode_score=None):
    mode_score = mode_score or _word_score("work_mode", lexicon.MODE_SCORES, 50)
    return _add(df, {
        "flexibility_score": "(remote_available + flexible_timing + childcare_compatible) * 33.33D",
        "hours_stress": "greatest(12 - hours_available, 0) * 10", "reasonable_hours": _flag("hours_available <= 8"),
        "no_travel": lookup("travel_required", lexicon.TRAVEL_FREEDOM, 0.5),
        "day_shift": _flag(contains_any("lower(shift_type)", day_words)),
        "night_shift": _flag(contains_any("lower(shift_type)", ["night", "graveyard"])),
        "family_friendly_score": "(women_friendly + maternity_benefits + childcare_compatible) * 33.33D",
        "benefits_score": "(health_insurance + pf_available + training_provided) * 25", "work_mode_score": mode_score,
        "balance_composite": "flexibility_score * 0.35D + family_friendly_score * 0.25D + work_mode_score * 0.20D + (100 - hours_stress) * 0.20D",
        "has_kids": _flag("kids > 0"), "multiple_kids": _flag("kids > 1")})


def income_level(df, value="income"):
    """Income quintile by value: right-closed, the lowest value included.

    The edges are one exact aggregate; equal edges cannot name five classes and are refused.
    """
    edges = quantiles(df, [value], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])[value]
    if len(set(edges)) < len(edges):
        raise ValueError("equal quantile edges leave fewer than five income classes")
    return df.withColumn("income_level", F.expr(cut(value, [quoted(e) for e in edges], lexicon.QUINTILE_INCOME_CLASSES, True)))


def match_features(df):
    return income_level(_add(df, {
        "exp_level": cut("experience_years", [-1, 2, 5, 10, 20, 100], ["Entry", "Junior", "Mid", "Senior", "Expert"]),
        "age_group": cut("age", [17, 25, 35, 45, 55, 100], ["18-25", "26-35", "36-45", "46-55", "55+"]),
        "skills_count": SKILLS, "flexibility_score": "remote_available + flexible_timing + childcare_compatible",
        "benefits_score": "maternity_benefits + health_insurance + pf_available + training_provided",
        "exp_age_ratio": "experience_years / greatest(age - 17, 1)", "hours_util": "hours_available / 12"}))


def gap_features(df, expected=lexicon.SENIORITY_EXPECTED_SKILLS, complexity=None):
    return _add(df, {
        "skills_count": SKILLS, "skill_diversity": skill_diversity(F.col("all_skills")),
        "skill_exp_ratio": "skills_count / (experience_years + 1)", "skill_gap_indicator": "100 - skill_match_score",
        "career_growth_num": lookup("career_growth", lexicon.GROWTH_POINTS, 50), "growth_gap": "100 - career_growth_num",
        "expected_skills": lookup("seniority_level", expected, 5), "skill_deficiency": "greatest(expected_skills - skills_count, 0)",
        "domain_complexity": complexity or lookup("domain", lexicon.DOMAIN_COMPLEXITY, 1.0),
        "training_likelihood": "skill_deficiency * 5 + skill_gap_indicator * 0.5D + growth_gap * 0.3D"})


def career_features(df, education=None):
    return _add(df, {
        "skills_count": SKILLS, "exp_age_ratio": "experience_years / greatest(age - 17, 1)",
        "career_velocity": "skills_count / (experience_years + 1)", "income_per_exp": "income / (experience_years + 1)",
        "education_level": education or _word_score("education", lexicon.EDUCATION_WORD_LEVELS, 3),
        "career_growth_num": lookup("career_growth", lexicon.GROWTH_POINTS, 50),
        "growth_potential": "career_growth_num / (experience_years + 1)",
        "job_stability": "is_verified + health_insurance + pf_available",
        "leadership_indicator": _flag(contains_any("lower(work_mode)", ["lead", "manage", "director"]))})


def quality_features(df):
    """Features of the profile-quality target; columns the target is made of are dropped."""
    out = _add(df, {
        "education_level": lookup("education", lexicon.EDUCATION_ORDINAL, 3),
        "seniority_num": lookup("seniority_level", lexicon.SENIORITY_SHORT_ORDINAL, 1),
        "skills_count": f"CASE WHEN trim(all_skills) IN ('', 'nan') THEN 0 ELSE {SKILLS} END",
        "has_secondary_skill": _flag("trim(secondary_skill) NOT IN ('', 'nan', 'Unknown')"),
        "exp_edu_interaction": "experience_years * education_level", "income_per_exp": "income / (experience_years + 1)",
        "benefits_count": total(["health_insurance", "pf_available", "maternity_benefits", "training_provided",
                                 "flexible_timing", "childcare_compatible", "women_friendly", "remote_available"]),
        "hours_bucket": f"coalesce({cut('hours_available', [0, 3, 5, 7, 24], [0, 1, 2, 3])}, 1)",
        "age_group": f"coalesce({cut('age', [0, 25, 35, 45, 100], [0, 1, 2, 3])}, 1)",
        "city_tier_num": lookup("city_tier", lexicon.TIER_PROFILE_ORDINAL, 2)})
    return out.drop("mother_suitability_score", "work_life_balance", "skill_match_score", "career_growth")


# --- scoring side --------------------------------------------------------------
SCORING_MODE = lookup("work_mode", lexicon.SCORING_MODE_SCORES, 50)
SCORING_EDUCATION = lookup("education", lexicon.EDUCATION_ORDINAL, 3)

FORM_DEFAULTS = {
    "career_growth": "'Medium'", "travel_required": "'No Travel'", "women_friendly": "true", "maternity_benefits": "false",
    "training_provided": "false", "health_insurance": "false", "pf_available": "false", "is_verified": "false", "income": "30000D",
    "mother_suitability_score": "7D", "skill_match_score": "75D", "work_life_balance": "7D", "city": "'Delhi'", "state": "'Delhi'",
    "country": "'India'", "remote_available": REMOTE,
    "flexible_timing": "shift_type = 'Flexible' OR work_mode IN ('Work From Home', 'Remote')",
    "childcare_compatible": "work_mode IN ('Work From Home', 'Remote')",
    "seniority_level": "CASE WHEN experience_years <= 2 THEN 'Entry Level/Fresher' WHEN experience_years <= 5 THEN 'Associate' WHEN experience_years <= 8 THEN 'Senior Associate' ELSE 'Manager' END",
    "job_title": "concat(domain, ' ', work_type)",
}


def with_form_defaults(df):
    """Fills the fields that a form does not ask for."""
    return df.withColumns({c: F.coalesce(F.col(c), F.expr(x)) if c in df.columns else F.expr(x) for c, x in FORM_DEFAULTS.items()})


def role_profiles(roles):
    """A full profile from title and years; tier and education may be given."""
    return roles.select(
        "*", *[F.expr(x).alias(c) for c, x in {
            "age": "22 + experience_years", "kids": "0", "hours_available": "8", "work_mode": "'Office'", "domain": "'General'",
            "primary_skill": "''", "all_skills": "job_title", "marital_status": "'Single'",
            "seniority_level": "CASE WHEN experience_years < 3 THEN 'Associate' ELSE 'Senior Associate' END",
            "remote_available": "false", "flexible_timing": "false", "city_tier": "'Tier-1'",
            "education": "'Graduate (BTech/BA/BCom/BSc)'"}.items() if c not in roles.columns])


def drift_report(df):
    """Rows on which the training and the scoring definition of a feature differ."""
    makers = {
        "work_stress": (f"{lookup('travel_required', lexicon.TRAVEL_STRESS, 10)}", f"{lookup('travel_required', lexicon.SCORING_TRAVEL_STRESS, 10)}"),
        "day_shift": (_flag(contains_any("lower(shift_type)", ("day", "morning"))), _flag(contains_any("lower(shift_type)", ("day", "morning", "general")))),
        "work_mode_score": (_word_score("work_mode", lexicon.MODE_SCORES, 50), SCORING_MODE),
        "expected_skills": (lookup("seniority_level", lexicon.SENIORITY_EXPECTED_SKILLS, 5), lookup("seniority_level", lexicon.SCORING_EXPECTED_SKILLS, 5)),
        "domain_complexity": (lookup("domain", lexicon.DOMAIN_COMPLEXITY, 1.0), "1.0D"),
        "education_level": (_word_score("education", lexicon.EDUCATION_WORD_LEVELS, 3), SCORING_EDUCATION),
    }
    row = df.agg(*[F.struct(F.lit(n).alias("feature"), F.count(F.lit(1)).alias("row_count"), F.count_if(F.expr(f"({a}) <> ({b})")).alias("differing")).alias(n)
                      for n, (a, b) in makers.items()])
    return row.select(F.explode(F.array(*makers)).alias("r")).select("r.*")


def combined_text(with_title=False):
    parts = ["all_skills", "primary_skill", "job_title" if with_title else "secondary_skill"]
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in parts])