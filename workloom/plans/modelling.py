"""Targets, features, splits, scaling and metrics."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.features import sets
from workloom.features.profiles import clean_profiles
from workloom.learn import evaluate
from workloom.operators.statistics import quantiles
from workloom.plans import sqlparts as s
from workloom.plans.measure import _quintile_sql
from workloom.plans.registry import check_view, query

_REMOTE = "work_mode IN ('Remote', 'Work From Home', 'Hybrid')"
_N = "len(string_split(all_skills, ','))"


def _out(df, columns, digits=4):
    """Profile id and features; numbers as rounded doubles so that engines agree."""
    types = dict(df.dtypes)
    return df.select("profile_id", *[c if types[c] == "string" else F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])


def _sql(features, view="clean_profiles", digits=4):
    cols = ", ".join(f"round(CAST({x} AS DOUBLE), {digits}) AS {c}" if not x.startswith("TEXT ") else f"{x[5:]} AS {c}" for c, x in features.items())
    return f"SELECT profile_id, {cols} FROM {view}"


def _cleaned(t):
    return clean_profiles(t.profiles)


# --- targets -------------------------------------------------------------------
@query("fe1_job_category_target", f"SELECT profile_id, domain || '_' || {s.lookup('seniority_level', lexicon.SIMPLE_SENIORITY, 'Entry')} AS job_category FROM clean_profiles")
def _(t):
    return _cleaned(t).select("profile_id", F.expr(sets.job_category_target()).alias("job_category"))


_BASE = f"({s.lookup('education', lexicon.EDUCATION_INCOME, 0)} * 0.30e0 + {s.lookup('domain', lexicon.DOMAIN_INCOME, 40000)} * 0.35e0)"
_INCOME = (f"least(greatest(({_BASE} + {_BASE} * {s.lookup('seniority_level', lexicon.SENIORITY_MULTIPLIER, 0.0)} * 0.20e0 + experience_years * 3000 * 0.10e0)"
           f" * {s.lookup('city_tier', lexicon.TIER_MULTIPLIER, 1.0)}, 8000), 400000)")
check_view("income_targets", f"SELECT profile_id, CAST({_INCOME} AS DOUBLE) AS target FROM clean_profiles")


@query("fe2_income_target", "SELECT profile_id, round(target, 4) AS income_target FROM income_targets")
def _(t):
    return _cleaned(t).select("profile_id", F.round(F.expr(sets.income_target()), 4).alias("income_target"))


@query("ag12_income_statistics", """
  SELECT round(min(target), 4) AS min, round(max(target), 4) AS max, round(avg(target), 4) AS mean, round(median(target), 4) AS median, round(stddev_samp(target), 4) AS std FROM income_targets""")
def _(t):
    v = _cleaned(t).select(F.expr(sets.income_target()).alias("v"))
    median = quantiles(v, ["v"], [0.5])["v"][0]
    return v.agg(F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"), F.round(F.avg("v"), 4).alias("mean"),
                 F.round(F.lit(median), 4).alias("median"), F.round(F.stddev_samp("v"), 4).alias("std"))


@query("fe3_suitability_class", _quintile_sql("mother_suitability_score", "clean_profiles", lexicon.SUITABILITY_CLASSES).replace("AS class", "AS suitability_class"))
def _(t):
    return sets.suitability_class(_cleaned(t).select("profile_id", "mother_suitability_score")).select("profile_id", "suitability_class")


check_view("balance_scores", f"""
  SELECT profile_id, remote_available * 20 + flexible_timing * 20 + least(greatest(20 - (hours_available - 4) * 2, 0), 20)
    + CASE WHEN regexp_matches(lower(shift_type), 'day|general|morning') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(travel_required, '(?i)no') THEN 15 ELSE 0 END
    + childcare_compatible * 10 + CASE WHEN regexp_matches(lower(work_mode), 'remote|home') THEN 15 ELSE 0 END + CASE WHEN strpos(lower(work_mode), 'hybrid') > 0 THEN 10 ELSE 0 END AS score FROM clean_profiles""")


@query("fe4_balance_class", _quintile_sql("score", "balance_scores", lexicon.BALANCE_CLASSES).replace("AS class", "AS wlb_class"))
def _(t):
    return sets.balance_class(_cleaned(t)).select("profile_id", "wlb_class")


_FIT = "CASE seniority_level " + " ".join(f"WHEN '{k}' THEN least(greatest((experience_years - {lo}) / {max(hi - lo, 1)}.0e0, 0), 1) * 40" for k, (lo, hi) in lexicon.SENIORITY_EXPERIENCE.items()) + " ELSE 0 END"
_WORDS = "CASE domain " + " ".join(f"WHEN '{d}' THEN least(len(list_filter([{', '.join(s.q(k) for k in ks)}], lambda k: strpos(lower(all_skills), k) > 0 OR strpos(lower(primary_skill), k) > 0)) / {len(ks)}.0e0, 1) * 30"
                                   for d, ks in lexicon.DOMAIN_KEYWORDS.items()) + " ELSE 15 END"
check_view("match_scores", f"""
  SELECT profile_id, CAST(least(greatest({_FIT} + least({_N} / greatest(2 + experience_years * 0.5e0, 1), 2) / 2 * 30 + {_WORDS}, 0), 100) AS DOUBLE) AS score FROM clean_profiles""")


@query("fe5_skill_match_target", f"SELECT profile_id, round(score, 4) AS score, {s.cut('score', [0, 40, 60, 80, 100], ['Low', 'Medium', 'High', 'Very_High'], True)} AS skill_match_class FROM match_scores")
def _(t):
    scored = _cleaned(t).withColumn("score", F.expr(sets.skill_match_target()))
    return scored.select("profile_id", F.round("score", 4).alias("score"), F.expr(sets.skill_match_class("score")).alias("skill_match_class"))


@query("fe6_seniority_standard", f"""
  SELECT profile_id, {s.lookup('lower(seniority_level)', lexicon.SENIORITY_STANDARD, 'KEEP').replace("'KEEP'", s.title_case('seniority_level'))} AS seniority_clean FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", sets.seniority_standard(F.col("seniority_level")).alias("seniority_clean"))


@query("fe7_quality_target", "SELECT profile_id, CASE WHEN mother_suitability_score >= 8 THEN 1 ELSE 0 END AS profile_quality FROM clean_profiles")
def _(t):
    return _cleaned(t).select("profile_id", F.expr(sets.quality_target()).alias("profile_quality"))


# --- features ------------------------------------------------------------------
_FE8 = {"age_group": "TEXT " + s.cut("age", [0, 25, 35, 45, 100], ["young", "middle", "senior", "veteran"]),
        "exp_level": "TEXT " + s.cut("experience_years", [-1, 2, 5, 10, 100], ["fresher", "junior", "mid", "senior"]),
        "computed_seniority": "TEXT " + s.cut("experience_years", [-1, 3, 8, 100], ["Entry", "Mid", "Senior"]), "has_kids": "kids > 0",
        "hours_category": "TEXT " + s.cut("hours_available", [0, 4, 6, 8, 100], ["part_time", "half_day", "full_day", "overtime"]),
        "is_remote": _REMOTE, "skills_count": _N}


@query("fe8_job_features", _sql(_FE8))
def _(t):
    return _out(sets.job_features(_cleaned(t)), list(_FE8))


_FE9 = {"age_squared": "age ** 2", "age_group": "TEXT " + s.cut("age", [0, 25, 30, 35, 40, 50, 100], ["<25", "25-30", "30-35", "35-40", "40-50", "50+"]),
        "exp_squared": "experience_years ** 2", "exp_age_ratio": "experience_years / (age - 17)",
        "exp_level": "TEXT " + s.cut("experience_years", [-1, 1, 3, 5, 8, 12, 100], ["fresher", "junior", "mid", "senior", "lead", "expert"]),
        "flexibility_score": f"remote_available + flexible_timing + CAST({_REMOTE} AS INT)", "benefits_score": "health_insurance + pf_available + maternity_benefits + training_provided",
        "mother_friendly_composite": "(mother_suitability_score + childcare_compatible + women_friendly + flexible_timing) / 4.0e0",
        "city_tier_num": s.lookup("city_tier", lexicon.TIER_ORDINAL, 1), "has_kids": "kids > 0", "kids_impact": "kids * hours_available",
        "seniority_num": s.lookup("seniority_level", lexicon.SENIORITY_ORDINAL, 1), "career_growth_num": s.lookup("career_growth", lexicon.GROWTH_ORDINAL, 1),
        "education_num": s.lookup("education", lexicon.EDUCATION_ORDINAL, 3)}


@query("fe9_income_features", _sql(_FE9))
def _(t):
    return _out(sets.income_features(_cleaned(t)), list(_FE9))


_FLEX, _FAM = "remote_available + flexible_timing + childcare_compatible", "maternity_benefits + women_friendly + childcare_compatible"
_FE10 = {"flexibility_score": f"({_FLEX}) * 25", "family_support_score": f"({_FAM}) * 33", "total_benefits": "health_insurance + pf_available + maternity_benefits + training_provided",
         "work_stress": f"{s.lookup('travel_required', lexicon.TRAVEL_STRESS, 10)} + greatest(12 - hours_available, 0) * 5",
         "mother_friendly_composite": f"({_FLEX}) * 10 + ({_FAM}) * 9.9e0 + work_life_balance * 0.3e0", "kids_factor": "kids > 0", "kids_count_impact": "least(kids, 4) * 10",
         "day_shift": "regexp_matches(lower(shift_type), 'day|morning')", "hours_suitable": "hours_available <= 8"}


@query("fe10_suitability_features", _sql(_FE10))
def _(t):
    return _out(sets.suitability_features(_cleaned(t)), list(_FE10))


_MODE = "CASE lower(work_mode) WHEN 'remote' THEN 100 WHEN 'hybrid' THEN 75 WHEN 'office' THEN 50 ELSE 50 END"
_FE11 = {"flexibility_score": f"({_FLEX}) * 33.33e0", "hours_stress": "greatest(12 - hours_available, 0) * 10", "reasonable_hours": "hours_available <= 8",
         "no_travel": s.lookup("travel_required", lexicon.TRAVEL_FREEDOM, 0.5), "day_shift": "regexp_matches(lower(shift_type), 'day|morning')",
         "night_shift": "regexp_matches(lower(shift_type), 'night|graveyard')", "family_friendly_score": f"({_FAM}) * 33.33e0",
         "benefits_score": "(health_insurance + pf_available + training_provided) * 25", "work_mode_score": _MODE,
         "balance_composite": f"({_FLEX}) * 33.33e0 * 0.35e0 + ({_FAM}) * 33.33e0 * 0.25e0 + {_MODE} * 0.2e0 + (100 - greatest(12 - hours_available, 0) * 10) * 0.2e0",
         "has_kids": "kids > 0", "multiple_kids": "kids > 1"}


@query("fe11_balance_features", _sql(_FE11))
def _(t):
    return _out(sets.balance_features(_cleaned(t)), list(_FE11))


_FE12 = {"exp_level": "TEXT " + s.cut("experience_years", [-1, 2, 5, 10, 20, 100], ["Entry", "Junior", "Mid", "Senior", "Expert"]),
         "age_group": "TEXT " + s.cut("age", [17, 25, 35, 45, 55, 100], ["18-25", "26-35", "36-45", "46-55", "55+"]), "skills_count": _N, "flexibility_score": _FLEX,
         "benefits_score": "maternity_benefits + health_insurance + pf_available + training_provided", "exp_age_ratio": "experience_years / greatest(age - 17, 1)",
         "hours_util": "hours_available / 12"}


@query("fe12_match_features", _sql(_FE12))
def _(t):
    return _out(sets.match_features(_cleaned(t)), list(_FE12))


_EXP = s.lookup("seniority_level", lexicon.SENIORITY_EXPECTED_SKILLS, 5)
_GROW = s.lookup("career_growth", lexicon.GROWTH_POINTS, 50)
_FE13 = {"skills_count": _N, "skill_diversity": "len(list_distinct(string_split(lower(all_skills), ','))) / (1.0e0 * len(string_split(all_skills, ',')))",
         "skill_exp_ratio": f"{_N} / (experience_years + 1)", "skill_gap_indicator": "100 - skill_match_score", "growth_gap": f"100 - {_GROW}",
         "expected_skills": _EXP, "skill_deficiency": f"greatest({_EXP} - {_N}, 0)", "domain_complexity": s.lookup("domain", lexicon.DOMAIN_COMPLEXITY, 1.0),
         "training_likelihood": f"greatest({_EXP} - {_N}, 0) * 5 + (100 - skill_match_score) * 0.5e0 + (100 - {_GROW}) * 0.3e0"}


@query("fe13_gap_features", _sql(_FE13))
def _(t):
    return _out(sets.gap_features(_cleaned(t)), list(_FE13))


_EDUWORD = "coalesce(list_max(list_transform(string_split(lower(education), ' '), lambda w: " + s.lookup("w", lexicon.EDUCATION_WORD_LEVELS, 0).replace("ELSE 0", "ELSE NULL") + ")), 3)"
_FE14 = {"skills_count": _N, "exp_age_ratio": "experience_years / greatest(age - 17, 1)", "career_velocity": f"{_N} / (experience_years + 1)",
         "income_per_exp": "income / (experience_years + 1)", "education_level": _EDUWORD, "growth_potential": f"{_GROW} / (experience_years + 1)",
         "job_stability": "is_verified + health_insurance + pf_available", "leadership_indicator": "regexp_matches(work_mode, '(?i)lead|manage|director')"}


@query("fe14_career_features", _sql(_FE14))
def _(t):
    return _out(sets.career_features(_cleaned(t)), list(_FE14))


_EO = s.lookup("education", lexicon.EDUCATION_ORDINAL, 3)
_FE15 = {"education_level": _EO, "seniority_num": s.lookup("seniority_level", lexicon.SENIORITY_SHORT_ORDINAL, 1),
         "skills_count": f"CASE WHEN trim(all_skills) = '' THEN 0 ELSE {_N} END", "has_secondary_skill": "secondary_skill NOT IN ('', 'nan', 'Unknown')",
         "exp_edu_interaction": f"experience_years * {_EO}", "income_per_exp": "income / (experience_years + 1)",
         "benefits_count": "health_insurance + pf_available + maternity_benefits + training_provided + flexible_timing + childcare_compatible + women_friendly + remote_available",
         "hours_bucket": f"coalesce({s.cut('hours_available', [0, 3, 5, 7, 24], [0, 1, 2, 3])}, 1)", "age_group": f"coalesce({s.cut('age', [0, 25, 35, 45, 100], [0, 1, 2, 3])}, 1)",
         "city_tier_num": s.lookup("city_tier", lexicon.TIER_PROFILE_ORDINAL, 2)}


@query("fe15_quality_features", _sql(_FE15))
def _(t):
    return _out(sets.quality_features(_cleaned(t)), list(_FE15))


def _differs(name, a, b):
    return f"SELECT '{name}' AS feature, count(*) AS row_count, count(*) FILTER ({a} <> {b}) AS differing FROM clean_profiles"


@query("fe16_feature_drift", " UNION ALL ".join([
    _differs("work_stress", s.lookup("travel_required", lexicon.TRAVEL_STRESS, 10), s.lookup("travel_required", lexicon.SCORING_TRAVEL_STRESS, 10)),
    _differs("day_shift", "regexp_matches(lower(shift_type), 'day|morning')", "regexp_matches(lower(shift_type), 'day|morning|general')"),
    _differs("work_mode_score", _MODE, s.lookup("work_mode", lexicon.SCORING_MODE_SCORES, 50)),
    _differs("expected_skills", _EXP, s.lookup("seniority_level", lexicon.SCORING_EXPECTED_SKILLS, 5)),
    _differs("domain_complexity", s.lookup("domain", lexicon.DOMAIN_COMPLEXITY, 1.0), "1.0"), _differs("education_level", _EDUWORD, _EO)]))
def _(t):
    return sets.drift_report(_cleaned(t))


@query("fe17_form_defaults", """
  SELECT profile_id, 'Medium' AS career_growth, coalesce(income, 30000.0e0) AS income, coalesce(city, 'Delhi') AS city, work_mode IN ('Remote', 'Work From Home', 'Hybrid') AS remote_available,
    shift_type = 'Flexible' OR work_mode IN ('Work From Home', 'Remote') AS flexible_timing, domain || ' ' || work_type AS job_title FROM profiles""")
def _(t):
    asked = t.profiles.select("profile_id", "age", "experience_years", "domain", "work_mode", "work_type", "shift_type", "income", "city")
    return sets.with_form_defaults(asked).select("profile_id", "career_growth", "income", "city", "remote_available", "flexible_timing", "job_title")


@query("fe18_combined_text", "SELECT profile_id, all_skills || ' ' || primary_skill || ' ' || secondary_skill AS skills_text, all_skills || ' ' || primary_skill || ' ' || job_title AS career_text FROM clean_profiles")
def _(t):
    return _cleaned(t).select("profile_id", sets.combined_text().alias("skills_text"), sets.combined_text(True).alias("career_text"))


# --- preparation and metrics ---------------------------------------------------
@query("ml6_scaling", """
  SELECT profile_id, round((age - (SELECT avg(age) FROM clean_profiles)) / (SELECT stddev_pop(age) FROM clean_profiles), 6) AS age,
    round((income - (SELECT median(income) FROM clean_profiles)) / (SELECT quantile_cont(income, 0.75) - quantile_cont(income, 0.25) FROM clean_profiles), 6) AS income FROM clean_profiles""")
def _(t):
    rows = _cleaned(t).select("profile_id", "age", "income")
    return evaluate.robust_scaled(evaluate.standard_scaled(rows, ["age"]), ["income"]).select(
        "profile_id", F.round("age", 6).alias("age"), F.round("income", 6).alias("income"))


@query("ml8_stratified_split", """
  SELECT profile_id, CASE WHEN r <= 0.2 * n THEN 'test' ELSE 'train' END AS part FROM (SELECT profile_id, row_number() OVER (PARTITION BY domain ORDER BY md5(CAST(profile_id AS VARCHAR)), profile_id) AS r,
    count(*) OVER (PARTITION BY domain) AS n FROM profiles)""")
def _(t):
    return evaluate.stratified_split(t.profiles.select("profile_id", "domain"), "domain", "profile_id").select("profile_id", "part")


@query("ml13_class_weights", """
  SELECT seniority_level, round((SELECT count(*) FROM profiles) / (1.0e0 * (SELECT count(DISTINCT seniority_level) FROM profiles) * count(*)), 6) AS weight FROM profiles GROUP BY seniority_level""")
def _(t):
    return evaluate.class_weights(t.profiles, "seniority_level").select("seniority_level", F.round("weight", 6).alias("weight"))


@query("ml17_classification_metrics", """
  WITH c AS (SELECT quality AS y, predicted AS p, score FROM scored_labels),
  k AS (SELECT y AS cls, count(*) AS support, count(*) FILTER (p = y) AS hit, (SELECT count(*) FROM c d WHERE d.p = c.y) AS guessed FROM c GROUP BY y),
  m AS (SELECT support, hit, CASE WHEN guessed = 0 THEN 0 ELSE hit / (1.0e0 * guessed) END AS pr, hit / (1.0e0 * support) AS re FROM k)
  SELECT round(sum(hit) / (1.0e0 * sum(support)), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall,
    round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * support) / sum(support), 6) AS f1,
    (SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) / count(*), 6) FROM c a JOIN c b ON a.y = 1 AND b.y = 0) AS roc_auc FROM m""")
def _(t):
    basic = evaluate.classification_metrics(t.scored_labels, "quality", "predicted")
    area = evaluate.roc_auc(t.scored_labels, "quality", "score").first()[0]
    return basic.withColumn("roc_auc", F.lit(area)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@query("ml18_regression_metrics", """
  WITH e AS (SELECT actual - estimate AS d, actual, ln(1 + actual) AS y, ln(1 + estimate) AS p FROM scored_labels)
  SELECT round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (SELECT sum((y - (SELECT avg(y) FROM e)) ** 2) FROM e), 6) AS r2,
    round(median(abs(d)), 4) AS median_ae, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_var, round(avg(abs(d / actual)) * 100, 6) AS mape FROM e""")
def _(t):
    out = evaluate.regression_metrics(t.scored_labels)
    return out.select(*[F.round(c, 4).alias(c) for c in ("mae", "rmse", "median_ae")], *[F.round(c, 6).alias(c) for c in ("r2", "explained_var", "mape")])


@query("ml19_log_target", "SELECT profile_id, round(ln(1 + target), 6) AS log_income, round(exp(ln(1 + target)) - 1, 4) AS back FROM income_targets")
def _(t):
    logged = _cleaned(t).select("profile_id", F.log1p(F.expr(sets.income_target())).alias("v"))
    return logged.select("profile_id", F.round("v", 6).alias("log_income"), F.round(F.expm1("v"), 4).alias("back"))
