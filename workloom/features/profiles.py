"""Profile table: feature lists and the training null policy."""

from workloom.operators.cleaning import training_nulls

NUMERIC = ["age", "kids", "hours_available", "experience_years", "income", "salary_min", "salary_max",
           "mother_suitability_score", "skill_match_score", "work_life_balance"]
CATEGORICAL = ["domain", "sector", "primary_skill", "secondary_skill", "education", "city", "city_tier", "state", "country",
               "work_mode", "work_type", "seniority_level", "marital_status", "shift_type", "career_growth",
               "travel_required", "language", "device"]
BOOLEAN = ["remote_available", "flexible_timing", "childcare_compatible", "women_friendly", "maternity_benefits",
           "training_provided", "health_insurance", "pf_available", "is_verified"]
TEXT = ["all_skills", "job_title", "company"]


def clean_profiles(profiles, required=()):
    return training_nulls(profiles, NUMERIC, CATEGORICAL, BOOLEAN, TEXT, required)
