"""Reports per user, organisation and profile."""


from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions import text as tx
from workloom.operators import ranking, scoring, skills, users
from workloom.operators.matching import substring_join
from workloom.plans import sqlparts as s
from workloom.plans.registry import check_view, query


@query("ag13_dashboard_counts", """
  SELECT u.user_id, (SELECT count(*) FROM tasks x WHERE x.user_id = u.user_id) AS tasks_total, (SELECT count(*) FROM tasks x WHERE x.user_id = u.user_id AND is_completed) AS tasks_completed,
    (SELECT count(*) FROM reminders x WHERE x.user_id = u.user_id) AS reminders_total, (SELECT count(*) FROM reminders x WHERE x.user_id = u.user_id AND NOT is_completed) AS reminders_active,
    (SELECT count(*) FROM user_skills x WHERE x.user_id = u.user_id) AS skills_total, (SELECT count(*) FROM job_search_history x WHERE x.user_id = u.user_id) AS job_searches,
    (SELECT count(*) FROM skill_search_history x WHERE x.user_id = u.user_id) AS skill_searches FROM users u""")
def _(t):
    return users.dashboard_counts(t.users, t.tasks, t.reminders, t.user_skills, t.job_search_history, t.skill_search_history)


@query("ag17_organisation_dashboard", """
  SELECT o.id AS org_id, (SELECT count(*) FROM organization_jobs j WHERE j.org_id = o.id) AS jobs, (SELECT count(*) FROM training_courses c WHERE c.org_id = o.id) AS courses,
    (SELECT count(*) FROM job_applications a JOIN organization_jobs j ON a.job_id = j.id WHERE j.org_id = o.id) AS applications FROM organizations o""")
def _(t):
    return users.organisation_dashboard(t.organizations, t.organization_jobs, t.training_courses, t.job_applications)


@query("ag18_key_uniqueness", """
  SELECT lower(email) AS email, count(*) AS n FROM (SELECT email FROM users UNION ALL SELECT email FROM organizations) GROUP BY lower(email) HAVING count(*) > 1""")
def _(t):
    return users.repeated_emails(t.users, t.organizations)


@query("wi5_latest_per_user", """
  SELECT user_id, id, predicted_job FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM job_search_history) WHERE rn = 1""")
def _(t):
    return users.latest_per_user(t.job_search_history, ["id", "predicted_job"])


@query("wi6_last_n_per_user", """
  SELECT user_id, id, rank FROM (SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM user_activities) WHERE rank <= 5""")
def _(t):
    return ranking.top_per_key(t.user_activities.select("user_id", "id", "created_at"), ["user_id"],
                               [F.desc("created_at"), F.desc("id")], 5, "rank").select("user_id", "id", "rank")


@query("wi7_open_reminders", """
  SELECT user_id, id, rank FROM (SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY due_date ASC NULLS FIRST, id) AS INT) AS rank FROM reminders WHERE NOT is_completed) WHERE rank <= 5""")
def _(t):
    return ranking.top_per_key(t.reminders.filter("NOT is_completed").select("user_id", "id", "due_date"), ["user_id"],
                               [F.asc_nulls_first("due_date"), "id"], 5, "rank").select("user_id", "id", "rank")


@query("fi4_course_search", """
  SELECT q.skill, c.id, c.created_no FROM (SELECT DISTINCT skill_name AS skill FROM skill_search_history) q JOIN training_courses c
    ON strpos(lower(c.skill_name), lower(q.skill)) > 0 OR strpos(lower(c.title), lower(q.skill)) > 0""")
def _(t):
    wanted = t.skill_search_history.select(F.col("skill_name").alias("skill")).distinct().withColumn("needle", F.lower("skill"))
    texts = t.training_courses.select("id", "created_no", F.explode(F.array(F.lower("skill_name"), F.lower("title"))).alias("haystack"))
    return substring_join(wanted, texts, ["skill"], ["id", "created_no"]).distinct().orderBy("skill", F.desc("created_no"))


# --- completeness --------------------------------------------------------------
def _filled(c, text=True):
    return f"({c} IS NOT NULL AND trim({c}) NOT IN ('', 'nan', 'None', 'null', 'Unknown'))" if text else f"({c} IS NOT NULL)"


_NUM = ("age", "experience_years", "hours_available", "kids")
_W = " + ".join(f"CASE WHEN {_filled(c, c not in _NUM)} THEN {w} ELSE 0 END" for c, w in lexicon.PROFILE_WEIGHTS.items())
_HEAD = """CASE WHEN pct < 50 THEN 'Your profile is incomplete. Add more details to improve visibility.' WHEN pct < 70 THEN 'Good start! A few more fields will boost your profile.'
  WHEN pct < 90 THEN 'Almost complete! Add remaining fields for best matches.' END"""
_ADV = ", ".join([_HEAD] + [f"CASE WHEN NOT {_filled(c, c not in _NUM)} THEN 'Add your {c.replace('_', ' ')}' END" for c in lexicon.ADVICE_PRIORITY])


@query("cr14_profile_completeness", f"""
  SELECT profile_id, CAST(pct AS DOUBLE) AS percentage, CASE WHEN pct >= 90 THEN 'A+' WHEN pct >= 80 THEN 'A' WHEN pct >= 70 THEN 'B' WHEN pct >= 60 THEN 'C' WHEN pct >= 50 THEN 'D' ELSE 'F' END AS grade,
    array_to_string(list_filter([{_ADV}], lambda x: x IS NOT NULL)[1:5], '|') AS recommendations, pct >= 70 AS ready_for_matching,
    CASE WHEN pct >= 90 THEN 'Excellent profile! (Grade: A+) Your profile is highly complete.'
      WHEN pct >= 70 THEN 'Good profile! (Grade: ' || CASE WHEN pct >= 80 THEN 'A' ELSE 'B' END || ') A few additions will improve your matches.'
      WHEN pct >= 50 THEN 'Fair profile. (Grade: ' || CASE WHEN pct >= 60 THEN 'C' ELSE 'D' END || ') Please complete more fields for better results.'
      ELSE 'Incomplete profile. (Grade: F) Add essential information to get started.' END AS summary
  FROM (SELECT *, {_W} AS pct FROM profiles)""")
def _(t):
    return scoring.completeness_report(t.profiles).withColumn("recommendations", F.array_join("recommendations", "|"))


_FW = " + ".join(f"CASE WHEN {'kids IS NULL OR kids IS NOT NULL' if c == 'kids' else f'coalesce({c}, 0) > 0' if c in _NUM else f'''coalesce({c}, '') <> ''' + repr('')} THEN {w} ELSE 0 END" for c, w in lexicon.FORM_WEIGHTS.items())
_ADJ = "CASE WHEN quality = 1 AND base >= 80 THEN greatest(base, 90) WHEN quality = 0 AND base > 85 THEN least(base, 85) ELSE base END"


@query("cr15_form_completeness", f"""
  SELECT profile_id, CAST(score AS INT) AS completeness, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade
  FROM (SELECT profile_id, {_ADJ} AS score FROM (SELECT *, CAST(round_even(base0 * 100.0e0 / 100, 0) AS INT) AS base, CASE WHEN mother_suitability_score >= 8 THEN 1 ELSE 0 END AS quality
    FROM (SELECT *, {_FW} AS base0 FROM profiles)))""")
def _(t):
    return scoring.form_completeness(t.profiles, "CASE WHEN mother_suitability_score >= 8 THEN 1 ELSE 0 END")


@query("cr16_section_completion", """
  SELECT u.user_id, (CASE WHEN p.age IS NOT NULL AND p.education IS NOT NULL AND p.location IS NOT NULL THEN 25 ELSE 0 END) + (CASE WHEN p.user_id IS NOT NULL AND u.user_id IN (SELECT user_id FROM user_skills) THEN 25 ELSE 0 END)
    + (CASE WHEN p.experience IS NOT NULL THEN 25 ELSE 0 END) + (CASE WHEN p.resume_path IS NOT NULL THEN 25 ELSE 0 END) AS completion_rate
  FROM users u LEFT JOIN user_profiles p ON u.user_id = p.user_id""")
def _(t):
    return users.section_completion(t.users, t.user_profiles, t.user_skills)


_EDU = s.lookup("education", lexicon.EDUCATION_POINTS, 10)


@query("cr17_skill_match_score", f"""
  SELECT profile_id, CAST(score AS INT) AS score, CASE WHEN score >= 75 THEN 'Excellent' WHEN score >= 55 THEN 'High' WHEN score >= 35 THEN 'Medium' ELSE 'Low' END AS level
  FROM (SELECT p.profile_id, least(least(experience_years * 5, 25) + least(len(owned) * 12, 25) + {_EDU} + least(coalesce(hours_available, 0) * 2, 15)
      + CASE WHEN coalesce(secondary_skill, '') <> '' THEN 15 ELSE 0 END, 100) AS score FROM profiles p JOIN owned_skills o ON p.profile_id = o.profile_id)""")
def _(t):
    return scoring.skill_match(t.profiles)


@query("cr18_match_level", """
  SELECT profile_id, CASE WHEN skill_match_score < 20 THEN 'Very Low' WHEN skill_match_score < 40 THEN 'Low' WHEN skill_match_score < 60 THEN 'Medium' WHEN skill_match_score < 80 THEN 'High' ELSE 'Very High' END AS level FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", F.expr(scoring.match_level("skill_match_score")).alias("level"))


@query("cr19_seniority_by_years", """
  SELECT profile_id, CASE WHEN experience_years <= 2 THEN 'Entry Level/Fresher' WHEN experience_years <= 5 THEN 'Associate' WHEN experience_years <= 8 THEN 'Senior Associate' ELSE 'Manager' END AS seniority FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", F.expr(scoring.seniority_by_years("experience_years")).alias("seniority"))


_NEEDS = "CASE x " + " ".join(f"WHEN '{k}' THEN [{', '.join(s.q(p) for p in v)}]" for k, v in lexicon.PREREQUISITES.items()) + " ELSE CAST([] AS VARCHAR[]) END"
_GAP = "(len(missing) * 100.0e0 / greatest(len(required), 1))"


@query("cr20_skill_gap_report", f"""
  SELECT profile_id, CAST(len(required) AS INT) AS required_count, array_to_string(missing[1:5], '|') AS missing_skills,
    array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(missing, lambda x: {_NEEDS})), lambda y: NOT list_contains(owned, y))))[1:3], '|') AS prerequisites_needed,
    round({_GAP}, 4) AS gap_score, round((len(required) - len(missing)) * 100.0e0 / greatest(len(required), 1), 4) AS skill_match_percentage, {_GAP} > 30 AS training_recommended,
    array_to_string(missing[1:3], '|') AS priority_skills,
    CASE {' '.join(f"WHEN {_GAP} < {b} THEN {s.q('|'.join(x))}" for b, x in lexicon.GAP_ADVICE if b)} ELSE {s.q('|'.join(lexicon.GAP_ADVICE[-1][1]))} END AS recommendations FROM skill_gaps""")
def _(t):
    out = skills.gap_report(t.profiles).drop("domain")
    joined = {c: F.array_join(c, "|") for c in ("missing_skills", "prerequisites_needed", "priority_skills", "recommendations")}
    return out.withColumns({**joined, "gap_score": F.round("gap_score", 4), "skill_match_percentage": F.round("skill_match_percentage", 4)})


_STEP = "CASE seniority_level " + " ".join(f"WHEN '{k}' THEN {{'next_role': '{v[0]}', 'years': {v[1]}, 'skills': {v[2]}}}" for k, v in lexicon.PROGRESSION.items()) + " END"
_CNT = f"CAST({s.skills_count('all_skills')} AS INT)"
check_view("career_steps", f"""
  SELECT profile_id, seniority_level, domain, coalesce(step.next_role, 'Unknown') AS next_role,
    coalesce(round_even((least(experience_years / (1.0e0 * step.years), 1.0e0) * 0.5e0 + least(n_skills / (1.0e0 * step.skills), 1.0e0) * 0.5e0) * 100, 1), 0.0e0) AS readiness_percentage,
    CASE WHEN step IS NULL THEN 0 ELSE greatest(0, step.years - experience_years) END AS years_to_next, CASE WHEN step IS NULL THEN 0 ELSE greatest(0, step.skills - n_skills) END AS skills_gap
  FROM (SELECT *, {_STEP} AS step, {_CNT} AS n_skills FROM profiles)""")


@query("cr21_next_role", """
  SELECT profile_id, next_role, CAST(readiness_percentage AS DOUBLE) AS readiness_percentage, CAST(years_to_next AS BIGINT) AS years_to_next, CAST(skills_gap AS BIGINT) AS skills_gap FROM career_steps""")
def _(t):
    base = t.profiles.select("profile_id", "seniority_level", "experience_years", tx.skills_count(F.col("all_skills")).alias("skills_count"))
    return skills.with_next_role(base).select("profile_id", "next_role", "readiness_percentage", F.col("years_to_next").cast("long").alias("years_to_next"),
                                              F.col("skills_gap").cast("long").alias("skills_gap"))


@query("cr22_career_report", f"""
  SELECT profile_id, next_role, {s.lookup('domain', {k: '#'.join(v) for k, v in lexicon.CAREER_PATHS.items()}, '')} AS suggested_paths,
    CASE WHEN readiness_percentage >= 80 THEN 'You''re ready for the next level!|Start applying for senior positions|Consider mentoring others'
      WHEN readiness_percentage >= 50 THEN 'Focus on gaining ' || CAST(CAST(skills_gap AS INT) AS VARCHAR) || ' more key skills|Take on leadership responsibilities|Build your network'
      ELSE 'Focus on skill development|Seek mentorship from seniors|Gain ' || CAST(CAST(years_to_next AS INT) AS VARCHAR) || ' more years of experience' END AS recommendations FROM career_steps""")
def _(t):
    return skills.career_report(t.profiles).select("profile_id", "next_role", F.array_join("suggested_paths", "#").alias("suggested_paths"),
                                                   F.array_join("recommendations", "|").alias("recommendations"))


@query("cr23_class_advice", f"""
  SELECT profile_id, class, {s.lookup('class', {k: '|'.join(v) for k, v in lexicon.SUITABILITY_ADVICE.items()}, '')} AS advice
  FROM (SELECT profile_id, CASE profile_id % 6 WHEN 0 THEN 'Not_Suitable' WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Good' WHEN 4 THEN 'Excellent' ELSE 'Other' END AS class FROM profiles)""")
def _(t):
    labels = F.element_at(F.lit(lexicon.SUITABILITY_CLASSES + ["Other"]), (F.col("profile_id") % 6 + 1).cast("int"))
    rows = t.profiles.select("profile_id", labels.alias("class"))
    return skills.advice_by_class(rows, "class", lexicon.SUITABILITY_ADVICE).select("profile_id", "class", F.array_join("advice", "|").alias("advice"))


_SUG = "CASE domain " + " ".join(f"WHEN '{k}' THEN [{', '.join(s.q(x) for x in v)}]" for k, v in lexicon.SUGGESTED_SKILLS.items()) + f" ELSE [{', '.join(s.q(x) for x in lexicon.SUGGESTED_SKILLS_DEFAULT)}] END"


@query("cr24_suggested_skills", f"""
  SELECT profile_id, array_to_string(list_filter({_SUG}, lambda x: lower(x) <> lower(primary_skill))[1:5], '|') AS suggestions FROM profiles""")
def _(t):
    return t.profiles.select("profile_id", F.array_join(F.expr(skills.suggested_skills("domain", "primary_skill")), "|").alias("suggestions"))
