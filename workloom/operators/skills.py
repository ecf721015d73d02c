"""Skills and careers per profile: gaps, prerequisites, navigation, progression."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions.rules import case, lookup, quoted, texts
from workloom.functions.text import skill_array, skills_count


def dimension(spark, rows, schema):
    """A small fixed table; its size is that of the fixed values, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def domain_skills(spark):
    return dimension(spark, list(lexicon.DOMAIN_SKILLS.items()), "domain STRING, required ARRAY<STRING>")


def prerequisites(spark):
    return dimension(spark, list(lexicon.PREREQUISITES.items()), "skill STRING, needs ARRAY<STRING>")


def missing_skills(profiles):
    """Required skills of the domain that the profile lacks, in the order of the requirement."""
    return (profiles.join(domain_skills(profiles.sparkSession), "domain", "left")
            .withColumn("required", F.coalesce("required", F.array().cast("array<string>")))
            .withColumn("missing", F.array_except("required", skill_array(F.col("all_skills")))))


def missing_prerequisites(profiles, profile_id="profile_id"):
    """(profile, prerequisite) of every missing skill, without those already owned."""
    gaps = missing_skills(profiles).select(profile_id, skill_array(F.col("all_skills")).alias("owned"),
                                           F.explode("missing").alias("skill"))
    needed = gaps.join(prerequisites(profiles.sparkSession), "skill").select(
        profile_id, F.explode(F.array_except("needs", "owned")).alias("prerequisite"))
    return needed.distinct()


def gap_report(profiles, profile_id="profile_id"):
    """Skill-gap report per profile."""
    known = F.create_map(*[x for k, v in lexicon.PREREQUISITES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    owned = skill_array(F.col("all_skills"))
    need = F.greatest(F.size("required"), F.lit(1))
    out = missing_skills(profiles).withColumns({
        "__prereq": F.array_distinct(F.array_except(F.flatten(F.transform(
            "missing", lambda s: F.coalesce(F.try_element_at(known, s), F.array().cast("array<string>")))), owned)),
        "gap_score": F.size("missing") * 100.0 / need,
        "skill_match_percentage": (F.size("required") - F.size("missing")) * 100.0 / need})
    advice = case([(f"gap_score < {bound}", texts(tips)) for bound, tips in lexicon.GAP_ADVICE if bound],
                  texts(lexicon.GAP_ADVICE[-1][1]))
    return out.select(profile_id, "domain", F.size("required").alias("required_count"),
                      F.slice("missing", 1, 5).alias("missing_skills"),
                      F.slice(F.array_sort("__prereq"), 1, 3).alias("prerequisites_needed"),
                      "skill_match_percentage", "gap_score", (F.col("gap_score") > 30).alias("training_recommended"),
                      F.slice("missing", 1, 3).alias("priority_skills"), F.expr(advice).alias("recommendations"))


def navigation(profiles, profile_id="profile_id"):
    """Sector to domains to skills, with the fallbacks of an unknown sector or domain."""
    spark = profiles.sparkSession
    every = sorted({d for ds in lexicon.SECTOR_DOMAINS.values() for d in ds})
    sectors = dimension(spark, list(lexicon.SECTOR_DOMAINS.items()), "sector STRING, domains ARRAY<STRING>")
    skills = dimension(spark, list(lexicon.DOMAIN_TRAINING_SKILLS.items()), "domain STRING, skills ARRAY<STRING>")
    general = F.array(*[F.lit(s) for s in lexicon.DOMAIN_TRAINING_SKILLS["General"]])
    return (profiles.join(sectors, "sector", "left").join(skills, "domain", "left")
            .select(profile_id, "sector", "domain", F.coalesce("domains", F.lit(every)).alias("domains"),
                    F.coalesce("skills", general).alias("skills")))


def with_next_role(df, level="seniority_level", years="experience_years", skills="skills_count"):
    """Next role, readiness and what is still needed."""
    steps = dimension(df.sparkSession, [(k, *v) for k, v in lexicon.PROGRESSION.items()],
                      f"`{level}` STRING, next_role STRING, years_needed INT, skills_needed INT")
    ready = (F.least(F.col(years) / F.col("years_needed"), F.lit(1.0)) * 0.5
             + F.least(F.col(skills) / F.col("skills_needed"), F.lit(1.0)) * 0.5) * 100
    return (df.join(steps, level, "left").withColumns({
        "next_role": F.coalesce("next_role", F.lit("Unknown")),
        "readiness_percentage": F.coalesce(F.bround(ready, 1), F.lit(0.0)),
        "years_to_next": F.greatest(F.lit(0), F.col("years_needed") - F.col(years)),
        "skills_gap": F.greatest(F.lit(0), F.col("skills_needed") - F.col(skills))})
        .drop("years_needed", "skills_needed"))


def career_report(profiles, profile_id="profile_id"):
    """Readiness advice and the paths of the domain."""
    paths = dimension(profiles.sparkSession, list(lexicon.CAREER_PATHS.items()), "domain STRING, suggested_paths ARRAY<STRING>")
    base = with_next_role(profiles.withColumn("skills_count", skills_count(F.col("all_skills"))))
    ready = F.col("readiness_percentage")
    advice = (F.when(ready >= 80, F.array(F.lit("You're ready for the next level!"), F.lit("Start applying for senior positions"),
                                          F.lit("Consider mentoring others")))
              .when(ready >= 50, F.array(F.concat(F.lit("Focus on gaining "), F.col("skills_gap"), F.lit(" more key skills")),
                                         F.lit("Take on leadership responsibilities"), F.lit("Build your network")))
              .otherwise(F.array(F.lit("Focus on skill development"), F.lit("Seek mentorship from seniors"),
                                 F.concat(F.lit("Gain "), F.coalesce("years_to_next", F.lit(0)), F.lit(" more years of experience")))))
    return base.join(paths, "domain", "left").select(
        profile_id, "seniority_level", "next_role", "readiness_percentage", "years_to_next", "skills_gap", "domain",
        F.coalesce(F.slice("suggested_paths", 1, 2), F.array().cast("array<string>")).alias("suggested_paths"),
        advice.alias("recommendations"))


def suggested_skills(domain, current):
    """Up to five skills of the domain without the current one (array expression text)."""
    found = case([(f"{domain} = {quoted(d)}", texts(s)) for d, s in lexicon.SUGGESTED_SKILLS.items()],
                 texts(lexicon.SUGGESTED_SKILLS_DEFAULT))
    return f"slice(filter({found}, s -> lower(s) <> lower({current})), 1, 5)"


def advice_by_class(df, label, table):
    """Advice texts of a class label; unknown labels get an empty list."""
    tips = dimension(df.sparkSession, list(table.items()), f"`{label}` STRING, advice ARRAY<STRING>")
    return df.join(tips, label, "left").withColumn("advice", F.coalesce("advice", F.array().cast("array<string>")))


def domain_complexity(domain):
    return lookup(domain, lexicon.DOMAIN_COMPLEXITY, 1.0)
