"""User and organisation reports: counts are made per table before anything is joined."""

from functools import reduce

from pyspark.sql import functions as F


def counted_union(parts, key):
    """One row per key from many per-table counts.

    ``parts`` is ``[(table, {metric: condition or None})]``. Every table is reduced to counts
    by key on the map side; the union of those small tables is summed once.
    """
    metrics = [m for _, ms in parts for m in ms]
    slim = []
    for df, own in parts:
        counts = df.groupBy(key).agg(*[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(m) for m, c in own.items()])
        slim.append(counts.select(key, *[F.col(m) if m in own else F.lit(0).cast("long").alias(m) for m in metrics]))
    stacked = reduce(lambda a, b: a.unionByName(b), slim)
    return stacked.groupBy(key).agg(*[F.sum(m).alias(m) for m in metrics])


def dashboard_counts(users, tasks, reminders, skills, job_searches, skill_searches):
    counts = counted_union([
        (tasks, {"tasks_total": None, "tasks_completed": F.col("is_completed")}),
        (reminders, {"reminders_total": None, "reminders_active": ~F.col("is_completed")}),
        (skills, {"skills_total": None}), (job_searches, {"job_searches": None}), (skill_searches, {"skill_searches": None})], "user_id")
    return users.select("user_id").join(counts, "user_id", "left").na.fill(0)


def organisation_dashboard(organizations, jobs, courses, applications):
    per_job = applications.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    applied = (jobs.select(F.col("id").alias("job_id"), "org_id").join(per_job, "job_id")
               .groupBy("org_id").agg(F.sum("n").alias("applications")))
    counts = counted_union([(jobs, {"jobs": None}), (courses, {"courses": None})], "org_id")
    return (organizations.select(F.col("id").alias("org_id")).join(counts, "org_id", "left")
            .join(applied, "org_id", "left").na.fill(0))


def repeated_emails(users, organizations):
    both = users.select("email").unionByName(organizations.select("email"))
    return both.groupBy(F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def latest_per_user(history, columns):
    """Newest row per user as one mergeable aggregate."""
    newest = F.max(F.struct("created_at", "id", *[c for c in columns if c != "id"])).alias("row")
    return history.groupBy("user_id").agg(newest).select("user_id", *[F.col(f"row.{c}").alias(c) for c in columns])


def section_completion(users, profiles, skills):
    """A quarter each for basics, skills, experience and resume; all need a profile."""
    owners = skills.select("user_id").distinct().withColumn("has_skills", F.lit(True))
    rows = (users.select("user_id").join(profiles.withColumn("has_profile", F.lit(True)), "user_id", "left")
            .join(owners, "user_id", "left"))
    quarter = ("(CASE WHEN age IS NOT NULL AND age <> 0 AND education <> '' AND location <> '' THEN 25 ELSE 0 END"
               " + CASE WHEN has_profile AND has_skills THEN 25 ELSE 0 END"
               " + CASE WHEN experience <> '' THEN 25 ELSE 0 END + CASE WHEN resume_path <> '' THEN 25 ELSE 0 END)")
    return rows.select("user_id", F.expr(quarter).alias("completion_rate"))
