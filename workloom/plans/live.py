"""Streams and their batch twins."""

from datetime import timedelta

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.plans.registry import query
from workloom.session import scratch_path
from workloom.streaming import feeds, keyed, lockout, snapshots, watermarked

WEEK = 7 * 86400


def _attempts(events):
    return events.filter(F.col("event_type").isin("error", "signup", "purchase")).select(
        F.col("event_id").alias("id"), "user_id", "ts", (F.col("event_type") != "error").alias("success"))


_LOCKOUT = f"""
  WITH RECURSIVE a AS (SELECT user_id, id, success, epoch_us(ts) / 1e6 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM login_attempts),
  r AS (SELECT user_id, rn, id, "at", success, true AS allowed, CAST(0 AS BIGINT) AS remaining, CASE WHEN success THEN CAST([] AS DOUBLE[]) ELSE ["at"] END AS f FROM a WHERE rn = 1
    UNION ALL SELECT user_id, rn, id, "at", success, len(k) < 3, CASE WHEN len(k) < 3 THEN 0 ELSE CAST(trunc({WEEK} - ("at" - list_min(k))) AS BIGINT) END,
      CASE WHEN len(k) >= 3 THEN k WHEN success THEN CAST([] AS DOUBLE[]) ELSE list_append(k, "at") END
    FROM (SELECT a.*, list_filter(r.f, lambda x: a."at" - x < {WEEK}) AS k FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1))
  SELECT user_id, id, "at", success, allowed, remaining FROM r"""


@query("st1_lockout_batch", _LOCKOUT)
def _(t):
    return lockout.lockout(t.login_attempts, WEEK, 3)


@query("st1_lockout_stream", _LOCKOUT)
def _(t):
    return lockout.lockout_stream(_attempts(feeds.event_stream(t.spark, t.folder)), WEEK, 3)


@query("st1_lockout_state", _LOCKOUT)
def _(t):
    """Keyed state; a row far beyond the last attempt then closes the stream, so that every attempt is judged."""
    place = scratch_path(t.spark, "keyed-lockout")
    attempts = _attempts(feeds.event_stream(t.spark, t.folder))
    keyed.keyed_lockout(attempts, WEEK, 3, "3650 days", place)
    last = t.events.agg(F.max("ts")).first()[0]
    if last is not None:
        keyed.closing_rows(t.spark, place, ts=last + timedelta(days=7300))
    return keyed.keyed_lockout(attempts, WEEK, 3, "3650 days", place)[0]


@query("st1_recent_failures", f"""
  WITH a AS (SELECT *, count(*) FILTER (success) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS since FROM login_attempts),
  f AS (SELECT user_id, id, count(*) OVER (PARTITION BY user_id, since ORDER BY epoch_us(ts) RANGE BETWEEN {WEEK * 1000000 - 1} PRECEDING AND CURRENT ROW) AS failures FROM a WHERE NOT success)
  SELECT * FROM f WHERE failures >= 3""")
def _(t):
    return lockout.recent_failures(t.login_attempts, WEEK, 3)


@query("st2_activity_feed", """
  SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events) WHERE rank <= 5""")
def _(t):
    return feeds.feed_stream(feeds.event_stream(t.spark, t.folder)).select("user_id", "event_id", "rank")


def _over(t, run):
    """``run(place)`` over all that is there, then over a closing row far beyond the last event, so that nothing waits."""
    place = scratch_path(t.spark, "settled")
    rows, _ = run(place)
    last = t.events.agg(F.max("ts")).first()[0]
    if last is not None:
        watermarked.close_streams(t.spark, place, last + timedelta(days=7300))
        rows, _ = run(place)
    return rows


_EXPIRY = """
  SELECT e.user_id, e.event_id AS id, coalesce(epoch_us(e.ts) - (SELECT max(epoch_us(l.ts)) FROM events l WHERE l.event_type = 'signup' AND l.user_id = e.user_id AND l.ts <= e.ts) < 86400000000, false) AS valid FROM events e"""


@query("st3_session_expiry", _EXPIRY)
def _(t):
    return feeds.valid_sessions(t.events.filter("event_type = 'signup'"), t.events)


@query("st3_session_join", _EXPIRY)
def _(t):
    events = feeds.event_stream(t.spark, t.folder).withColumnRenamed("event_id", "id")
    logins = feeds.event_stream(t.spark, t.folder).filter("event_type = 'signup'")
    return _over(t, lambda place: watermarked.session_checks(logins, events, 24, "3650 days", place))


@query("st3_session_windows", """
  WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(t):
    return feeds.session_stream(feeds.event_stream(t.spark, t.folder))


@query("st4_one_open_request", """
  SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn FROM consultation_requests WHERE status = 'Pending') WHERE rn = 1""")
def _(t):
    return feeds.request_stream(feeds.derived_stream(t.spark, t.folder, "consultation_requests"))


@query("st4_users_with_request", "SELECT DISTINCT user_id FROM consultation_requests WHERE status = 'Pending'")
def _(t):
    """Which of several requests is the open one follows the order of arrival; that a user has one does not."""
    requests = feeds.derived_stream(t.spark, t.folder, "consultation_requests").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return watermarked.accepted_requests(requests, "3650 days")[0].select("user_id")


_SKILLS = """
  WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, skill_name ORDER BY created_at DESC, id DESC) AS rn FROM skill_search_history) WHERE rn = 1)
  SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(s.skill_name, n.skill_name) AS skill_name, coalesce(n.level, s.level) AS level, coalesce(s.progress, 10) AS progress,
    epoch_us(coalesce(n.created_at, s.updated_at)) AS updated_us FROM user_skills s FULL JOIN n ON s.user_id = n.user_id AND s.skill_name = n.skill_name"""


@query("st5_skill_upsert", _SKILLS)
def _(t):
    out = feeds.skill_stream(t.user_skills, feeds.derived_stream(t.spark, t.folder, "skill_search_history"))
    return out.select("user_id", "skill_name", "level", F.col("progress").cast("long").alias("progress"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query("st5_skill_snapshot", _SKILLS)
def _(t):
    out = snapshots.skill_snapshot(t.user_skills, feeds.derived_stream(t.spark, t.folder, "skill_search_history"))
    return out.select("user_id", "skill_name", "level", F.col("progress").cast("long").alias("progress"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


_PROFILES = """
  WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM job_search_history) WHERE rn = 1)
  SELECT coalesce(p.user_id, n.user_id) AS user_id, coalesce(n.age, p.age) AS age, coalesce(n.domain, p.preferred_domain) AS preferred_domain, p.primary_skill, n.work_mode AS work_mode_preference
  FROM user_profiles p FULL JOIN n ON p.user_id = n.user_id"""


@query("st6_profile_upsert", _PROFILES)
def _(t):
    return feeds.profile_stream(t.user_profiles, feeds.derived_stream(t.spark, t.folder, "job_search_history"))


@query("st6_profile_snapshot", _PROFILES)
def _(t):
    return snapshots.profile_snapshot(t.user_profiles, feeds.derived_stream(t.spark, t.folder, "job_search_history"))


_STATES = {"application": lexicon.APPLICATION_STATES, "request": lexicon.CALL_STATES, "organisation": lexicon.ORGANISATION_STATES}
_VALID = " OR ".join("(kind = '{}' AND status IN ({}))".format(k, ", ".join(f"'{x}'" for x in v)) for k, v in _STATES.items())


@query("st7_status_changes", f"""
  SELECT kind, entity_id, status FROM (SELECT *, row_number() OVER (PARTITION BY kind, entity_id ORDER BY changed_at DESC NULLS LAST, id DESC, status DESC) AS rn
    FROM status_changes WHERE {_VALID}) WHERE rn = 1""")
def _(t):
    return feeds.status_stream(feeds.derived_stream(t.spark, t.folder, "status_changes"), _STATES).select("kind", "entity_id", "status")


@query("st8_cascading_delete", """
  WITH r AS (SELECT id FROM organizations WHERE status = 'Declined'), gone AS (SELECT id FROM organization_jobs WHERE org_id IN (SELECT id FROM r))
  SELECT 'jobs' AS kind, count(*) AS n FROM organization_jobs WHERE org_id NOT IN (SELECT id FROM r) UNION ALL SELECT 'applications', count(*) FROM job_applications WHERE job_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'courses', count(*) FROM training_courses WHERE org_id NOT IN (SELECT id FROM r)""")
def _(t):
    jobs, applications, courses = feeds.cascade_delete(t.organizations.filter("status = 'Declined'"), t.organization_jobs, t.job_applications, t.training_courses)
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in (("jobs", jobs), ("applications", applications), ("courses", courses))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


_DAILY = """
  SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) * 86400000000 AS day_us, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2, 3"""


@query("st9_daily_counts", _DAILY)
def _(t):
    return feeds.daily_stream(feeds.event_stream(t.spark, t.folder).filter(F.col("event_type").isin("view", "purchase")))


@query("st9_closed_days", _DAILY)
def _(t):
    events = feeds.event_stream(t.spark, t.folder).filter(F.col("event_type").isin("view", "purchase"))
    return _over(t, lambda place: watermarked.closed_daily_counts(events, "3650 days", place))
