"""Text vectors, retrieval, income ranges and tiered job lists."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.operators import requests as asks
from workloom.operators.ranking import top_per_key
from workloom.plans import sqlparts as s
from workloom.plans.registry import check_view, query
from workloom.text import tfidf
from workloom.text.matches import matches, ranked_matches

_STOP = ", ".join(s.q(w) for w in lexicon.STOP_WORDS)


def _tf(view, doc, text):
    return f"""SELECT {doc}, term, count(*) AS tf FROM (SELECT {doc}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {view})
      WHERE term NOT IN ({_STOP}) GROUP BY {doc}, term"""


def _vec(tf, doc, vocab):
    return f"""SELECT {doc}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {doc})) AS weight FROM (SELECT {doc}, f.term, tf * idf AS w FROM {tf} f JOIN {vocab} v ON f.term = v.term)"""


check_view("doc_tf", _tf("documents", "doc_id", "text"))
check_view("doc_vocab", """SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0e0 + count(*))) + 1 AS idf FROM doc_tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000""")
check_view("doc_vec", _vec("doc_tf", "doc_id", "doc_vocab"))
check_view("item_tf", _tf("benchmark", "item_id", "text"))
check_view("item_vec", _vec("item_tf", "item_id", "doc_vocab"))
check_view("item_scores", "SELECT item_id, doc_id, sum(a.weight * b.weight) AS score FROM item_vec a JOIN doc_vec b ON a.term = b.term GROUP BY item_id, doc_id")


def _scores(t):
    counts = tfidf.term_counts(t.documents, "doc_id", "text")
    vocab = tfidf.vocabulary(counts, t.documents.count(), 1000)
    items = tfidf.vectors(tfidf.term_counts(t.benchmark, "item_id", "text"), vocab, "item_id")
    return tfidf.cosine(items, tfidf.vectors(counts, vocab, "doc_id"), "item_id", "doc_id")


@query("ml1_tfidf", "SELECT doc_id, term, round(weight, 6) AS weight FROM doc_vec")
def _(t):
    _, out = tfidf.fit_vectors(t.documents, "doc_id", "text")
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_TITLES = """SELECT profile_id, term, count(*) AS tf FROM (SELECT profile_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
    FROM (SELECT profile_id, list_filter(regexp_extract_all(lower(job_title), '[\\p{L}\\p{N}_]{2,}'), lambda x: x NOT IN (""" + _STOP + """)) AS w FROM profiles)) GROUP BY profile_id, term"""


@query("ml1_title_bigrams", f"""
  WITH tf AS ({_TITLES}), n AS (SELECT count(*) AS n FROM profiles),
  vocab AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1.0e0 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.95e0 * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT 50)
  SELECT profile_id, term, round(weight, 6) AS weight FROM ({_vec('tf', 'profile_id', 'vocab')})""")
def _(t):
    _, out = tfidf.fit_vectors(t.profiles, "profile_id", "job_title", 50, (1, 2), 3, 0.95)
    return out.select("profile_id", "term", F.round("weight", 6).alias("weight"))


@query("jo4_sparse_dot_product", "SELECT item_id, doc_id, round(score, 6) AS score FROM item_scores")
def _(t):
    return _scores(t).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("fi8_similarity_threshold", "SELECT item_id, doc_id FROM item_scores WHERE round(score, 6) > 0.02")
def _(t):
    return _scores(t).filter(F.round("score", 6) > 0.02).select("item_id", "doc_id")


_TOP3 = """SELECT item_id, doc_id, rank, score FROM (SELECT item_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank FROM item_scores) WHERE rank <= 3"""


def _top3(t):
    scored = _scores(t).withColumn("score", F.round("score", 6))
    return top_per_key(scored, ["item_id"], [F.desc("score"), "doc_id"], 3, "rank").select("item_id", "doc_id", "rank", "score")


@query("ml2_cosine_top_k", _TOP3)
def _(t):
    return _top3(t)


@query("wi10_top_three", "SELECT item_id, doc_id, rank FROM (" + _TOP3 + ")")
def _(t):
    return _top3(t).drop("score")


# --- profiles against postings -------------------------------------------------
_ROW = "lower(domain || ' | ' || sector || ' | ' || primary_skill || ' | ' || job_title || ' | ' || coalesce(all_skills, ''))"
check_view("row_texts", f"SELECT profile_id, {_ROW} AS row_text FROM profiles")
check_view("row_tf", _tf("row_texts", "profile_id", "row_text"))
check_view("row_vocab", "SELECT term, ln((1 + (SELECT count(*) FROM profiles)) / (1.0e0 + count(*))) + 1 AS idf FROM row_tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000")
check_view("seek_texts", "SELECT user_id, preferred_domain || ' ' || primary_skill || ' ' || secondary_skill AS seek FROM user_profiles")
check_view("seek_tf", _tf("seek_texts", "user_id", "seek"))
check_view("open_texts", "SELECT id, title || ' ' || description || ' ' || requirements AS body FROM organization_jobs WHERE is_active")
check_view("open_tf", _tf("open_texts", "id", "body"))
check_view("job_matches", f"""SELECT user_id, id, CAST(trunc(round(score, 6) * 100) AS INT) AS match_score FROM (SELECT user_id, id, sum(a.weight * b.weight) AS score FROM ({_vec('seek_tf', 'user_id', 'row_vocab')}) a
    JOIN ({_vec('open_tf', 'id', 'row_vocab')}) b ON a.term = b.term GROUP BY user_id, id) WHERE round(score, 6) > 0.02""")


def _seek_and_jobs(t):
    rows = t.profiles.select("profile_id", F.concat_ws(" | ", "domain", "sector", "primary_skill", "job_title", F.coalesce("all_skills", F.lit(""))).alias("text"))
    vocab = tfidf.vocabulary(tfidf.term_counts(rows, "profile_id", "text"), rows.count(), 1000)
    seek = t.user_profiles.select("user_id", F.concat_ws(" ", "preferred_domain", "primary_skill", "secondary_skill").alias("text"))
    jobs = t.organization_jobs.filter("is_active").select("id", F.concat_ws(" ", "title", "description", "requirements").alias("text"))
    return (tfidf.vectors(tfidf.term_counts(seek, "user_id", "text"), vocab, "user_id"),
            tfidf.vectors(tfidf.term_counts(jobs, "id", "text"), vocab, "id"))


@query("ml3_profile_matching", "SELECT user_id, id, match_score FROM job_matches")
def _(t):
    return matches(*_seek_and_jobs(t), "user_id", "id")


@query("ml3_keyword_fallback", """
  WITH s AS (SELECT user_id, list_filter([preferred_domain, primary_skill], lambda x: x IS NOT NULL AND x <> '' AND x <> 'General') AS stated FROM user_profiles),
  u AS (SELECT user_id, unnest(CASE WHEN len(stated) = 0 THEN [''] ELSE list_transform(stated, lambda x: lower(x)) END) AS term FROM s)
  SELECT DISTINCT u.user_id, j.id, 50 AS match_score FROM u
  JOIN (SELECT id, lower(concat_ws(' ', title, description, requirements)) AS body FROM organization_jobs WHERE is_active) j ON u.term = '' OR strpos(j.body, u.term) > 0""")
def _(t):
    return asks.keyword_matches(t.user_profiles, t.organization_jobs.filter("is_active"))


@query("wi11_ranked_matches", """
  SELECT user_id, id, match_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, id) AS INT) AS rank FROM job_matches""")
def _(t):
    return ranked_matches(*_seek_and_jobs(t), "user_id", "id")


# --- requests ------------------------------------------------------------------
check_view("range_candidates", """
  WITH r AS (SELECT request_id, lower(skill) AS skill, hours, level FROM requests), p AS (SELECT lower(primary_skill) AS skill, domain, hours_available AS hh, income FROM profiles),
  e AS (SELECT r.request_id, p.* FROM r JOIN p ON p.skill = r.skill),
  r2 AS (SELECT * FROM r WHERE request_id NOT IN (SELECT request_id FROM e)),
  c AS (SELECT r2.request_id, p.* FROM r2 JOIN p ON strpos(p.skill, r2.skill) > 0),
  r3 AS (SELECT * FROM r2 WHERE request_id NOT IN (SELECT request_id FROM c)),
  g AS (SELECT request_id, domain FROM (SELECT request_id, domain, row_number() OVER (PARTITION BY request_id ORDER BY count(*) DESC, domain) AS rn
      FROM r3 JOIN p ON strpos(p.skill, string_split(r3.skill, ' ')[1]) > 0 GROUP BY request_id, domain) WHERE rn = 1),
  d AS (SELECT g.request_id, p.* FROM g JOIN p ON lower(p.domain) = lower(g.domain)),
  a AS (SELECT r3.request_id, p.* FROM r3 JOIN p ON r3.request_id NOT IN (SELECT request_id FROM d))
  SELECT x.*, r.hours, r.level, hh >= greatest(1, hours - 1) AND hh <= least(6, hours + 1) AS near FROM (SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM a) x JOIN r ON x.request_id = r.request_id""")
_RANGES = """
  SELECT request_id, CAST(coalesce(low, 7000) AS BIGINT) AS low, CAST(coalesce(CASE WHEN low = high THEN low + 1000 ELSE high END, 15000) AS BIGINT) AS high
  FROM requests LEFT JOIN (
    SELECT request_id, floor(floor(lo * CASE level WHEN 'Intermediate' THEN 1.10e0 WHEN 'Advanced' THEN 1.20e0 ELSE 1 END) / 500) * 500 AS low,
      floor(floor(hi * CASE level WHEN 'Intermediate' THEN 1.15e0 WHEN 'Advanced' THEN 1.30e0 ELSE 1 END) / 500) * 500 AS high
    FROM (SELECT request_id, level, floor(quantile_cont(CAST(trunc(income) AS BIGINT), 0.35)) AS lo, floor(quantile_cont(CAST(trunc(income) AS BIGINT), 0.85)) AS hi
      FROM (SELECT *, max(CAST(coalesce(near, false) AS INT)) OVER (PARTITION BY request_id) AS any_near FROM range_candidates) WHERE income IS NOT NULL AND (any_near = 0 OR near) GROUP BY request_id, level)) USING (request_id)"""


@query("ag9_income_range", _RANGES)
def _(t):
    return asks.income_ranges(t.requests, t.profiles)


@query("fi6_hours_window", """
  WITH a AS (SELECT DISTINCT CAST(hours AS BIGINT) AS hours FROM requests),
  near AS (SELECT hours, profile_id, hours_available FROM a JOIN profiles ON hours_available BETWEEN greatest(1, hours - 1) AND least(6, hours + 1)),
  x AS (SELECT * FROM near UNION ALL SELECT hours, profile_id, hours_available FROM a JOIN profiles ON hours NOT IN (SELECT hours FROM near))
  SELECT hours, profile_id, hours_available, count(*) OVER (PARTITION BY hours) AS n FROM x""")
def _(t):
    return asks.hours_windows(t.requests, t.profiles)


_TIERED = """
  WITH j AS (SELECT profile_id, lower(domain) AS d, lower(sector) AS s, lower(primary_skill) AS k, lower(work_mode) AS m, lower(work_type) AS y FROM profiles),
  c AS (SELECT request_id, profile_id, CASE WHEN strpos(d, lower(r.domain)) > 0 THEN 1 WHEN strpos(s, lower(r.sector)) > 0 THEN 2 ELSE 3 END AS tier,
      CASE WHEN strpos(m, lower(r.work_mode)) > 0 THEN 2 ELSE 0 END + CASE WHEN strpos(y, lower(r.work_type)) > 0 THEN 1 ELSE 0 END AS relevance
    FROM seekers r JOIN j ON strpos(d, lower(r.domain)) > 0 OR strpos(s, lower(r.sector)) > 0 OR strpos(k, lower(r.primary_skill)) > 0),
  n AS (SELECT *, count(*) FILTER (tier = 1) OVER (PARTITION BY request_id) AS n1, count(*) FILTER (tier <= 2) OVER (PARTITION BY request_id) AS n2 FROM c)
  SELECT request_id, profile_id, relevance, rank FROM (SELECT request_id, profile_id, relevance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, profile_id) AS INT) AS rank
    FROM n WHERE tier = 1 OR (tier = 2 AND n1 < 10) OR (tier = 3 AND n1 < 10 AND n2 < 10)) WHERE rank <= 10"""


@query("ml4_tiered_jobs", _TIERED)
def _(t):
    return asks.tiered_jobs(t.seekers, t.profiles)


@query("wi12_relevance_top_ten", "SELECT request_id, sum(relevance)::BIGINT AS relevance, count(*) AS jobs FROM (" + _TIERED.strip() + ") GROUP BY request_id")
def _(t):
    return asks.tiered_jobs(t.seekers, t.profiles).groupBy("request_id").agg(F.sum("relevance").alias("relevance"), F.count(F.lit(1)).alias("jobs"))
