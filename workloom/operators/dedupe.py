"""Duplicate removal: exact rows, keys, near-duplicate spellings, pay-only differences."""

from difflib import SequenceMatcher
from math import floor

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workloom import lexicon
from workloom.functions.text import comparable
from workloom.operators.ranking import first_per_key
from workloom.session import written

TITLE_THRESHOLD = 0.8
COMPANY_THRESHOLD = 0.9


def drop_same_rows(df):
    return df.dropDuplicates()


def key_columns(df):
    return [c for c in lexicon.DUPLICATE_KEYS if c in df.columns]


def drop_same_keys(df, row_id="row_id"):
    """First row of every title / company / location combination; nulls equal nulls."""
    return first_per_key(df, key_columns(df), [row_id])


def drop_pay_duplicates(df, core, pay_columns, row_id="row_id"):
    """Per core key the row with the most pay fields; rows with a null core key vanish."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in pay_columns), F.lit(0))
    keyed = df.dropna(subset=core).withColumn("__filled", filled)
    return first_per_key(keyed, core, [F.desc("__filled"), row_id]).drop("__filled")


# --- near duplicates -----------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; there is no built-in for it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _grams(values):
    """Distinct padded bigrams of every value, repeats numbered so that they stay distinct."""
    padded = F.concat(F.lit("\u0002"), F.col("value"), F.lit("\u0003"))
    grams = values.select("value", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2)))).alias("at", "raw"))
    return grams.select("value", F.concat("raw", F.size(F.filter(
        F.transform(F.sequence(F.lit(1), F.col("at") + 1), lambda i: padded.substr(i, F.lit(2))),
        lambda g: g == F.col("raw"))).cast("string")).alias("gram"))


def _split_grams(prefix):
    """Both sides of the self join on grams. The pairs of a gram with more than a task's share of all pairs
    are split: its left texts are dealt by hash over ``parts``, its right texts go to each."""
    tasks = int(prefix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = prefix.groupBy("gram").agg(F.pow(F.count(F.lit(1)), F.lit(2.0)).alias("pairs"))
    total = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
    parts = F.ceil(F.col("pairs") * tasks / F.lit(max(total, 1.0))).cast("int")
    hot = F.broadcast(pairs.select("gram", parts.alias("parts")).filter("parts > 1"))  # fewer than ``tasks`` rows
    split = prefix.join(hot, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = split.select(F.col("value").alias("left"), F.col("n").alias("m"), "gram", F.pmod(F.xxhash64("value"), F.col("parts").cast("long")).cast("int").alias("part"))
    right = split.select(F.col("value").alias("right"), "n", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left, right


def similar_pairs(values, threshold, shared=4):
    """Ordered pairs (left, right) of distinct texts with ``ratio(left, right) >= threshold``.

    Candidates come from a prefix filter that loses nothing. A ratio of t between texts of
    length m and n leaves at most (1-t)(m+n) characters unmatched; each breaks at most two
    bigrams on its own side and one on the other. Partners therefore share at least
    ``(1.5t-1)(m+n) + 1`` bigrams, and ``s`` of them lie among the ``4(1-t)/(2-t)*m + s``
    rarest of either text. Counting shared rare bigrams, then the length and edit distance
    bounds that the ratio implies, leaves few pairs for the Python similarity.
    """
    values = values.filter("value <> ''").select("value").distinct()
    grams = _grams(values)
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    share = 4 * (1 - threshold) / (2 - threshold)
    ranked = (grams.join(rarity, "gram").groupBy("value")
              .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams")))
    prefix = ranked.select("value", F.length("value").alias("n"), F.explode(F.slice(
        F.col("grams.gram"), F.lit(1), F.floor(F.length("value") * share + 1e-9).cast("int") + shared)).alias("gram"))
    prefix = written(prefix, "gram-prefix")
    left, right = _split_grams(prefix)
    span = threshold / (2 - threshold)
    both = F.col("m") + F.col("n")
    enough = F.least(F.lit(shared), F.floor((1.5 * threshold - 1) * both - 1e-9).cast("int") + 1)
    room = F.floor((1 - threshold) * both + 1e-9).cast("int")
    pairs = (left.join(right, ["gram", "part"])
             .filter((F.col("left") != F.col("right")) & (F.col("m") >= span * F.col("n") - 1e-9)
                     & (F.col("n") >= span * F.col("m") - 1e-9))
             .groupBy("left", "right", "m", "n").agg(F.count(F.lit(1)).alias("hits"))
             .filter(F.col("hits") >= enough).select("left", "right", "m", "n"))
    # Written first: the tests below are costly per row and would otherwise run in the few
    # partitions that the small aggregate is merged into.
    pairs = written(pairs, "candidate-pairs").filter(F.levenshtein("left", "right") <= room)
    close = pairs.select("left", "right").filter(sequence_ratio("left", "right") >= threshold)
    return close.unionByName(values.select(F.col("value").alias("left"), F.col("value").alias("right")))


def fuzzy_survivors(df, title="job_title", company="company", row_id="row_id",
                    title_threshold=TITLE_THRESHOLD, company_threshold=COMPANY_THRESHOLD):
    """Rows that no earlier row resembles; every pair counts, there is no cap.

    Rows collapse to distinct (title, company) spellings first, so a spelling that holds a
    third of the table is one row afterwards. Similar titles and similar companies are found
    over their distinct values, then each spelling looks up its neighbours by equality.
    A row goes if an earlier row of a similar spelling exists, whether that one stays or not.
    Rows without a comparable title or company resemble nothing and stay.
    """
    keyed = df.withColumns({"__t": comparable(F.col(title)), "__c": comparable(F.col(company))})
    loose = keyed.filter((F.col("__t") == "") | (F.col("__c") == ""))
    firsts = (keyed.filter((F.col("__t") != "") & (F.col("__c") != ""))
              .groupBy("__t", "__c").agg(F.min(row_id).alias("__first")))
    # Read five times below; the written table also cuts the plan.
    firsts = written(firsts, "spellings")
    titles = similar_pairs(firsts.select(F.col("__t").alias("value")), title_threshold)
    companies = similar_pairs(firsts.select(F.col("__c").alias("value")), company_threshold)
    earlier = (firsts.select(F.col("__t").alias("left"), "__c", F.col("__first").alias("__earlier"))
               .join(titles, "left").select("__earlier", F.col("right").alias("__t"), F.col("__c").alias("left"))
               .join(companies, "left").select("__earlier", "__t", F.col("right").alias("__c")))
    beaten = (firsts.join(earlier, ["__t", "__c"]).filter(F.col("__earlier") < F.col("__first"))
              .select("__first").distinct())
    stay = firsts.join(beaten, "__first", "left_anti").select(F.col("__first").alias(row_id))
    ids = stay.unionByName(loose.select(row_id))
    return df.join(ids, row_id, "left_semi")


def with_removal_counts(df, exact, fuzzy, pay):
    return df.withColumns({"deduplication_date": F.lit(lexicon.PROCESSING_DATE), "exact_duplicates_removed": F.lit(exact),
                           "fuzzy_duplicates_removed": F.lit(fuzzy), "salary_duplicates_removed": F.lit(pay)})


def deduplicate(df, pay_columns, core=("job_title", "company", "location", "job_description"), row_id="row_id"):
    """Exact, fuzzy and pay-only removal in a row, with the counts of each as columns."""
    n0 = df.count()
    exact = written(drop_same_keys(df, row_id), "distinct-keys")
    n1 = exact.count()
    fuzzy = written(fuzzy_survivors(exact, row_id=row_id), "distinct-spellings")
    n2 = fuzzy.count()
    kept = drop_pay_duplicates(fuzzy, list(core), pay_columns, row_id)
    n3 = kept.count()
    return with_removal_counts(kept, n0 - n1, n1 - n2, n2 - n3)
