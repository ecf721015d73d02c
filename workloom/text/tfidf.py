"""TF-IDF vectors as long tables (document, term, weight), and cosine retrieval over them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom import lexicon
from workloom.session import spread, written

TOKEN = r"[\p{L}\p{N}_]{2,}"
BROADCAST_ROWS = 500_000


def tokens(text, stop_words=lexicon.STOP_WORDS):
    """Lower-case words of two and more characters without stop words, over the whole text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if not stop_words:
        return words
    stops = F.lit(list(stop_words))
    return F.filter(words, lambda w: ~F.array_contains(stops, w))


def _runs(words, n):
    """All runs of ``n`` neighbouring words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _grams(words, ngrams):
    parts = [words if n == 1 else _runs(words, n) for n in range(ngrams[0], ngrams[1] + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def term_counts(docs, doc_id, text, ngrams=(1, 1), stop_words=lexicon.STOP_WORDS):
    """(document, term, tf). Documents are spread by id before they are split into words, so
    counting the words of a document needs no further shuffle."""
    placed = spread(docs.select(doc_id, F.col(text).alias("__text")), doc_id)
    single = ngrams == (1, 1)
    # Single words are dropped after the split, where the stop list is one hash lookup; runs of
    # words have to be formed without stop words, so there the list is applied before.
    words = placed.select(doc_id, tokens(F.col("__text"), () if single else stop_words).alias("__w"))
    terms = words.select(doc_id, F.explode(_grams(F.col("__w"), ngrams)).alias("term"))
    if single and stop_words:
        terms = terms.filter(~F.col("term").isin(list(stop_words)))
    return (terms
            .groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(counts, n_docs, max_features, min_df=1, max_df=1.0):
    """The most frequent terms with their idf; ties in frequency go by term.

    At most ``max_features`` rows, so it is safe to broadcast. It is stored, because corpus and
    queries read it and would otherwise count the corpus again each.
    """
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    fit = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return written(fit.orderBy(F.desc("total"), "term").limit(max_features)
                   .select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")


def vectors(counts, vocab, doc_id):
    """Weights tf * idf, scaled to unit length per document."""
    weighted = counts.join(F.broadcast(vocab), "term").select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("__w"))
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(doc_id)))
    return weighted.select(doc_id, "term", (F.col("__w") / length).alias("weight"))


def fit_vectors(docs, doc_id, text, max_features=1000, ngrams=(1, 1), min_df=1, max_df=1.0, stop_words=lexicon.STOP_WORDS):
    """Vocabulary and vectors of one corpus."""
    counts = term_counts(docs, doc_id, text, ngrams, stop_words)
    vocab = vocabulary(counts, docs.count(), max_features, min_df, max_df)
    return vocab, vectors(counts, vocab, doc_id)


def broadcast_if_small(df, rows=BROADCAST_ROWS):
    """Broadcast hint only after counting that at most ``rows`` rows would be sent."""
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def cosine(left, right, left_id, right_id):
    """Similarity of every pair with a shared term.

    With a small left side the right side stays where it is: it is spread by document, and
    so are the pairs. Otherwise both sides meet on the term.
    """
    l = broadcast_if_small(left.select(left_id, "term", F.col("weight").alias("__l")))
    r = right.select(right_id, "term", F.col("weight").alias("__r"))
    return r.join(l, "term").groupBy(right_id, left_id).agg(F.sum(F.col("__l") * F.col("__r")).alias("score"))
