"""Token counts from an exact histogram of encoded lengths.

Every document is encoded once; what is kept is its number of tokens. Documents are aggregated by
length, and sums from the long end answer, for every context limit L at which anything changes:
how many documents are longer, how many tokens there are, and how many remain if every document is
truncated at L. Quantiles are read from the running counts. Between two lengths of the table all
answers are linear in L, so the table answers every limit.
"""

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the published rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths per block of the two-level sums.
BLOCK = 1024

_ENCODERS = {}


def read_ranks(path):
    """Byte sequences and their ranks from a rank file on the driver (some MB at most)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(name, ranks, pattern):
    if name not in _ENCODERS:
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_length(spark, vocabulary=VOCABULARY, pattern=PATTERN):
    """A column function: number of tokens of a text, 0 for null. The vocabulary is broadcast, tasks read no local file."""
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        encode = _encoder(vocabulary, ranks.value, pattern).encode_ordinary
        return pa.array([len(encode(text)) if text else 0 for text in (x.as_py() for x in column)], pa.int64())

    return count.asNondeterministic()


def length_histogram(docs, length):
    """``length, n_docs``: documents by encoded length."""
    return docs.select(length.alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram, block=BLOCK):
    """For every length that occurs, taken as a context limit:

    ``n_docs`` documents of this length, ``docs_upto`` not longer, ``docs_longer`` longer,
    ``tokens_upto`` tokens of the documents not longer, ``tokens_truncated`` tokens that remain if every
    document is cut at this limit, ``share_upto`` the quantile of the limit.

    Sums are taken within blocks of lengths and over the blocks' totals, so that no window holds more
    than one block or one row per block. An empty histogram gives an empty table.
    """
    base = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / block).alias("block"))
    blocks = base.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = blocks.select("block", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
                           F.sum("bd").over(everything).alias("all_docs"))
    inside = Window.partitionBy("block").orderBy("length")
    out = base.withColumns({"d1": F.sum("n_docs").over(inside), "t1": F.sum("tokens").over(inside)}).join(starts, "block")
    upto, tokens = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    return out.select("length", "n_docs", upto.alias("docs_upto"), (F.col("all_docs") - upto).alias("docs_longer"), tokens.alias("tokens_upto"),
                      (tokens + (F.col("all_docs") - upto) * F.col("length")).alias("tokens_truncated"), (upto / F.col("all_docs")).alias("share_upto"))


def truncated_total(table, limit):
    """Tokens that remain at any limit: a one-row DataFrame ``tokens``."""
    below = F.col("length") <= limit
    all_ = table.agg(F.max_by(F.when(below, F.struct("tokens_upto", "docs_longer")), F.when(below, F.col("length"))).alias("b"), F.sum("n_docs").alias("n"))
    return all_.select(F.coalesce(F.col("b.tokens_upto") + F.col("b.docs_longer") * limit, F.col("n") * limit, F.lit(0)).cast("long").alias("tokens"))


def quantile(table, share):
    """The smallest length that at least ``share`` of the documents do not exceed: a one-row DataFrame ``length``."""
    return table.filter(F.col("share_upto") >= share).agg(F.min("length").alias("length"))
