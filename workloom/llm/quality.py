"""Quality classifier: a sparse ensemble of rules over text statistics.

1. One Arrow function reads every text once and returns a few statistics (``STATISTICS``).
2. A small random forest is fitted on labelled rows; every path from a root becomes a conjunctive
   rule, such as "share of symbols > 0.2 and words > 12".
3. A logistic model with an L1 penalty weighs the rules; most weights become zero.
4. The rules that are left are compiled into one Spark column expression. Scoring runs no model.

The fit uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of the id; statistics and
scores cover every row.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from workloom.llm.textcore import PLAIN_WORD, lowered_slices, text_bytes, word_hashes

FIT_ROWS = 40_000
TREES, DEPTH, PENALTY, SEED = 12, 3, 0.001, 17
CUT = 0.3

STATISTICS = ["log_words", "word_length", "upper_share", "symbol_share", "pipe_share", "mark_share", "digit_share", "distinct_share",
              "top_word_share", "repeat_share", "wordless_share", "line_words", "line_repeat_share", "stop_share", "longest_word", "beyond_ascii_share"]
TYPE = "struct<" + ",".join(f"{name}:double" for name in STATISTICS) + ">"

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "high": range(128, 256), "pipe": b"|", "mark": b"!?", "digit": range(48, 58),
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "stop": b".", "lead": range(192, 256),
}


def _table(values):
    out = np.zeros(256, np.int8)
    out[list(values)] = 1
    return out


_TABLES = {name: _table(values) for name, values in _CLASSES.items()}


def text_statistics(column):
    """The statistics of every row of an Arrow string column; null and empty texts give zeros."""
    data, offsets, _ = text_bytes(column)
    parts = []
    for a, b, low, bounds, starts, ends, first, _ in lowered_slices(column, PLAIN_WORD):
        raw = data[offsets[a]:offsets[b]]

        def per_row(flags, at):
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        count = {name: per_row(table[raw], bounds) for name, table in _TABLES.items()}
        n = (first[1:] - first[:-1]).astype(float)
        some, size = np.maximum(n, 1), np.maximum((bounds[1:] - bounds[:-1]).astype(float), 1)
        letters = count["upper"] + count["lower"] + count["lead"]
        hashes = word_hashes(low, starts, ends)
        length = ends - starts
        word_letters = np.concatenate([[0], np.cumsum(_TABLES["lower"][low] | _TABLES["high"][low] | _TABLES["digit"][low], dtype=np.int64)])
        bare = (word_letters[ends] - word_letters[starts]) == 0
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.empty(0, bool)
        same[np.asarray(first[:-1])[n > 0]] = False  # the first word of a text follows none
        distinct, top, longest, lines, repeats = (np.zeros(b - a) for _ in range(5))
        for i in range(b - a):
            f, l = int(first[i]), int(first[i + 1])
            if l > f:
                _, times = np.unique(hashes[f:l], return_counts=True)
                distinct[i], top[i], longest[i] = len(times), times.max(), length[f:l].max()
            body = raw[bounds[i]:bounds[i + 1]].tobytes().split(b"\n")
            body = [x for x in body if x.strip()]
            lines[i] = max(1, len(body))
            repeats[i] = len(body) - len(set(body))
        parts.append(np.stack([
            np.log1p(n), per_row(length, np.asarray(first)) / some, count["upper"] / np.maximum(letters, 1), count["symbol"] / size, count["pipe"] / some,
            count["mark"] / some, count["digit"] / size, distinct / some, top / some, per_row(same, np.asarray(first)) / some,
            per_row(bare, np.asarray(first)) / some, n / lines, repeats / lines, count["stop"] / some, np.log1p(longest), count["high"] / size]))
    values = np.concatenate(parts, axis=1) if parts else np.zeros((len(STATISTICS), 0))
    return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in values], names=STATISTICS)


def with_statistics(docs, text="text", into="statistics"):
    """``docs`` with the struct ``into``."""
    @F.arrow_udf(TYPE)
    def measure(column: pa.Array) -> pa.Array:
        return text_statistics(column)

    return docs.withColumn(into, measure.asNondeterministic()(F.col(text).cast("string")))


def _paths(node, bounds, out):
    """Every path below the root: {statistic index: (above, at most)}."""
    if node.getClass().getSimpleName() != "InternalNode":
        return
    index, cut = node.split().featureIndex(), node.split().threshold()
    above, upto = bounds.get(index, (None, None))
    for child, limits in ((node.leftChild(), (above, cut if upto is None else min(cut, upto))),
                          (node.rightChild(), (cut if above is None else max(cut, above), upto))):
        here = bounds | {index: limits}
        out.add(tuple(sorted(here.items())))
        _paths(child, here, out)


def rule_column(rule, name="statistics"):
    """A rule as a Spark condition."""
    parts = []
    for index, (above, upto) in rule:
        value = F.col(f"{name}.{STATISTICS[index]}")
        parts += [value > F.lit(above)] if above is not None else []
        parts += [value <= F.lit(upto)] if upto is not None else []
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


class RuleScore:
    """Weighted rules; ``column`` compiles them."""

    def __init__(self, bias, rules):
        self.bias, self.rules = bias, rules  # rules: [(weight, rule)]

    def column(self, name="statistics"):
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            total = total + F.when(rule_column(rule, name), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def texts(self):
        """The rules in words, heaviest first."""
        said = []
        for weight, rule in sorted(self.rules, key=lambda r: (-abs(r[0]), str(r[1]))):
            parts = [f"{STATISTICS[i]} > {a:.4g}" for i, (a, _) in rule if a is not None] + [f"{STATISTICS[i]} <= {u:.4g}" for i, (_, u) in rule if u is not None]
            said.append(f"{weight:+.3f} if " + " and ".join(parts))
        return said


def fit_rules(labelled, scratch, trees=TREES, depth=DEPTH, penalty=PENALTY, rows=FIT_ROWS):
    """Fits the ensemble on ``doc_id, statistics, label`` (label 0.0 or 1.0).

    Without both labels the score is the share of label 1, or 0.5 without any label.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return RuleScore(50.0 * (2 * next(iter(counts)) - 1) if counts else 0.0, [])
    if total > rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(labelled.select("label", "statistics.*", "statistics"))
    vectors = scratch.keep(vectors.select("label", "features", "statistics").coalesce(8), "fit")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(vectors)
    found = set()
    for tree in forest.trees:
        _paths(tree._call_java("rootNode"), {}, found)
    rules = sorted(found, key=str)
    if not rules:
        return RuleScore(float(np.log(counts[1.0] / counts[0.0])), [])
    on = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        vectors.select("label", *[rule_column(rule).cast("double").alias(f"r{i}") for i, rule in enumerate(rules)]))
    on = scratch.keep(on.select("label", "features"), "rules")
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(on)
    weights = model.coefficients.toArray()
    return RuleScore(float(model.intercept), [(float(w), rule) for w, rule in zip(weights, rules, strict=True) if w != 0])


def labelled_statistics(measured, labels, learn, doc_id="doc_id", label="quality"):
    """Rows to learn from: ``learn`` is the condition on the id; null and other labels than 0 and 1 are left out."""
    marks = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("label")).filter("label IN (0.0, 1.0)")
    rows = measured.filter(learn).select(F.col(doc_id).alias("doc_id"), "statistics")
    return rows.join(marks, F.col("doc_id") == F.col("__id")).select("doc_id", "statistics", "label")


def bounded_labels(labels, learn, scratch, doc_id="doc_id", label="quality", rows=FIT_ROWS):
    """``doc_id, label``: about ``rows`` marks at most, chosen by a hash of the id, of those that ``labelled_statistics`` takes."""
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).filter("label IN (0.0, 1.0)").filter(learn)
    total = marks.count()
    if total > rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    return scratch.keep(marks, "marks")
