"""Stages of the corpus pipeline. Each takes (spark, docs, folder) and works on all documents it gets."""

from pyspark.sql import functions as F

from workloom.llm.decontaminate import contamination, find_benchmark_text
from workloom.llm.mixing import mix_sources
from workloom.llm.neardup import near_duplicates
from workloom.llm.quality import CUT, bounded_labels, fit_rules, with_statistics
from workloom.llm.scratch import Scratch
from workloom.llm.sitelines import drop_site_lines, text_lines

#: Scores, thresholds from hashes and near-duplicate classes have no SQL form.
ORACLE_SQL = None


def _renamed(docs):
    """``docs`` with its columns called c0, c1, ..., so that no name clashes with what a stage adds, and the names
    of the columns of that table by the original ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _original(df, names, **made):
    """The columns of a stage's input under their own names; ``made`` replaces some."""
    return df.select(*[made.get(c, F.col(n)).alias(c) for c, n in names.items()])


def quality_stage(spark, docs, folder):
    """Drops documents whose quality score is below the cut. Learns from labelled rows outside the held-out fifth.

    Only the labelled rows that the fit uses are measured for it; every document is measured once, for its score.
    """
    scratch = Scratch(spark, "quality-stage")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    marks = bounded_labels(spark.read.parquet(f"{folder}/labels.parquet"), learn, scratch)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = with_statistics(texts.join(F.broadcast(marks), "doc_id")).select("doc_id", "statistics", "label")
    score = fit_rules(scratch.keep(labelled, "labelled"), scratch)
    plain, names = _renamed(docs)
    return _original(with_statistics(plain, text=names["text"]).filter(score.column() >= CUT), names)


def line_stage(spark, docs, folder):
    """Drops lines that many documents of the same source share, and long lines that many different documents of
    any sources share; a document without any line left goes.

    Documents without text stay as they are: no line of theirs was dropped.
    """
    plain, names = _renamed(docs)
    before = F.col(names["text"]).cast("string")
    cleaned = drop_site_lines(plain, text_lines(before), F.col(names["source"]), everywhere=before)
    changed = F.col("cleaned.n_dropped") > 0
    kept = cleaned.filter(~changed | F.col("cleaned.text").rlike(r"\S"))
    made = {"text": F.when(changed, F.col("cleaned.text")).otherwise(F.col(names["text"]))}
    if "n_chars" in names:
        made["n_chars"] = F.when(changed, F.length("cleaned.text").cast("long")).otherwise(F.col(names["n_chars"]))
    return _original(kept, names, **made)


def near_duplicate_stage(spark, docs, folder):
    """One document of each near-duplicate class stays, the one with the smallest id.

    Rows that repeat an id stay as long as their texts differ; of rows equal in id and text, one stays. Rows
    without an id cannot be linked and stay.
    """
    plain, names = _renamed(docs)
    id_, text = names["doc_id"], names["text"]
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    plain = plain.join(gone, F.col(id_) == F.col("gone"), "left_anti")
    again = Scratch(spark, "neardup-stage").keep(
        plain.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again"), "again")
    if again.isEmpty():
        return _original(plain, names)
    once = plain.join(again, F.col(id_) == F.col("again"), "left_anti")
    return _original(once.union(plain.join(again, F.col(id_) == F.col("again"), "left_semi").dropDuplicates([id_, text])), names)


def benchmark_stage(spark, docs, folder):
    """Drops documents of which a twentieth or more of the words are benchmark text."""
    plain, names = _renamed(docs)
    found = find_benchmark_text(plain, spark.read.parquet(f"{folder}/benchmark.parquet"), text=names["text"])
    return _original(found.filter(~contamination(F.col("found"))["contaminated"]), names)


def mixing_stage(spark, docs, folder):
    """The mix: every document that is taken, with the number of its copies."""
    plain, names = _renamed(docs)
    taken = mix_sources(plain, doc_id=names["doc_id"], text=names["text"], source=names["source"]).filter("mix.taken > 0")
    clash = {"size", "copies", "taken"}
    return taken.select(*[F.col(n).alias(c) for c, n in names.items() if c not in clash], "mix.size", "mix.copies", "mix.taken")


STAGES = [
    ("quality_rules", quality_stage), ("line_dedup", line_stage), ("minhash_neardup", near_duplicate_stage),
    ("decontamination", benchmark_stage), ("source_mixing", mixing_stage),
]


def run(spark, folder):
    """All stages over the whole documents table, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
