"""The pipeline against its parts, stage by stage, and on odd tables."""

import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, brute_hits, prose

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_neardup", "decontamination", "source_mixing"]


def test_benchmark_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, FOLDER).collect()}
    for r in docs.collect():
        n, hit, _ = brute_hits(r.text, items)
        assert (r.doc_id in kept) == (not (hit > 0 and 20 * hit >= n))


def test_line_stage(spark):
    rows = [(i, f"head\nbody {i}", "en", "s", 9) for i in range(30)] + [(50, "head", "en", "s", 4), (51, None, "en", "s", 0), (52, "", None, None, 0)]
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, DOCS), FOLDER).collect()}
    assert set(got) == {*range(30), 51, 52} and got[7].text == "body 7" and got[7].n_chars == 6 and got[51].text is None


@pytest.mark.parametrize("few", [200_000, 0])
def test_line_stage_finds_passages_of_a_hot_source(spark, monkeypatch, few):
    from workloom.llm import sitelines
    monkeypatch.setattr(sitelines, "BROADCAST_LINES", few)
    passage, copied = "the same passage of a good many words stands here", " ".join(prose(1, 300))
    rows = [(i, "\n".join([" ".join(prose(1000 + i, 12)), *[passage] * (i < 24)]), "en", "hot", 9) for i in range(1500)]
    rows += [(5000 + i, "\n".join([" ".join(prose(3000 + i, 12)), passage, "short"]), "en", f"s{i}", 9) for i in range(4)]
    # Near copies and exact copies are one document each, in sources of which they are a small share.
    rows += [(6000 + i, f"{copied}\n{copied[:90]}\nend {i % 15}", "en", "hot", 9) for i in range(29)]
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, DOCS).repartition(4), FOLDER).collect()}
    assert len(got) == len(rows) and not any(passage in r.text for r in got.values())
    before = {r[0]: r[1] for r in rows}
    assert all(got[i].text == before[i].replace(f"\n{passage}", "") for i in got) and got[3].n_chars == len(got[3].text)


def test_near_duplicate_stage(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (3, "other words", "en", "s", 1), (3, "other words", "en", "s", 1),
            (None, "a b c d e f", "en", "s", 1), (None, None, "en", "s", 1), (4, None, "en", "s", 1), (5, "", "en", "s", 1)]
    got = dict(corpus_pipeline.STAGES)["minhash_neardup"](spark, spark.createDataFrame(rows, DOCS), FOLDER).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "5", "None", "None"]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", "en", None, 3)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("mix", F.lit(1)).withColumn("found", F.lit(1)).withColumn("statistics", F.lit(1)).withColumn("a`b", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() <= len(rows)


def test_whole_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*COLUMNS, "size", "copies", "taken"]
    rows = out.collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows and len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= ids
    assert all(0 < r.taken == r.copies * r.size <= 2 * r.size for r in rows)
