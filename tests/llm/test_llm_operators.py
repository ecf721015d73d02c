"""Edge cases and brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from workloom.llm.chat import format_chats
from workloom.llm.classes import connected_classes
from workloom.llm.decontaminate import contamination, find_benchmark_text
from workloom.llm import chat, knn
from workloom.llm.knn import top_k_inner_products
from workloom.llm.language import identify_languages
from workloom.llm.mixing import mix_sources, source_targets
from workloom.llm.neardup import least_matches, near_duplicates
from workloom.llm.quality import STATISTICS, fit_rules, labelled_statistics, with_statistics
from workloom.llm.scratch import Scratch
from workloom.llm.sitelines import drop_site_lines, html_lines, text_lines, url_host
from workloom.llm.tokencount import length_histogram, limit_table, quantile, token_length, truncated_total
from workloom.llm.warc import PIECES, _pieces, _range_sizes, _ranges, page_records, page_verdicts, read_records, write_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


# --- near duplicates -----------------------------------------------------------------------------

def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(texts):
    sets, parent = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def near_texts():
    base = prose(1, 200)
    texts = {0: None, 1: "", 2: " \t ", 3: "one two", 4: "ONE  two", 5: "one two three four five", 6: "one two"}
    draw = random.Random(7)
    # Copies that differ from the base by few words, and so from each other by about twice as many: the base is not the smallest.
    for k in range(10, 50):
        words = list(base)
        for at in draw.sample(range(200), 5):
            words[at] = f"x{k}{at}"
        texts[k] = " ".join(words)
    texts[60] = " ".join(base)
    # A passage that many documents share without being near duplicates.
    shared = prose(2, 60)
    for k in range(100, 140):
        texts[k] = " ".join(shared + prose(k, 25 + k % 40))
    for k in range(200, 205):
        texts[k] = " ".join(prose(3, 150)).upper()
    texts[300] = " ".join(prose(4, 30000))
    texts[301] = texts[300] + " more"
    return texts


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates(spark, block):
    texts = near_texts()
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    df = df.withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x"))
    rows = near_duplicates(df, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_classes(texts)


def test_near_duplicates_of_nothing_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(1, "a b c", "", "", 1), (1, "a b c", "", "", 1), (None, "a b c", "", "", 1), (2, "A B C", "", "", 1)], DOCS)).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]


def test_posterior_bound():
    plan = least_matches(336, 42, 0.75, 1e-6)
    assert plan[-1][0] == 336 and all(m < 0.75 * n for n, m in plan) and [m for _, m in plan] == sorted(m for _, m in plan)


def test_connected_classes(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 4000)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.comp for r in connected_classes(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1049] == 1000 and got[5000] == 4000


# --- language ------------------------------------------------------------------------------------

def test_language(spark):
    english, german = "the cat and the dog are in the house with her", "der hund und die katze sind in dem haus mit ihr"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", 1) for i in range(20)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "123 !!", None, 1), (103, "The Dog", None, 1), (104, "Die Katze " * 30000, None, 1), (105, "щука", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits int")
    got = {r.doc_id: r for r in identify_languages(df, F.col("doc_id") < 50).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert got[105].lang_pred in ("de", "en") and got[105].rejected and not got[1].rejected
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 26
    none = identify_languages(df, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == 26
    assert identify_languages(df.limit(0), F.lit(True)).count() == 0


def test_probabilities_sum_to_one(spark):
    from workloom.llm.language import BITS, _count, count_trigrams, kneser_ney, load_model
    texts = ["abra cadabra", "abba", "cab"]
    counts = count_trigrams(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"))
    model = load_model(["x"], kneser_ney(counts, ["x"], Scratch(spark, "t")))
    symbols = [ord(c) for c in "abrcd "]
    for a, b in (("a", "b"), ("b", "r"), ("d", "d"), ("q", "a")):
        codes = np.array([(ord(a) << 2 * BITS) | (ord(b) << BITS) | s for s in symbols] + [(ord(a) << 2 * BITS) | (ord(b) << BITS) | ord("z")])
        assert abs((2.0 ** model.logs(codes)).sum() - 1) < 1e-3
    assert _count is not None


def test_unseen_trigrams_of_a_large_alphabet_are_not_found(spark):
    from workloom.llm.language import count_trigrams, kneser_ney, load_model
    draw = np.random.default_rng(1)
    texts = [("x", "".join(map(chr, draw.integers(0x4E00, 0x9F00, 20_000)))) for _ in range(15)]
    model = load_model(["x"], kneser_ney(count_trigrams(spark.createDataFrame(texts, "lang string, text string")), ["x"], Scratch(spark, "t")))
    unseen = (draw.integers(0xAC00, 0xD7A0, 10_000) << 42) | (draw.integers(0xAC00, 0xD7A0, 10_000) << 21) | draw.integers(0xAC00, 0xD7A0, 10_000)
    assert not model.look("p3", unseen)[1].any()
    assert len(model.tables["p3"][0]) == len(np.unique(model.tables["p3"][0])) > 299_000


@pytest.mark.parametrize("few", [200_000, 2])
def test_language_by_joins(spark, monkeypatch, few):
    from workloom.llm import language
    rows = [(i, ("the cat and the dog %d" if i % 2 else "der hund und die katze %d") % i, "en" if i % 2 else "de") for i in range(20)]
    rows += [(100, None, None), (101, "", None), (102, "42", None), (103, "The Dog zq", None), (104, "Die Katze " * 300, None), (None, "щука", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = F.coalesce(F.col("doc_id") < 50, F.lit(False))
    near = lambda found: {r.doc_id: (r.lang_pred, round(r.score, 4), r.bits and round(r.bits, 4), r.rejected) for r in found.collect()}
    want = near(identify_languages(df, learn))
    monkeypatch.setattr(language, "MODEL_BYTES", 0)
    monkeypatch.setattr(language, "BROADCAST_CODES", few)
    assert near(identify_languages(df, learn)) == want and len(want) == 26


# --- chats ---------------------------------------------------------------------------------------

def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 1, "bot", "b"), (3, 0, "user", "a"), (3, 2, "user", None),
            (4, 0, "user", "b"), (5, 0, "user", "b"), (6, 0, None, "<|im_end|>x"), (7, 0, "user", ""), (8, 0, "user", None), (None, 0, "user", "z"), (9, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(3)).withColumn("n_turns", F.lit("c"))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in format_chats(df).collect()}
    assert got[3] == (3, 1, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert got[4][1] == 2 and 5 not in got and 1 not in got and 2 not in got
    assert got[6][2] == "<|im_start|>\n<im_end>x<|im_end|>\n"
    assert {7, 8, 9, None} <= set(got) and len(got) == 7
    assert format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 1024])
def test_chats_in_blocks(spark, monkeypatch, block):
    """A third of all turns in one conversation, logged at several lengths; gaps, ties, null roles, turn numbers from 5 on."""
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    draw = random.Random(3)
    long = [(t, draw.choice(["user", "bot"]), f"word {draw.randrange(9)} " * draw.randrange(5)) for t in range(90)]
    logs = {1: long, 2: long[:40], 3: long[:64], 4: [(t + 5, r, x) for t, r, x in long], 5: [(3 * t, r, x) for t, r, x in long[:7]], 6: long[1:],
            7: long[:39] + [(39, "user", "other")], 8: [(1, None, "a"), (1, "", "a"), (1, "bot", "a"), (None, "bot", "end")]}
    rows = [(i, *turn) for i, turns in logs.items() for turn in turns]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_chats(df).collect()}
    said = lambda turns: "".join(f"<|im_start|>{r or ''}\n{x}<|im_end|>\n" for _, r, x in turns)
    assert set(got) == {1, 6, 7, 8} and all(r.part == 0 for r in got.values())
    assert [(got[i].n_turns, got[i].n_copies, got[i].text) for i in (1, 6, 7, 8)] == [(len(logs[i]), 2 if i == 1 else 1, said(logs[i])) for i in (1, 6, 7, 8)]
    # Parts of bounded size, in order, are the whole text.
    parts = sorted(r for r in format_chats(df, part_bytes=500).select("conv_id", "part", "text").collect() if r.conv_id == 1)
    assert "".join(r.text for r in parts) == said(long) and (len(parts) > 3 if block == 2 else len(parts) == 1)


# --- decontamination -----------------------------------------------------------------------------

def brute_hits(text, items, width=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(LOWER))
        n = min(width, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_chars", [4_000_000, 60])
def test_decontamination(spark, part_chars):
    long, short = " ".join(prose(5, 30)), "Été 42, done"
    items = [(1, long), (2, short), (2, short), (10, long + " end"), (3, None), (4, "?!"), (5, "solo")]
    words = long.split()
    texts = [None, "", "nothing here", long.upper(), "x-" + "_".join(words[3:16]) + "!y", " ".join(words[3:15]), "so été... 42 DONE it", "solo " * 4,
             " ".join(prose(6, 40000) + words[:20] + prose(7, 400)), " ".join((words[:14] + ["z"]) * 300), short, short]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_hit", F.lit(9)).withColumn("spans", F.lit("s"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    found = find_benchmark_text(docs, bench, part_chars=part_chars)
    got = {r.doc_id: r for r in found.select("doc_id", F.col("n_hit").alias("own"), *[c.alias(n) for n, c in contamination(F.col("found")).items()]).collect()}
    for i, text in enumerate(texts):
        n, hit, ids = brute_hits(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(ids)), i
        assert got[i].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n) and got[i].own == 9
    assert find_benchmark_text(docs, bench.limit(0)).filter("size(found.items) > 0").count() == 0
    assert find_benchmark_text(docs.limit(0), bench).count() == 0


# --- search --------------------------------------------------------------------------------------

def test_search(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(900)]  # one vector that repeats
    rows += [(3000, None), (3001, [None] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [0.0] * 7), (3004, [1.0, 2.0]), (None, [1.0] * 8), (3005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    good = {i: np.array([np.floor(1024 * x) for x in v] + [0.0] * (8 - len(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for r in top_k_inner_products(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = {q: sorted(((i, int(good[q] @ v)) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:10] for q in good if q % 50 == 0}
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == want
    few = top_k_inner_products(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert top_k_inner_products(df.limit(0), F.lit(True)).count() == 0
    assert top_k_inner_products(df, F.lit(False)).count() == 0


def test_search_with_every_row_repeated(spark):
    draw = np.random.default_rng(5)
    once = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(300)]
    rows = [r for r in once for _ in range(2)] + [once[0]] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.floor(1024 * np.array(v))) for i, v in rows]
    got = {}
    for r in top_k_inner_products(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v in once[::20]:
        want = sorted(((i, int(np.floor(1024 * np.array(v)) @ x)) for i, x in good if i != q), key=lambda x: (-x[1], x[0]))[:10]
        assert [(i, s) for _, i, s in sorted(got[q])] == want, q


def test_search_in_many_chunks(spark, monkeypatch):
    """Chunks of four queries; one cell holds a third of all rows, one vector is very long."""
    monkeypatch.setattr(knn, "CHUNK_QUERIES", 4)
    draw = np.random.default_rng(7)
    rows = [(i, [float(x) for x in (draw.normal(size=5) * (0.01 if i % 3 == 0 else 1))]) for i in range(400)]
    rows.append((400, [0.5] * 20_000))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: np.floor(1024 * np.array(v[:5])) for i, v in rows}
    got = {}
    for r in top_k_inner_products(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(got) == 41
    for q in range(0, 400, 10):
        want = sorted(((i, int(good[q] @ x)) for i, x in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:10]
        assert [(i, s) for _, i, s in sorted(got[q])] == want, q


def test_chunks_follow_pivots():
    pivots = np.array([[0.0, 0], [0.1, 0], [10, 0], [10.1, 0], [20, 0]])
    first, number = knn._chunks(pivots, np.array([2, 2, 3, 1, 9]), 4)
    assert first[0] == first[1] and first[2] == first[3] and number.tolist() == [1, 1, 1, 1, 3]
    assert len({first[0], first[2], first[4], first[4] + 1, first[4] + 2}) == 5
    assert knn._chunks(pivots, np.array([1, 0, 1, 0, 1]), 4)[0].tolist() == [0] * 5


# --- quality -------------------------------------------------------------------------------------

def test_quality(spark):
    rows = [(i, " ".join(prose(i, 60)) if i % 2 else "BUY!! NOW!! " * (5 + i % 7)) for i in range(120)] + [(500, None), (501, ""), (502, "x" * 3_000_000), (503, "a b " * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(500, None), (501, 7)], "doc_id long, quality int")
    measured = with_statistics(docs)
    score = fit_rules(labelled_statistics(measured, labels, F.lit(True)), Scratch(spark, "t"))
    got = {r.doc_id: r.score for r in measured.select("doc_id", score.column().alias("score")).collect()}
    assert len(got) == 124 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(120))
    assert score.rules and all("if" in t for t in score.texts())
    zero = measured.filter("doc_id = 500").select("statistics.*").first()
    assert [zero[n] for n in STATISTICS if n not in ("line_words",)] == [0.0] * (len(STATISTICS) - 1)
    for some in (labels.limit(0), labels.filter("quality = 1")):
        flat = fit_rules(labelled_statistics(measured, some, F.lit(True)), Scratch(spark, "t"))
        assert not flat.rules
    assert with_statistics(docs.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------------

def test_mixing(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randrange(1, 60)), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "d"), (None, "u v", "b"), (None, "u v w", "b"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("hash", F.lit(2))
    got = mix_sources(df).select("doc_id", "text", "source", "key", "mix.*").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size and r.copies <= 2
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    targets = {s: x[0].target for s, x in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target <= 2 * x[0].source_size
        assert abs(sum(r.taken for r in x) - x[0].target) <= 61
    again = mix_sources(df.repartition(7)).select("doc_id", "text", "mix.copies").collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(doc_id=r.doc_id, text=r.text, copies=r.copies)) for r in got)
    assert mix_sources(df.limit(0)).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("=a", "a", 100), ("=b", "b", 1000), ("-", None, 10), ("=c", "c", 0)], "key string, source string, source_size long")
    got = {r.key: r.target for r in source_targets(sizes).collect()}
    assert got == {"=a": 200.0, "=b": 1445.0, "=c": 0.0, "-": 20.0}


# --- tokens --------------------------------------------------------------------------------------

def test_tokens(spark):
    import tiktoken
    from workloom.llm.tokencount import PATTERN, VOCABULARY, read_ranks
    texts = [None, "", "Hello world", "Hello world", "Été 😀", "a" * 200_000, " ".join(prose(1, 900)), "<|endoftext|>", "\n\n  x"]
    encoder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})
    lengths = [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("length", F.lit("x"))
    for block in (1024, 3):
        table = limit_table(length_histogram(df, token_length(spark)(F.col("text"))), block).cache()
        assert {r.length: (r.n_docs, r.docs_upto, r.docs_longer, r.tokens_upto, r.tokens_truncated) for r in table.collect()} == {
            n: (lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths)) for n in set(lengths)}
        for limit in (0, 1, 2, 5, 1000, 10**6):
            assert truncated_total(table, limit).first()[0] == sum(min(x, limit) for x in lengths)
        assert quantile(table, 0.5).first()[0] == sorted(lengths)[4]
    assert limit_table(length_histogram(df.limit(0), token_length(spark)(F.col("text")))).count() == 0


# --- lines ---------------------------------------------------------------------------------------

def test_lines(spark):
    rows = [(i, "big", f"menu\nline {i}\n\n footer \n") for i in range(40)] + [(100 + i, "small", "menu\nx") for i in range(4)]
    rows += [(200, None, None), (201, "big", ""), (202, "big", "menu"), (203, None, "menu\nmenu"), (204, "big", "a" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lines", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.doc_id: r for r in drop_site_lines(df, text_lines(F.col("text")), F.col("source"), ratio=0.5).select("doc_id", "key", "cleaned.*").collect()}
    assert got[3].text == "line 3\n\n" and (got[3].n_lines, got[3].n_dropped) == (5, 2)
    assert got[100].text == "menu\nx" and got[203].text == "menu\nmenu"
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == "" and got[202].text == ""
    assert len(got) == len(rows) and got[204].n_dropped == 0
    assert drop_site_lines(df.limit(0), text_lines(F.col("text")), F.col("source")).count() == 0


def test_lines_by_salt(spark, monkeypatch):
    from workloom.llm import sitelines
    rows = [(i, "s", f"menu\nline {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(sitelines, "BROADCAST_LINES", 0)
    got = drop_site_lines(df, text_lines(F.col("text")), F.col("source")).select("doc_id", "cleaned.*").collect()
    assert len(got) == 60 and all(r.text == f"line {r.doc_id}" for r in got)


def test_html_and_hosts(spark):
    df = spark.createDataFrame([("<p>a<b>b</b><!-- x --><script>var a='<p>';</script>c\n d", "HTTPS://u:p@WWW.x.Org:80/a?b"), (None, "nothing"), ("", None)], "html string, url string")
    got = df.select(html_lines(F.col("html")).alias("l"), url_host(F.col("url")).alias("h")).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c", " d"], "www.x.org"), (None, None), ([], None)]


# --- archives ------------------------------------------------------------------------------------

def warc_pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    copy = "same " * 40
    pages = {1: None, 2: "", 3: "short", 4: "short", 5: copy, 6: copy, 7: copy, 8: fake, 9: fake * 3 + "tail", 10: "ends with\r\n", 11: "\r\n\r\n" * 5, 12: "é" * 70_000,
             13: "\r\n", 14: "a\r\n\r\nb" * 60, 15: "WARC/1.1\r\n" * 50, 16: "x" * 99, 17: "x" * 99, 18: "x" * 100, 19: "x" * 100, 20: "half \r"}
    return pages | {100 + i: f"page {i} " * (i % 50) for i in range(200)}


@pytest.mark.parametrize("split", ["134217728", "3000"])
def test_archives(spark, split):
    pages = warc_pages()
    rows = [(k, f"http://h/{k}\r\nX: y" if k % 3 else None, t) for k, t in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = Scratch(spark, "t").path("archives")
        write_archives(page_records(df), path)
        records = read_records(spark, path, payloads=True).cache()
        got = {r.page_id: r for r in page_verdicts(records).collect()}
        payload = {r.record_id: bytes(r.payload) for r in records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    body = {k: (t or "").encode() for k, t in pages.items()}
    first = {}
    for k in sorted(body):
        first.setdefault(body[k], k)
    assert len(got) == len(pages) == records.count()
    for k, b in body.items():
        again = len(b) >= 100 and first[b] != k
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(b), hashlib.sha256(b).hexdigest()), k
        assert (got[k].record_type, got[k].refers_to) == (("revisit", first[b]) if again else ("response", None)), k
        assert payload[f"<urn:page:{k}>"] == (b"" if again else b)


def test_archives_at_every_split(spark):
    pages = {i: f"{i} " * (20 + i % 7) + "\r\n" * (1 + i % 3) for i in range(40)}
    path = Scratch(spark, "t").path("archives")
    write_archives(page_records(spark.createDataFrame(list(pages.items()), "page_id long, html string").withColumn("url", F.lit("http://h/"))).coalesce(1), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    uneven, sums = 0, []
    try:
        for split in range(700, 760):
            for n in names:
                spark.conf.set(n, str(split))
            sizes = _range_sizes(_ranges(spark, path).mapInArrow(_pieces, PIECES)).collect()
            sums.append(sum(r.size for r in sizes) - sizes[0].whole)
            if sums[-1] and uneven < 2:
                uneven += 1
                got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in page_verdicts(read_records(spark, path)).collect()}
                assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in pages.items()}, split
                payload = {r.record_id: bytes(r.payload).decode() for r in read_records(spark, path, payloads=True).collect()}
                assert payload == {f"<urn:page:{i}>": t for i, t in pages.items()}
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)
    assert uneven, sums


def test_archives_of_nothing(spark):
    path = Scratch(spark, "t").path("archives")
    write_archives(page_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert page_verdicts(read_records(spark, path)).count() == 0


def test_broken_archive(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good + good.replace(b"Length: 2", b"Length: 9") + good)
    (tmp_path / "b.warc").write_bytes(b"junk" + good)
    assert [(r.at, r.bytes) for r in read_records(spark, str(tmp_path)).orderBy("at").collect()][:1] == [(0, 2)]
