"""Filter audit, n-gram join and lexical search: brute force, odd tables, hot groups, repeated rows."""

import random
import re
from itertools import permutations
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, LOWER, near_texts, prose

from workloom.llm.audit import audit_filters, inside, text_filters, union, with_marks
from workloom.llm.lexical import search_items
from workloom.llm.ngramjoin import ngram_classes
from workloom.llm.scratch import Scratch

ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t", "en", None, 2), (3, " \t", "en", None, 2), (None, "a B c", "", "s", 5), (4, "a b C", "en", "s", 5)]


def odd(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    clash = ["part", "row", "n", "node", "items", "rank", "score", "item_id", "words", "A", "a`b"]
    return df.withColumns({c: F.lit(1) for c in clash})


# --- filter audit --------------------------------------------------------------------------------

def brute_audit(rows, labels):
    first, out = {}, {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failed = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        marks = [any(r[0] == i and r[0] is not None and r[k] == 1 for r in labels) for k in (1, 2)]
        failed.append((lang or "", {f for f, yes in fails.items() if yes}, *marks))
    for part in {p for p, *_ in failed}:
        docs = [(f, g, t) for p, f, g, t in failed if p == part]
        for order in permutations("ABCDE"):
            for step, own in enumerate(order):
                before = set(order[:step])
                removed = [d for d in docs if own in d[0] and not d[0] & before]
                out[part, "".join(order), step + 1] = [
                    sum(not d[0] & (before | {own}) for d in docs), len(removed), sum(own in d[0] and bool(d[0] & before) for d in docs),
                    sum(d[0] == {own} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels, size):
    scratch = Scratch(spark, "t")
    rows = audit_filters(with_marks(text_filters(docs, scratch), labels, scratch), "ABCDE", scratch, size).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


@pytest.mark.parametrize(("size", "few"), [(7, 200_000), (1 << 14, 0)])
def test_audit(spark, monkeypatch, size, few):
    from workloom.llm import audit
    monkeypatch.setattr(audit, "BROADCAST_ROWS", few)
    draw = random.Random(5)
    rows = [(1, None, None), (2, "", "en"), (3, "", None), (3, "", None), (None, "", "en"), (None, "x #", "de"), (5, "x #", "en"), (6, "y " * 300000, "en")]
    for i in range(10, 200):
        words = prose(draw.randrange(40), draw.choice([5, 150, 250]))
        if draw.random() < 0.3:
            words = words[:3] * 90
        text = " ".join(words)
        rows.append((i, text.upper() if draw.random() < 0.2 else text + draw.choice(["", "", "|"]), draw.choice(["en", "en", "de", None, ""])))
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 220) for _ in range(draw.choice([1, 1, 2]))] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumn("part", F.lit("x")).withColumn("good", F.lit(1))
    got = audited(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), size)
    assert got == brute_audit(rows, labels)


def test_audit_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(spark, odd(spark, []), labels, 4) == {}
    assert audited(spark, odd(spark, ODD), labels, 4) == brute_audit([(r[0], r[1], r[2]) for r in ODD], [])


def test_merges():
    draw = random.Random(3)
    for _ in range(50):
        lists = [np.array(sorted(draw.sample(range(60), draw.randrange(40))), np.int64) for _ in range(3)]
        assert union(lists).tolist() == sorted(set().union(*[x.tolist() for x in lists]))
        assert lists[0][inside(lists[0], lists[1])].tolist() == sorted(set(lists[0].tolist()) & set(lists[1].tolist()))


# --- n-gram join ---------------------------------------------------------------------------------

def grams(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute_join(rows):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(doc), len(sets[i]), str(least.get(find(i)))) for i, (doc, _) in enumerate(rows))


def chained(n):
    """Texts that each differ from the one before by a few words: links form chains, far texts do not link."""
    draw, words = random.Random(11), prose(9, 120)
    for k in range(n):
        for at in draw.sample(range(120), 3):
            words[at] = f"y{k}{at}"
        yield 400 + k, " ".join(words)


@pytest.mark.parametrize(("small", "block", "few"), [(48, 1024, 200_000), (2, 8, 0), (2, 1024, 200_000)])
def test_ngram_join(spark, monkeypatch, small, block, few):
    from workloom.llm import ngramjoin
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", few)
    monkeypatch.setattr(ngramjoin, "HOT_GRAMS", few and 10_000)
    rows = [*near_texts().items(), *chained(40)]
    # Copies of a group in several variants, more than a block of them, and repeated ids with other texts.
    for k in range(60):
        words = prose(77, 90)
        words[5 * (k % 6)] = f"z{k % 6}"
        rows.append((600 + k, " ".join(words)))
    rows += [(600, "another text of the same id here"), (700, "another text of the same id here"), (None, "another text OF the same id here"), (None, "no partner at all"), (None, None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3).withColumn("comp", F.lit(1))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_classes(df, small=small, block=block).collect())
    assert got == brute_join(rows)


def test_ngram_join_of_odd_tables(spark):
    assert ngram_classes(odd(spark, [])).collect() == []
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_classes(odd(spark, ODD)).collect())
    assert got == brute_join([(r[0], r[1]) for r in ODD]) and got[-1] == ("None", 1, "4")


def test_filters_lose_no_link():
    from workloom.llm.ngramjoin import may_link, part_sizes
    draw = np.random.default_rng(1)
    for _ in range(300):
        base = np.unique(draw.integers(0, 1 << 63, draw.integers(1, 3000)).astype(np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([base[draw.random(len(base)) < 0.95], draw.integers(0, 1 << 63, len(base) // 30 + 1).astype(np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common >= 85 * (len(base) + len(other) - common):
            assert may_link(np.array([len(base)]), np.array([len(other)]), part_sizes(base)[None], part_sizes(other)[None], 85)[0]


# --- lexical search ------------------------------------------------------------------------------

def terms(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k):
    counts = [(doc, {t: w.count(t) for t in set(w)}, len(w)) for doc, text in docs if (w := terms(text))]
    n, total = len(counts), sum(size for *_, size in counts)
    df = {}
    for _, tf, _ in counts:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in by_item.items():
        found = []
        for doc, tf, size in counts:
            m = 50 + 50 * size * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if t in tf)
            if score > 0:
                found.append((score, doc))
        out[item] = sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]
    return {(i, r): v for i, rows in out.items() for r, v in enumerate(rows, 1)}


@pytest.mark.parametrize(("part_terms", "leaf", "cells"), [(20_000, 16, 4_000_000), (30, 2, 100)])
def test_lexical_search(spark, part_terms, leaf, cells):
    draw = random.Random(8)
    words = [f"t{int(draw.paretovariate(0.8)) % 400}" for _ in range(6000)]
    docs = [(i, " ".join(draw.sample(words, draw.choice([1, 5, 40, 120])))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(20)] + [(7, "t1 T1 t2"), (None, docs[3][1]), (None, "t1"), (2000, None), (2001, ""), (2002, "- ?"), (2003, "t9, t8 " * 40000), (2004, "Ünïcode t3")]
    docs += [docs[5]] * 2
    items = [(i, " ".join(draw.sample(words, 12))) for i in range(15)] + [(20, None), (21, "!"), (22, "t1"), (22, "t2 T1"), (None, "t5"), (None, "t6"), (23, "never seen"), (3, "ünïcode")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("terms", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    got = {(r.item_id, r.rank): (r.score, r.doc_id) for r in search_items(df, asked, k=9, part_terms=part_terms, leaf=leaf, cells=cells).collect()}
    assert got == brute_search(docs, items, 9)


def test_lexical_search_of_odd_tables(spark):
    asked = spark.createDataFrame([("x", "a C")], "item_id string, text string")
    assert search_items(odd(spark, []), asked).collect() == []
    assert search_items(odd(spark, ODD), asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    got = {(r.item_id, r.rank): (r.score, r.doc_id) for r in search_items(odd(spark, ODD), asked).collect()}
    assert got == brute_search([(r[0], r[1]) for r in ODD], [("x", "a C")], 50) and len(got) == 2


def test_terms_are_no_documents(spark):
    """A document with terms, none of them asked for, counts for N and L but has no row."""
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = [(1, "a b"), (2, "b c d e"), (3, "A")]
    got = {(r.item_id, r.rank): (r.score, r.doc_id) for r in search_items(spark.createDataFrame(docs, "doc_id long, text string"), asked).collect()}
    assert got == brute_search(docs, [(1, "a")], 50)
