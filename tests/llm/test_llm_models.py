"""Language models and quality statistics next to plain Python versions of their definitions."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from workloom.llm import language
from workloom.llm.language import identify_languages
from workloom.llm.quality import STATISTICS, RuleScore, with_statistics

# --- Kneser-Ney ----------------------------------------------------------------------------------


def symbols(text):
    """Letters and marks in lower case, one space for anything between, two in front."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    words = kept.split()
    return "  " + "".join(w + " " for w in words)


class Plain:
    """Interpolated Kneser-Ney over dictionaries, from the textbook."""

    def __init__(self, texts, size):
        self.size = size
        self.three = Counter(s[i:i + 3] for s in map(symbols, texts) for i in range(len(s) - 2))
        self.two = Counter(g[1:] for g in self.three)
        self.one = Counter(g[1:] for g in self.two)

    @staticmethod
    def discount(counts):
        one, two = (sum(n == k for n in counts.values()) for k in (1, 2))
        return one / (one + 2 * two) if one else 0.5

    def level(self, counts, gram, lower):
        met = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not met:
            return lower
        d = self.discount(counts)
        return max(counts[gram] - d, 0) / sum(met) + d * len(met) / sum(met) * lower

    def p(self, gram):
        return self.level(self.three, gram, self.level(self.two, gram[1:], self.level(self.one, gram[2:], 1 / self.size)))

    def bits(self, text):
        s = symbols(text)
        grams = Counter(s[i:i + 3] for i in range(len(s) - 2))
        return -sum(k * math.log2(self.p(g)) for g, k in grams.items()) / max(1, grams.total())


def babble(seed, letters, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(1, 5))) for _ in range(n))


@pytest.mark.parametrize("bound", [language.MODEL_BYTES, 0])
def test_equals_a_plain_model(spark, monkeypatch, bound):
    """Learnt texts, unseen characters, marks, other signs, one very long text: bits and choice as by dictionaries."""
    monkeypatch.setattr(language, "MODEL_BYTES", bound)
    learn = [(i, babble(i, "aabbcde", 12), "x") for i in range(6)] + [(i, babble(i, "ddeéfgg", 12), "y") for i in range(6, 12)]
    ask = [(100, "abc! abc,dd", None), (101, "q Q щ", None), (102, "é déf 12-34 g", None), (103, babble(9, "abdeg", 60_000), None), (104, "\t\na", None)]
    docs = spark.createDataFrame(learn + ask, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs, F.col("doc_id") < 100).collect()}
    by_lang = defaultdict(list)
    for _, text, lang in learn:
        by_lang[lang].append(text)
    size = len({c for t in sum(by_lang.values(), []) for c in symbols(t)}) + 1
    models = {lang: Plain(texts, size) for lang, texts in by_lang.items()}
    for i, text, _ in learn + ask:
        bits = {lang: m.bits(text) for lang, m in models.items()}
        least = min(bits.values())
        assert got[i].bits == pytest.approx(least, abs=2e-5), i
        assert bits[got[i].lang_pred] == pytest.approx(least, abs=2e-5), i


def test_ties_go_to_the_first_name(spark):
    rows = [(1, "same words", "b"), (2, "same words", "a"), (3, "same words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs, F.col("doc_id") < 3).collect()}
    assert {r.lang_pred for r in got.values()} == {"a"} and got[3].score == pytest.approx(0.5)


# --- quality -------------------------------------------------------------------------------------

def plain_statistics(text):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = low.translate(bytes(32 if b in (32, *range(9, 14)) else b for b in range(256))).split(b" ")
    words = [w for w in words if w]
    n, size, times = max(1, len(words)), max(1, len(raw)), Counter(words)
    count = lambda inside: sum(b in inside for b in raw)
    upper = count(range(65, 91))
    letters = upper + count(range(97, 123)) + count(range(192, 256))
    wordless = sum(not any(97 <= b <= 122 or b >= 128 or 48 <= b <= 57 for b in w) for w in words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n, "upper_share": upper / max(1, letters),
        "symbol_share": count(b"#$%&*+/<=>@[\\]^_`{}~") / size, "pipe_share": count(b"|") / n, "mark_share": count(b"!?") / n,
        "digit_share": count(range(48, 58)) / size, "distinct_share": len(times) / n, "top_word_share": max(times.values(), default=0) / n,
        "repeat_share": sum(a == b for a, b in zip(words, words[1:])) / n, "wordless_share": wordless / n,
        "line_words": len(words) / max(1, len(lines)), "line_repeat_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "stop_share": count(b".") / n, "longest_word": math.log1p(max(map(len, words), default=0)), "beyond_ascii_share": count(range(128, 256)) / size}


TEXTS = ["end", "end of it", "It of. it it", None, "", "  \n\t ", "A|B ## 12 äö щука!?\nA|B ## 12 äö щука!?\n\n x", "x" * 400_000, "w w\n" * 120_000, "Ünï cödé 3.14", "last", "last"]


@pytest.mark.parametrize("parts", [1, 3])
def test_statistics_by_definition(spark, parts):
    """Each text on its own, whatever stands before it: texts that begin with the last word of the one before are no repeat."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).repartition(parts) if parts > 1 else \
        spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.statistics for r in with_statistics(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = plain_statistics(text)
        assert {n: got[i][n] for n in STATISTICS} == pytest.approx(want, abs=1e-9), (i, (text or "")[:30])


def test_rule_scores_by_hand(spark):
    """The compiled column equals adding up the weights of the rules that hold, in Python."""
    rules = [(1.5, ((0, (1.0, None)),)), (-2.0, ((2, (0.1, 0.9)), (5, (None, 0.5)))), (0.75, ((9, (None, 0.0)),))]
    score = RuleScore(-0.25, rules)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in with_statistics(docs).select("doc_id", score.column().alias("score")).collect()}
    for i, text in enumerate(TEXTS):
        stats = plain_statistics(text)
        holds = lambda rule: all((a is None or stats[STATISTICS[k]] > a) and (u is None or stats[STATISTICS[k]] <= u) for k, (a, u) in rule)
        total = -0.25 + sum(w for w, rule in rules if holds(rule))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total))), i
