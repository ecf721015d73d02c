"""Language identification by interpolated Kneser-Ney models of characters.

Counting: texts become lower-case letters with single spaces for everything else; tasks count
character trigrams per language, Spark adds them up over all learning rows. Lower orders count in how
many different contexts a character was seen, as Kneser-Ney asks, and are derived from the trigrams.

Model: probabilities of every n-gram seen in any language, for all languages, interpolated down to
single characters, under their exact codes. Models of up to ``MODEL_BYTES`` are broadcast as sorted
arrays, and one binary search scores a character in all languages. Larger ones stay tables: the
distinct trigrams of the texts are joined with them, and the trigram counts of every text with the result.

Choice: the language of the lowest cross-entropy per character. Two calibrations on the learning rows
follow: a temperature that makes the softmax of the entropies a probability, and per language the
entropy that nearly all of its own texts stay below; a text above it is marked as rejected.
"""

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch, dealt_join, quoted

#: Bytes of the arrays that are broadcast at most, and rows of a table that are broadcast in the joins beyond.
MODEL_BYTES = 1 << 27
BROADCAST_CODES = 200_000
SLICE_CHARS = 1 << 20
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Share of a language's learning texts that stay below its entropy limit, and the slack above it (bits per character).
OWN_SHARE, SLACK = 0.999, 0.25
BITS = 21
_LOW = (1 << BITS) - 1
_KINDS = []


def _kinds():
    """0 other, 1 letter, 2 combining mark, per code point."""
    if not _KINDS:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for i in range(sys.maxunicode + 1):
            first = unicodedata.category(chr(i))[0]
            table[i] = 1 if first == "L" else 2 if first == "M" else 0
        _KINDS.append(table)
    return _KINDS[0]


def trigrams(texts):
    """Codes of all trigrams of a list of texts, the text each belongs to, and the letters per text."""
    padded = ["  " + (t or "").lower() + " " for t in texts]
    lengths = np.array([len(t) for t in padded])
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[chars]
    inside = kind > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    starts = np.cumsum(lengths) - lengths
    keep[starts] = keep[starts + 1] = True
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(owner[kind == 1], minlength=len(texts))
    symbols = np.where(inside, chars, np.uint32(32))[keep].astype(np.int64)
    owner = owner[keep]
    codes = (symbols[:-2] << 2 * BITS) | (symbols[1:-1] << BITS) | symbols[2:]
    whole = owner[:-2] == owner[2:]
    return codes[whole], owner[2:][whole], letters


def _cut(texts):
    """Ranges of rows of about ``SLICE_CHARS`` characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= SLICE_CHARS:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _count(batches):
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            parts = [np.unique(trigrams(own[a:b])[0], return_counts=True) for a, b in _cut(own)]
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])


def count_trigrams(learn):
    """``lang, code, n`` over all rows of ``lang, text``."""
    return learn.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discount(table, value):
    """D = n1 / (n1 + 2 n2) per language; 0.5 where there is no such count."""
    one, two = F.count(F.when(F.col(value) == 1, 1)), F.count(F.when(F.col(value) == 2, 1))
    return table.groupBy("lang").agg(F.when(one > 0, one / (one + 2 * two)).otherwise(0.5).alias("d"))


def kneser_ney(counts, langs, scratch):
    """Log probabilities and back-off weights of all n-grams seen in any of ``langs``.

    Returns {name: DataFrame(code, lang, value)} for the names p3, b3, p2, b2, p1. All tables are of the
    size of the vocabulary of n-grams, not of the corpus.
    """
    tri = counts.select("lang", "code", "n", F.shiftright("code", BITS).alias("ab"), F.col("code").bitwiseAND((1 << 2 * BITS) - 1).alias("bc"))
    bi = scratch.keep(tri.groupBy("lang", "bc").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"b": F.shiftright("bc", BITS), "c": F.col("bc").bitwiseAND(_LOW)}), "bigrams")
    uni = bi.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang")

    def weights(table, context, value):
        d = F.broadcast(_discount(table, value))
        sums = table.groupBy("lang", context).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("types"))
        return sums.join(d, "lang").select("lang", context, "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("back"))

    total = uni.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    size = uni.select("c").distinct().count() + 1
    base = F.broadcast(total.join(_discount(uni, "n"), "lang"))  # one row per language
    floor = F.col("d") * F.col("types") / F.col("total") / F.lit(size)
    p1 = (uni.select("c").distinct().select("c", every).join(uni, ["lang", "c"], "left").join(base, "lang")
          .select("lang", "c", (F.greatest(F.coalesce("n", F.lit(0)) - F.col("d"), F.lit(0.0)) / F.col("total") + floor).alias("p")))
    unseen = base.select("lang", floor.alias("p"))
    p1 = scratch.keep(p1.union(unseen.select("lang", F.lit(-1).cast("long"), "p")), "p1")
    w2 = scratch.keep(weights(bi, "b", "n"), "w2")
    p2 = (bi.select("bc", "b", "c").distinct().select("bc", "b", "c", every)
          .join(bi.select("lang", "bc", "n"), ["lang", "bc"], "left").join(w2, ["lang", "b"], "left").join(p1, ["lang", "c"])
          .select("lang", "bc", (F.coalesce(F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"), F.lit(0.0))
                                 + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p")))
    p2 = scratch.keep(p2, "p2")
    w3 = scratch.keep(weights(tri, "ab", "n"), "w3")
    p3 = (tri.select("code", "ab", "bc").distinct().select("code", "ab", "bc", every)
          .join(tri.select("lang", "code", "n"), ["lang", "code"], "left").join(w3, ["lang", "ab"], "left").join(p2, ["lang", "bc"])
          .select("lang", "code", (F.coalesce(F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"), F.lit(0.0))
                                   + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p")))

    def logs(table, code, value):
        return table.select(F.col(code).alias("code"), "lang", F.log2(value).cast("float").alias("value"))

    return {"p3": logs(p3, "code", "p"), "b3": logs(w3, "ab", "back"), "p2": logs(p2, "bc", "p"), "b2": logs(w2, "b", "back"), "p1": logs(p1, "c", "p")}


class Model:
    """Sorted codes and values for all languages."""

    def __init__(self, langs, tables):
        self.langs = langs
        self.tables = tables  # {name: (codes, values)}

    def look(self, name, codes):
        """Values per code and language and which codes were found."""
        known, values = self.tables[name]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return values[at], known[at] == codes

    def logs(self, codes):
        """log2 P of every trigram in every language."""
        out, found = self.look("p3", codes)
        miss = np.flatnonzero(~found)
        if len(miss):
            code = codes[miss]
            b3, known = self.look("b3", code >> BITS)
            p2, seen = self.look("p2", code & ((1 << 2 * BITS) - 1))
            rare = np.flatnonzero(~seen)
            if len(rare):
                b2, known2 = self.look("b2", (code[rare] >> BITS) & _LOW)
                p1, seen1 = self.look("p1", code[rare] & _LOW)
                p1 = np.where(seen1[:, None], p1, self.look("p1", np.full(1, -1))[0])
                p2[rare] = p1 + np.where(known2[:, None], b2, 0)
            out[miss] = p2 + np.where(known[:, None], b3, 0)
        return out

    def entropies(self, texts):
        """(letters, characters, bits per character in every language) of a list of texts."""
        codes, owner, letters = trigrams(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        n = np.bincount(owner, minlength=len(texts))
        if len(codes):
            logs = self.logs(codes)
            for k in range(len(self.langs)):
                sums[:, k] = np.bincount(owner, weights=logs[:, k], minlength=len(texts))
        return letters, n, -sums / np.maximum(n, 1)[:, None]


def by_code(table, langs):
    """``code, logs``: one row per n-gram, values in the order of ``langs``. Back-off weights are per language: 0
    (weight 1) where a language has not seen the context."""
    values = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("value"))), F.lit(0.0).cast("float")) for x in langs]
    return table.groupBy("code").agg(F.array(*values).alias("logs"))


def load_model(langs, tables):
    """Collects tables of ``code, lang, value`` to the driver."""
    return gather_model(langs, {name: by_code(table, langs) for name, table in tables.items()})


def gather_model(langs, wide):
    out = {}
    for name, table in wide.items():
        rows = table.select("code", "logs").toArrow()
        codes = rows.column("code").to_numpy()
        values = rows.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(codes), len(langs))
        order = np.argsort(codes)
        out[name] = (codes[order], values[order].astype(np.float32))
    return Model(langs, out)


SCORED = "struct<letters:bigint,n:bigint,bits:array<double>>"


def score_entropies(model):
    """A column function: letters, characters and bits per character in every language."""
    @F.arrow_udf(SCORED)
    def score(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        letters, n, bits = [], [], []
        for a, b in _cut(texts):
            x, y, z = model.value.entropies(texts[a:b])
            letters.append(x), n.append(y), bits.append(z)
        width = len(model.value.langs)
        bits = np.concatenate(bits) if bits else np.zeros((0, width))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * width, pa.int32()), pa.array(bits.reshape(-1), pa.float64()))
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([join(letters), join(n), lists], names=["letters", "n", "bits"])

    return score.asNondeterministic()


GRAMS = "struct<letters:bigint,n:bigint,grams:array<struct<code:bigint,k:bigint>>>"


def _grams(column: pa.Array) -> pa.Array:
    """Letters, characters and counted trigrams of every text."""
    letters, n, ends, codes, counts = [], [], [0], [], []
    texts = column.to_pylist()
    for a, b in _cut(texts):
        code, owner, letter = trigrams(texts[a:b])
        letters.append(letter)
        bounds = np.searchsorted(owner, np.arange(b - a + 1))
        n.append(np.diff(bounds))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            own, k = np.unique(code[x:y], return_counts=True)
            codes.append(own), counts.append(k), ends.append(ends[-1] + len(own))
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    pairs = pa.StructArray.from_arrays([join(codes), join(counts)], names=["code", "k"])
    return pa.StructArray.from_arrays([join(letters), join(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["letters", "n", "grams"])


def joined_entropies(docs, columns, body, langs, wide, scratch):
    """``columns`` of ``docs``, ``letters, n, bits`` by joins of trigram counts with the model, whatever its size."""
    counted = docs.select(*columns, F.arrow_udf(_grams, GRAMS)(body).alias("s")).select("*", F.monotonically_increasing_id().alias("no"))
    counted = scratch.keep(counted.select("*", "s.letters", "s.n", "s.grams").drop("s"), "grams")
    grams = counted.select("no", F.explode("grams").alias("g")).select("no", "g.code", "g.k")
    codes = scratch.keep(grams.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "codes")
    low = codes.withColumns({"b3": F.shiftright("code", BITS), "p2": F.col("code").bitwiseAND((1 << 2 * BITS) - 1),
                             "b2": F.shiftright("code", BITS).bitwiseAND(_LOW), "p1": F.col("code").bitwiseAND(_LOW), "p3": F.col("code")})
    # A context or character may belong to many of the trigrams: its rows are counted before the join.
    for name in ("p3", "b3", "p2", "b2", "p1"):
        met = low.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        model = wide[name].select(F.col("code").alias(name), F.col("logs").alias(f"v_{name}")).join(met, name)
        low = scratch.keep(dealt_join(low, scratch.keep(model, name), [name], BROADCAST_CODES, "left"), f"with-{name}")
    unseen = F.lit(wide["p1"].filter("code = -1").first().logs).cast("array<float>")
    zeros = F.lit([0.0] * len(langs)).cast("array<float>")
    plus = lambda x, y: F.zip_with(x, F.coalesce(y, zeros), lambda a, b: a + b)
    pair = F.coalesce("v_p2", plus(F.coalesce("v_p1", unseen), F.col("v_b2")))
    logs = scratch.keep(low.select("code", "n", F.coalesce("v_p3", plus(pair, F.col("v_b3"))).alias("logs")), "logs")
    parts = dealt_join(grams, logs, ["code"], BROADCAST_CODES)
    sums = parts.groupBy("no").agg(F.array(*[F.sum(F.col("k") * F.col("logs")[i]) for i in range(len(langs))]).alias("sums"))
    bits = F.transform(F.coalesce("sums", F.lit([0.0] * len(langs))), lambda x: -x / F.greatest(F.col("n"), F.lit(1)))
    return counted.drop("grams").join(sums, "no", "left").withColumn("bits", bits).drop("no", "sums")


def identify_languages(docs, learn, text="text", lang="lang", keep=("doc_id",)):
    """Columns ``keep`` with ``lang_pred``, ``score``, ``bits`` (per character, in the chosen language), ``rejected``.

    ``learn`` is a condition on ``docs``: rows to learn from, those with a null language left out. Null
    texts and texts without a letter are ``und`` with score 0. Without any learning row all are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    body = F.col(text).cast("string")
    rows = docs.filter(learn & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), body.alias("text"))
    counts = scratch.keep(count_trigrams(rows), "trigrams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    ids = [F.col(quoted(c)) for c in keep]
    if not langs:
        return docs.select(*ids, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(False).alias("rejected"))
    wide = {name: scratch.keep(by_code(table, langs), name) for name, table in kneser_ney(counts, langs, scratch).items()}
    columns = [F.struct(*ids).alias("row"), F.when(learn, F.col(lang).cast("string")).alias("known")]
    if sum(table.count() for table in wide.values()) * (8 + 4 * len(langs)) <= MODEL_BYTES:
        model = spark.sparkContext.broadcast(gather_model(langs, wide))
        scored = docs.select(*columns, score_entropies(model)(body).alias("s")).select("row", "known", "s.letters", "s.n", "s.bits")
    else:
        scored = joined_entropies(docs, columns, body, langs, wide, scratch)
    scored = scratch.keep(scored, "entropies")
    best = F.array_min("bits")
    place = F.array_position("bits", best).cast("int")
    scored = scored.withColumns({"place": place, "best": best, "lang_pred": F.element_at(F.array(*[F.lit(x) for x in langs]), place)})

    def share(temperature, of):
        """Softmax share of the entropy ``of`` among those of all languages."""
        scale = F.col("n") * F.lit(temperature * float(np.log(2)))
        return F.exp(scale * (F.col("best") - of)) / F.aggregate(F.transform("bits", lambda b: F.exp(scale * (F.col("best") - b))), F.lit(0.0), lambda x, y: x + y)

    known = scored.filter("known IS NOT NULL AND letters > 0")
    own = F.element_at("bits", F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("known")).cast("int"))
    losses = known.agg(*[F.avg(-F.log(F.greatest(share(t, own), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    temperature = min(zip([x if x is not None else 0.0 for x in losses], TEMPERATURES, strict=True))[1]
    limits = (known.filter("known = lang_pred").groupBy("lang_pred").agg((F.percentile_approx("best", OWN_SHARE, 10000) + SLACK).alias("limit")))
    out = scored.join(F.broadcast(limits), "lang_pred", "left")  # one row per language
    some = F.col("letters") > 0
    return out.select(*[F.col(f"row.{quoted(c)}") for c in keep], F.when(some, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(some, share(temperature, F.col("best"))).otherwise(0.0).alias("score"), F.when(some, F.col("best")).alias("bits"),
                      F.coalesce(some & (F.col("best") > F.col("limit")), F.lit(False)).alias("rejected"))
