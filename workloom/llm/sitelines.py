"""Line deduplication by site-relative frequency.

Pages are grouped by site. A line is boilerplate where the pages that contain it, divided by all pages
of the site, exceed ``ratio``. Its copies are dropped from every page of that site and from no other.

Lines travel as 64-bit hashes; counts are summed per task before the shuffle, so neither a large site
nor a line of every page is one task. As every boilerplate line needs ``ratio`` of its site's pages, a
site has at most (mean lines per page) / ratio of them: the list per site is short whatever its size.

A share of the site cannot find a passage that a fixed number of documents repeat: the number that it asks
for grows with the site, and pages of several sites are never added up. ``everywhere`` finds those: long
lines of at least ``SUPPORT`` different documents of the whole table, where near copies of each other count
as one document. Which lines a text loses is settled per distinct text, so no list grows with the table.
"""

from pyspark.sql import functions as F

from workloom.llm.mixing import source_key
from workloom.llm.neardup import near_duplicates
from workloom.llm.scratch import Scratch, dealt_join

RATIO = 0.02
#: Lines on fewer pages of a site are no boilerplate: on a site of a few pages any line has a high ratio.
MIN_PAGES = 5
#: Rows (site, line) up to which the lists are broadcast; beyond, pages are dealt by site and salt.
BROADCAST_LINES = 200_000
SALTS = 64
#: Different documents of the whole table that make a line of at least LONG characters a repeated passage.
SUPPORT, LONG = 20, 30


def line_key(line):
    """Hash of a line without outer white space."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _is_blank(line):
    return ~line.rlike(r"\S")


def boilerplate_lines(pages, lines, site, ratio=RATIO, min_pages=MIN_PAGES):
    """``key, line, n``: hashes of the boilerplate lines of every site and their pages. A row is a page, repeated rows count again."""
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: ~_is_blank(x)), line_key))
    slim = pages.select(source_key(site.cast("string")).alias("key"), F.coalesce(keys, F.array().cast("array<bigint>")).alias("keys"))
    # A null line in every row counts the pages of the site.
    counts = (slim.select("key", F.explode(F.array_append("keys", F.lit(None).cast("long"))).alias("line"))
              .groupBy("key", "line").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_pages) | F.col("line").isNull()))
    totals = counts.filter("line IS NULL").select("key", F.col("n").alias("pages"))
    return (counts.filter("line IS NOT NULL").join(totals, "key").filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("key", "line", "n"))


def text_key(lines):
    """Two columns that stand for a text in all its lines."""
    return [F.xxhash64(lines).alias("__text_a"), F.xxhash64(F.lit(7), lines).alias("__text_b")]


def repeated_passages(pages, lines, text, covered, scratch, support=SUPPORT, long=LONG):
    """``__text_a, __text_b, __often, n``: the repeated passages of every text that has some, and the rows with that text.

    A passage is a line of at least ``long`` characters in at least ``support`` documents that are no near copies
    of each other. ``covered`` are the boilerplate lines by site: lines that go from all their pages anyway are skipped.
    """
    lengthy = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(" \t\r"))) >= long)
    slim = pages.select(*text_key(lines), F.explode(F.array_distinct(F.transform(lengthy, line_key))).alias("line"))
    gone = covered.groupBy("line").agg(F.sum("n").alias("gone"))
    often = slim.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    often = scratch.keep(often.join(gone, "line", "left").filter("gone IS NULL OR gone < n").select("line", "n"), "often")
    of_texts = ["__text_a", "__text_b"]
    hits = scratch.keep(dealt_join(slim, often, ["line"], BROADCAST_LINES).groupBy(*of_texts, "line").agg(F.count(F.lit(1)).alias("n")), "hits")
    # Near copies of each other, among the texts that have such a line, count once. Equal texts are one row.
    texts = scratch.keep(hits.groupBy(*of_texts).agg(F.max("n").alias("n")), "texts")
    bodies = dealt_join(pages.select(*text_key(lines), text.alias("text")), texts, of_texts, BROADCAST_LINES).dropDuplicates(["__text_a"])
    bodies = scratch.keep(bodies.select(F.col("__text_a").alias("doc_id"), "text"), "bodies")
    classes = near_duplicates(bodies).select(F.col("doc_id").alias("__text_a"), "component_id")
    passages = (hits.join(classes, "__text_a").groupBy("line").agg(F.count_distinct("component_id").alias("classes"), F.count(F.lit(1)).alias("n"))
                .filter(F.col("classes") >= support).select("line", "n"))
    met = dealt_join(hits, scratch.keep(passages, "passages"), ["line"], BROADCAST_LINES)
    return scratch.keep(met.groupBy(*of_texts).agg(F.collect_set("line").alias("__often"), F.max("n").alias("n")), "losses")


def drop_site_lines(pages, lines, site, ratio=RATIO, min_pages=MIN_PAGES, into="cleaned", everywhere=None):
    """``pages`` with the struct ``into``: ``text`` (kept lines, joined by newlines), ``n_lines``, ``n_dropped``.

    ``lines`` and ``site`` are expressions on ``pages``: an array of strings and a string. Blank lines
    are kept and never counted as boilerplate. Null lines give a null text and zero counts; null sites are
    one site. A column called like ``into`` is replaced, all others pass unchanged. With ``everywhere``, the
    text of a page, lines that many different pages of the whole table repeat go too, whatever their sites.
    """
    scratch = Scratch(pages.sparkSession, "sitelines")
    found = scratch.keep(boilerplate_lines(pages, lines, site, ratio, min_pages), "lines")
    few = found.count() <= BROADCAST_LINES
    losses = repeated_passages(pages, lines, everywhere, found, scratch) if everywhere is not None else None
    lists = found.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("bad")).select(F.struct("key", "bad").alias("__list"))
    out = pages.withColumns({"__lines": lines, "__key": source_key(site.cast("string"))})
    if few:
        out = out.join(F.broadcast(lists), F.col("__key") == F.col("__list.key"), "left")
    else:
        salted = lists.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("__salt", F.pmod(F.xxhash64("__lines"), F.lit(SALTS)).cast("int"))
        out = out.join(salted, (F.col("__key") == F.col("__list.key")) & (F.col("__salt") == F.col("__of")), "left").drop("__of", "__salt")
    bad = F.coalesce(F.col("__list.bad"), F.array().cast("array<bigint>"))
    if losses is not None:
        a, b = text_key(F.col("__lines"))
        out = dealt_join(out.withColumns({"__text_a": a, "__text_b": b}), losses, ["__text_a", "__text_b"], BROADCAST_LINES, "left")
        bad = F.array_union(bad, F.coalesce(F.col("__often"), F.array().cast("array<bigint>")))
    kept = F.filter("__lines", lambda x: _is_blank(x) | ~F.array_contains(bad, line_key(x)))
    number = F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    made = F.struct(F.array_join(kept, "\n").alias("text"), number.alias("n_lines"),
                    F.when(F.col("__lines").isNull(), 0).otherwise(number - F.size(kept)).cast("long").alias("n_dropped"))
    return out.withColumn(into, made).drop("__lines", "__key", "__list", *(["__text_a", "__text_b", "__often"] if losses is not None else []))


def text_lines(text):
    return F.split(text, "\n", -1)


def html_lines(html):
    """Visible text of a page, one line per run between tags; scripts, styles and comments are left out, blank runs too."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n")
    lines = F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n", -1)
    return F.filter(lines, lambda x: x.rlike(r"\S"))


def url_host(url):
    """Lower-case host of a URL without port and user; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)
