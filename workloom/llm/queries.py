"""The registered queries of this subpackage, one per operator, over whole tables."""

from pyspark.sql import functions as F

from workloom.llm.audit import audit_filters, text_filters, with_marks
from workloom.llm.chat import format_chats
from workloom.llm.checks import CHECKS
from workloom.llm.decontaminate import contamination, find_benchmark_text
from workloom.llm.knn import top_k_inner_products
from workloom.llm.language import identify_languages
from workloom.llm.lexical import search_items
from workloom.llm.mixing import mix_sources
from workloom.llm.neardup import near_duplicates
from workloom.llm.ngramjoin import ngram_classes
from workloom.llm.quality import CUT, fit_rules, labelled_statistics, with_statistics
from workloom.llm.scratch import Scratch
from workloom.llm.sitelines import drop_site_lines, html_lines, url_host
from workloom.llm.tokencount import length_histogram, limit_table, token_length
from workloom.llm.warc import page_records, page_verdicts, read_records, write_archives


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(of):
    """crc32 of the id as text, modulo ``of``; -1 for rows without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)), F.lit(-1))


def op1_minhash_neardup(spark, folder):
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


def op2_language_id(spark, folder):
    """Language of every document, learned from those whose id does not leave remainder 2."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_remainder(4) == 2)
    return identify_languages(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op3_chat_formatting(spark, folder):
    """Maximal conversations, rendered; the operator numbers the parts of very long ones."""
    return format_chats(table(spark, folder, "conversations")).drop("part")


def op4_decontamination(spark, folder):
    """Benchmark text in all documents."""
    found = find_benchmark_text(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", *[column.alias(name) for name, column in contamination(found["found"]).items()])


def op5_topk_search(spark, folder):
    """The ten best of all vectors for every vector whose id is divisible by 100."""
    return top_k_inner_products(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op6_quality_rules(spark, folder):
    """Quality scores of all documents."""
    scratch = Scratch(spark, "quality")
    measured = scratch.keep(with_statistics(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "statistics"), "statistics")
    score = fit_rules(labelled_statistics(measured, table(spark, folder, "labels"), id_remainder(5) != 0), scratch)
    scored = measured.select("doc_id", (id_remainder(5) == 0).alias("held_out"), score.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op7_source_mixing(spark, folder):
    """How many words of every document the mix takes."""
    mixed = mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "source", "mix.copies")


def op8_token_histogram(spark, folder):
    """Documents, tokens and truncated tokens for every context limit."""
    docs = table(spark, folder, "documents").select("text")
    histogram = Scratch(spark, "tokens").keep(length_histogram(docs, token_length(spark)(F.col("text"))), "histogram")
    return limit_table(histogram)


def op9_line_dedup(spark, folder):
    """Lines of all pages without those that many pages of the same host share."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    cleaned = drop_site_lines(pages, html_lines(F.col("html")), url_host(F.col("url")))
    return cleaned.select("page_id", url_host(F.col("url")).alias("host"), "cleaned.text", "cleaned.n_lines", "cleaned.n_dropped")


def op10_warc_roundtrip(spark, folder):
    """All pages written as archives, read back."""
    path = Scratch(spark, "warc").path("archives")
    write_archives(page_records(table(spark, folder, "pages").select("page_id", "url", "html")), path)
    return page_verdicts(read_records(spark, path))


def op11_filter_audit(spark, folder):
    """What each of five filters removes, in every order, per language."""
    scratch = Scratch(spark, "audit")
    failed = text_filters(table(spark, folder, "documents").select("doc_id", "lang", "text"), scratch)
    return audit_filters(with_marks(failed, table(spark, folder, "labels"), scratch), "ABCDE", scratch)


def op12_ngram_join(spark, folder):
    """Classes of documents of which 85 % of the four-word shingles agree."""
    return ngram_classes(table(spark, folder, "documents"))


def op13_lexical_search(spark, folder):
    """The 50 best documents of every benchmark item."""
    return search_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


QUERIES = {fn.__name__: fn for fn in [
    op1_minhash_neardup, op2_language_id, op3_chat_formatting, op4_decontamination, op5_topk_search, op6_quality_rules, op7_source_mixing,
    op8_token_histogram, op9_line_dedup, op10_warc_roundtrip, op11_filter_audit,
    op12_ngram_join, op13_lexical_search,
]}
