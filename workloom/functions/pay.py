"""Salary text to numbers, and salary bands."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions.rules import bands_below, case, first_match, holds_any, lookup, pattern, quoted


def currency(low):
    """Currency named in lower-case text."""
    return first_match(f"coalesce({low}, '')", lexicon.CURRENCY_MARKS, "INR")


def _read(low):
    """Struct (lo, hi, factor) of the first pattern that fits; null where none does."""
    arms = [(f"{low} IS NULL OR {low} = '' OR {holds_any(low, lexicon.UNDISCLOSED_PHRASES)}", "NULL")]
    for regex, is_range, factor in lexicon.SALARY_PATTERNS:
        second = 2 if is_range else 1
        arms.append((f"{low} RLIKE {pattern(regex)}",
                     f"named_struct('lo', regexp_extract({low}, {pattern(regex)}, 1), "
                     f"'hi', regexp_extract({low}, {pattern(regex)}, {second}), 'factor', {quoted(float(factor))})"))
    return case(arms)


def _amount(span, bound, code):
    rate = lookup(code, lexicon.FX_TO_INR)
    return f"CAST(replace({span}.{bound}, ',', '') AS DOUBLE) * {span}.factor * {rate}"


def with_salary_columns(df, columns=None):
    """Adds ``_min``, ``_max`` (INR a year) and ``_currency`` for every salary-like column.

    Three narrow steps - lower case, pattern, numbers - so that no text is read twice.
    """
    if columns is None:
        columns = [c for c in df.columns if any(w in c.lower() for w in lexicon.SALARY_COLUMN_WORDS)]
    out = df.select("*", *[F.expr(f"lower(trim(CAST(`{c}` AS STRING)))").alias(f"__low_{c}") for c in columns])
    out = out.select("*", *[F.expr(_read(f"`__low_{c}`")).alias(f"__span_{c}") for c in columns],
                     *[F.expr(currency(f"`__low_{c}`")).alias(f"__code_{c}") for c in columns])
    added = []
    for c in columns:
        span, code = f"`__span_{c}`", f"`__code_{c}`"
        added += [F.expr(_amount(span, "lo", code)).alias(f"{c}_min"), F.expr(_amount(span, "hi", code)).alias(f"{c}_max"),
                  F.expr(f"CASE WHEN {span} IS NULL THEN 'INR' ELSE {code} END").alias(f"{c}_currency")]
    return out.select(*df.columns, *added)


def salary_category(average):
    return case([(f"{average} IS NULL", "'Not Disclosed'")],
                bands_below(average, lexicon.SALARY_CATEGORIES, lexicon.SALARY_CATEGORY_TOP))


def lakh_bracket(salary):
    return case([(f"{salary} IS NULL", "'Not Disclosed'")],
                bands_below(f"{salary} / 100000", lexicon.LAKH_BRACKETS, lexicon.LAKH_BRACKET_TOP))


def income_bracket(income):
    return case([(f"{income} >= {low}" + ("" if high is None else f" AND {income} < {high}"), quoted(label))
                 for low, high, label in lexicon.INCOME_BRACKETS], "'Unknown'")
