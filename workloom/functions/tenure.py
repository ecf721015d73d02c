"""Experience text to years, and experience bands."""

from pyspark.sql import functions as F

from workloom import lexicon
from workloom.functions.rules import bands_upto, case, contains_any, pattern


def _span(lo, hi):
    return f"named_struct('lo', CAST({lo} AS DOUBLE), 'hi', CAST({hi} AS DOUBLE))"


def experience_span(low):
    """Struct (lo, hi) in years from lower-case text; executive wording ends the search."""

    def number(regex, group):
        return f"CAST(regexp_extract({low}, {pattern(regex)}, {group}) AS DOUBLE)"

    def hit(regex):
        return f"{low} RLIKE {pattern(regex)}"

    years, plus = lexicon.YEARS_RANGE, lexicon.YEARS_PLUS
    months, months_plus = lexicon.MONTHS_RANGE, lexicon.MONTHS_PLUS
    arms = [(f"{low} IS NULL OR {low} = ''", "NULL"),
            (hit(years), _span(number(years, 1), number(years, 2))),
            (hit(plus), _span(number(plus, 1), f"{number(plus, 1)} + 5")),
            (hit(lexicon.EXECUTIVE_WORDS), "NULL"),
            (hit(months), _span(f"{number(months, 1)} / 12", f"{number(months, 2)} / 12")),
            (hit(months_plus), _span(f"{number(months_plus, 1)} / 12", f"({number(months_plus, 1)} + 5) / 12"))]
    arms += [(hit(regex), _span(lo, hi)) for regex, lo, hi in lexicon.EXPERIENCE_LEVELS]
    return case(arms)


def title_span(low):
    """Years expected of a lower-case job title, used where the text names none."""
    return case([(f"{low} IS NULL", "NULL"), (contains_any(low, lexicon.TITLE_SENIOR_WORDS), _span(5, 12)),
                 (contains_any(low, lexicon.TITLE_JUNIOR_WORDS), _span(0, 3))], _span(2, 8))


def experience_level(lo, hi):
    mean = f"(({lo} + {hi}) / 2)"
    return case([(f"{mean} IS NULL", "'Not Specified'"), (f"{mean} = 0", "'Fresher'")],
                bands_upto(mean, lexicon.EXPERIENCE_BANDS, "Executive Level"))


def with_experience_columns(df, text_columns, title_column=None):
    """Adds ``<c>_experience_min/_max/_level`` per text column and the row summary."""
    out = df.select("*", *[F.expr(f"lower(trim(`{c}`))").alias(f"__low_{c}") for c in text_columns],
                    *([F.lower(title_column).alias("__low_title")] if title_column else []))
    spans = [experience_span(f"`__low_{c}`") for c in text_columns]
    if title_column:
        spans = [f"coalesce({x}, {title_span('__low_title')})" for x in spans]
    out = out.select("*", *[F.expr(x).alias(f"__exp_{c}") for c, x in zip(text_columns, spans)])
    added = []
    for c in text_columns:
        lo, hi = f"`__exp_{c}`.lo", f"`__exp_{c}`.hi"
        added += [F.expr(lo).alias(f"{c}_experience_min"), F.expr(hi).alias(f"{c}_experience_max"),
                  F.expr(experience_level(lo, hi)).alias(f"{c}_experience_level")]
    lows, highs = [f"`__exp_{c}`.lo" for c in text_columns], [f"`__exp_{c}`.hi" for c in text_columns]
    least = lows[0] if len(lows) == 1 else f"least({', '.join(lows)})"
    most = highs[0] if len(highs) == 1 else f"greatest({', '.join(highs)})"
    return out.select(*df.columns, *added, F.expr(least).alias("required_experience_min"),
                      F.expr(most).alias("required_experience_max"),
                      F.expr(experience_level(least, most)).alias("experience_category"))
