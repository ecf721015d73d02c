"""Fragments of the check SQL, generated for DuckDB from the same fixed values."""

import re

from workloom import lexicon


def q(text):
    return "'" + text.replace("'", "''") + "'"


def has_any(x, words):
    return "(" + " OR ".join(f"strpos({x}, {q(w)}) > 0" for w in words) + ")"


def first_match(x, table, default):
    rows = table.items() if isinstance(table, dict) else table
    arms = " ".join(f"WHEN {has_any(x, words)} THEN {q(label)}" for label, words in rows)
    return f"CASE {arms} ELSE {q(default)} END"


def title_case(x):
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}]+|[^\\p{{L}}]+'), "
            "lambda r: upper(r[1]) || r[2:]), '')")


def clean_text(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), "
            "'[^\\p{L}\\p{N}_\\s\\-\\.\\,\\(\\)]', '', 'g'), ',+', ',', 'g'))")


def fold(x, steps, flags="g"):
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, '{flags}')"
    return x


def clean_title(x):
    steps = [(rf"\b{a}\b", b) for a, b in lexicon.TITLE_ABBREVIATIONS.items()]
    return f"nullif({fold(title_case(clean_text(x)), steps)}, '')"


def clean_company(x):
    steps = [(rf"\b{re.escape(v)}\b", s.upper()) for s, vs in lexicon.COMPANY_SUFFIXES.items() for v in vs]
    return f"nullif({fold(title_case(clean_text(x)), steps, 'gi')}, '')"


def clean_location(x):
    steps = [(rf"\b{re.escape(a)}\b", b) for a, b in lexicon.CITY_SYNONYMS.items() if a != b]
    return f"nullif(string_split({title_case(fold(f'lower({clean_text(x)})', steps))}, ',')[1], '')"


def lookup(x, table, default):
    arms = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {x} {arms} ELSE {q(default) if isinstance(default, str) else default} END"


def bands(x, rows, top, op="<"):
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN {q(label)}" for b, label in rows) + f" ELSE {q(top)} END"


def cut(x, edges, labels, include_lowest=False):
    arms = []
    for i, label in enumerate(labels):
        op = ">=" if include_lowest and i == 0 else ">"
        arms.append(f"WHEN {x} {op} {edges[i]} AND {x} <= {edges[i + 1]} THEN {q(label) if isinstance(label, str) else label}")
    return "CASE " + " ".join(arms) + " END"


def currency(x):
    return first_match(f"lower(coalesce({x}, ''))", lexicon.CURRENCY_MARKS, "INR")


def salary_bound(x, group):
    low = f"lower(trim({x}))"
    rate = lookup(currency(x), lexicon.FX_TO_INR, 1.0)
    arms = [f"WHEN {x} IS NULL OR {low} = '' OR {has_any(low, lexicon.UNDISCLOSED_PHRASES)} THEN NULL"]
    for pattern, is_range, factor in lexicon.SALARY_PATTERNS:
        g = group if is_range else 1
        arms.append(f"WHEN regexp_matches({low}, {q(pattern)}) THEN "
                    f"CAST(replace(regexp_extract({low}, {q(pattern)}, {g}), ',', '') AS DOUBLE) * CAST({factor} AS DOUBLE) * CAST({rate} AS DOUBLE)")
    return "CASE " + " ".join(arms) + " END"


def experience_bound(x, group):
    low = f"lower(trim({x}))"

    def num(pattern, g):
        return f"CAST(regexp_extract({low}, {q(pattern)}, {g}) AS DOUBLE)"

    def hit(pattern):
        return f"regexp_matches({low}, {q(pattern)})"

    more = 0 if group == 1 else 5
    arms = [f"WHEN {x} IS NULL OR {low} = '' THEN NULL",
            f"WHEN {hit(lexicon.YEARS_RANGE)} THEN {num(lexicon.YEARS_RANGE, group)}",
            f"WHEN {hit(lexicon.YEARS_PLUS)} THEN {num(lexicon.YEARS_PLUS, 1)} + {more}",
            f"WHEN {hit(lexicon.EXECUTIVE_WORDS)} THEN NULL",
            f"WHEN {hit(lexicon.MONTHS_RANGE)} THEN {num(lexicon.MONTHS_RANGE, group)} / 12",
            f"WHEN {hit(lexicon.MONTHS_PLUS)} THEN ({num(lexicon.MONTHS_PLUS, 1)} + {more}) / 12"]
    for pattern, lo, hi in lexicon.EXPERIENCE_LEVELS:
        arms.append(f"WHEN {hit(pattern)} THEN CAST({lo if group == 1 else hi} AS DOUBLE)")
    return "CASE " + " ".join(arms) + " END"


def title_bound(x, group):
    low = f"lower({x})"
    senior, junior, rest = (5, 0, 2) if group == 1 else (12, 3, 8)
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {has_any(low, lexicon.TITLE_SENIOR_WORDS)} THEN CAST({senior} AS DOUBLE) "
            f"WHEN {has_any(low, lexicon.TITLE_JUNIOR_WORDS)} THEN CAST({junior} AS DOUBLE) ELSE CAST({rest} AS DOUBLE) END")


def experience_level(lo, hi):
    mean = f"(({lo} + {hi}) / 2)"
    return (f"CASE WHEN {mean} IS NULL THEN 'Not Specified' WHEN {mean} = 0 THEN 'Fresher' ELSE "
            + bands(mean, lexicon.EXPERIENCE_BANDS, "Executive Level", "<=") + " END")


def skills_count(x):
    return f"CASE WHEN {x} IS NULL THEN 0 ELSE len(string_split({x}, ',')) END"


def i(flag):
    return f"CAST({flag} AS INT)"
