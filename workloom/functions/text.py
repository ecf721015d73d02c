"""Text columns: case, cleaning, escaping, skill lists, labels."""

from pyspark.sql import functions as F

from workloom import lexicon

LONGEST = 2147483647
LETTERS = r"(\p{L}+|[^\p{L}]+)"
WORDS = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"
# Word boundaries that know every alphabet; cheaper than the Unicode flag of the regex engine.
EDGE_LEFT, EDGE_RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def title_case(text):
    """Capital after every non-letter, the rest lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, LONGEST))), "")


def fold(text, steps):
    """Apply (pattern, replacement) pairs one after the other."""
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def swap_words(text, table):
    """Replace whole words by a map, in one pass over the text."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(1))
    swaps = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(swaps, w), w)), "")


def clean_text(text):
    """Collapse blanks, drop special characters, merge commas, trim."""
    text = F.coalesce(F.nullif(text, F.lit("nan")), F.lit(""))
    text = fold(text, [(r"[\s\x1c-\x1f\x85\p{Z}]+", " "), (r"[^\p{L}\p{N}_ \-.,()]", ""), (r",+", ",")])
    return F.trim(text)


def emptied(text):
    """Empty text becomes null."""
    return F.nullif(text, F.lit(""))


def clean_title(text):
    """Title case with abbreviations written out.

    An abbreviation that ends in a dot stands for any character there, so ``Jr Dev`` loses
    its blank; those come first, the plain words are swapped together.
    """
    dotted = [(f"{EDGE_LEFT}{short[:-1]}(?:[\\p{{L}}\\p{{N}}_]{EDGE_RIGHT}|[^\\p{{L}}\\p{{N}}_](?=[\\p{{L}}\\p{{N}}_]))", full)
              for short, full in lexicon.TITLE_ABBREVIATIONS.items() if short.endswith(".")]
    plain = {k: v for k, v in lexicon.TITLE_ABBREVIATIONS.items() if not k.endswith(".")}
    return emptied(swap_words(fold(title_case(clean_text(text)), dotted), plain))


def clean_company(text):
    """Title case with standard suffixes.

    Single words are swapped in one pass. ``limited`` is among them, so the longer wordings
    that begin with it can no longer occur; a dot between a suffix and a word is dropped.
    """
    swaps = {v.title(): standard.upper() for standard, variants in lexicon.COMPANY_SUFFIXES.items()
             for v in variants if v.isalpha()}
    dotted = sorted({standard.upper() for standard, variants in lexicon.COMPANY_SUFFIXES.items()
                     if any(v == standard + "." for v in variants)})
    text = swap_words(title_case(clean_text(text)), swaps)
    return emptied(F.regexp_replace(text, f"{EDGE_LEFT}({'|'.join(dotted)})\\.(?=[\\p{{L}}\\p{{N}}_])", "$1"))


def clean_location(text):
    steps = [(f"{EDGE_LEFT}{a}{EDGE_RIGHT}", b) for a, b in lexicon.CITY_SYNONYMS.items() if a != b]
    return emptied(F.split(title_case(fold(F.lower(clean_text(text)), steps)), ",")[0])


def clean_general(text):
    return emptied(clean_text(text))


def clean_skills(skills):
    """Comma list of skills in title case with brand spellings."""
    brands = F.create_map(*[F.lit(x) for kv in lexicon.SKILL_BRANDS.items() for x in kv])

    def spelled(skill):
        cased = title_case(F.trim(skill))
        return F.coalesce(F.try_element_at(brands, cased), cased)
    return F.array_join(F.transform(F.split(skills, ","), spelled), ", ")


def skills_count(skills):
    """Number of comma-separated elements; null counts as none."""
    return F.when(skills.isNull(), F.lit(0)).otherwise(F.size(F.split(skills, ",")))


def skill_diversity(skills):
    """Distinct lower-case elements over all elements (elements are not trimmed)."""
    parts = F.split(F.lower(skills), ",")
    return F.when(skills.isNull(), F.lit(0.0)).otherwise(
        F.size(F.array_distinct(parts)) / F.greatest(F.size(parts), F.lit(1)))


def skill_array(skills):
    """Trimmed lower-case skills without blanks."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(skills, F.lit(""))), ","), lambda s: F.trim(s)),
                    lambda s: s != "")


def escape_markup(text):
    """Trimmed text with markup characters written as entities."""
    text = F.trim(F.coalesce(text, F.lit("")))
    for raw, entity in [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def pretty_label(label):
    """``Domain_Mid`` becomes ``Domain - Mid Level``; the last underscore splits."""
    head = F.regexp_extract(label, r"^(.*)_([^_]*)$", 1)
    tail = F.regexp_extract(label, r"^(.*)_([^_]*)$", 2)
    levels = F.create_map(*[F.lit(x) for kv in lexicon.LABEL_LEVELS.items() for x in kv])
    return F.when(label.contains("_"), F.concat(
        F.replace(head, F.lit("_"), F.lit(" ")), F.lit(" - "),
        F.coalesce(F.try_element_at(levels, tail), tail))).otherwise(label)


def rupee_range(low, high):
    return F.concat(F.lit("₹"), F.format_number(low, 0), F.lit(" - ₹"), F.format_number(high, 0))


def row_text(columns):
    """All columns of a row as one text, nulls as empty text."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def comparable(text):
    """Spelling used when postings are compared for near duplicates."""
    text = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    for old, new in lexicon.COMPARISON_REWRITES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# --- contact rules: null when the field is fine, else the first failing reason ---
def email_issue(email):
    value = F.lower(F.trim(email))
    return (F.when(email.isNull() | (email == ""), "Email is required")
            .when(~value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), "Invalid email format")
            .when(F.length(value) > 254, "Email is too long"))


def phone_issue(phone):
    value = F.regexp_replace(phone, r"[\s\-]", "")
    return (F.when(phone.isNull() | (phone == ""), "Phone number is required")
            .when(~value.rlike(r"^(?:\+91|91|0)?[6-9]\d{9}$"),
                  "Invalid phone number. Please enter a valid 10-digit Indian mobile number"))


def name_issue(name):
    value = F.trim(name)
    return (F.when(name.isNull() | (name == ""), "Name is required")
            .when(F.length(value) < 2, "Name must be at least 2 characters long")
            .when(F.length(value) > 100, "Name is too long")
            .when(~value.rlike(r"^[a-zA-Z\s\.\'-]+$"), "Name contains invalid characters"))
