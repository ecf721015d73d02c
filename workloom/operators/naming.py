"""Column names, types and order. Plans come from names only; no data is read."""

import re

from pyspark.sql import functions as F

from workloom import lexicon


def tidy_name(name):
    return re.sub(r"[^a-zA-Z0-9_]", "", name.strip().lower().replace(" ", "_"))


def normalise_names(df):
    """Trim, lower case, blanks to underscores, other characters dropped."""
    return df.toDF(*[tidy_name(c) for c in df.columns])


def synonym_plan(columns):
    """Old name to standard name. The first column equal to a variant is renamed; where two
    columns end up under one name, the one that already carries it keeps it."""
    plan = {}
    for standard, variants in lexicon.COLUMN_SYNONYMS.items():
        known = {v.lower().replace(" ", "_") for v in variants}
        for column in columns:
            if column in known and column not in plan.values():
                plan[column] = standard
                break
    taken = set(columns)
    out = {}
    for old, new in plan.items():
        if old != new and new not in taken and new not in out.values():
            out[old] = new
    return out


def kind_of(dataset):
    """Kind of a table, read off its name; the first hit wins."""
    name = dataset.lower()
    for kind, words in [("job", ("job", "posting")), ("company", ("company",)),
                        ("gender", ("gender", "stats")), ("salary", ("salary",))]:
        if any(w in name for w in words):
            return kind
    return None


def standardise(df, dataset):
    df = normalise_names(df)
    df = df.withColumnsRenamed(synonym_plan(df.columns))
    renames = {o: n for o, n in lexicon.KIND_RENAMES.get(kind_of(dataset), {}).items()
               if o in df.columns and n not in df.columns}
    return df.withColumnsRenamed(renames)


def coerce_types(df):
    """Declared types; text that cannot be read as a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in lexicon.COLUMN_TYPES.items() if c in df.columns})


def priority_order(df):
    first = [c for c in lexicon.PRIORITY_COLUMNS if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def source_label(file_name):
    """Kind of source, read off the file name."""
    low = F.lower(file_name)
    out = None
    for word, label in lexicon.SOURCE_LABELS:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return out.otherwise("Other")


def table_file(path):
    """Name of the CSV table that a file belongs to: the file itself, or the folder that holds its parts."""
    return F.regexp_extract(path, r"([^/]+\.csv)(?:/[^/]*)?$", 1)


def with_lineage(df, file_name):
    return df.withColumns({"source_file": file_name, "data_source": source_label(file_name),
                           "processing_date": F.lit(lexicon.PROCESSING_DATE)})
