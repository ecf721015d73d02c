"""Cleaning plans per kind of table and the null policies."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from workloom import lexicon
from workloom.functions import text as tx
from workloom.operators.naming import kind_of
from workloom.operators.statistics import most_frequent, quantiles

CLEANERS = {"title": tx.clean_title, "company": tx.clean_company, "location": tx.clean_location,
            "general": tx.clean_general}


def cleaning_plan(dataset, columns, types):
    """Column to cleaner for one table; like names, decided without reading data."""
    name = dataset.lower()
    kind = kind_of(dataset)
    company = "company" if "company" in columns else "company_name"
    if kind == "job" or ("glassdoor" in name and kind not in ("company", "salary")):
        wanted = {"job_title": "title", company: "company", "location": "location", "job_description": "general"}
    elif kind == "company":
        title = "company_name" if "company_name" in columns else "name"
        wanted = {title: "company", "city": "location", "state": "location"}
    elif kind == "salary" or "salary" in name:
        wanted = {"job_title": "title", company: "company"}
    else:
        wanted = {c: "general" for c in columns
                  if types[c] == "string" and c not in ("country_code", "series_code")}
    return {c: k for c, k in wanted.items() if c in columns}


def clean_table(df, dataset):
    plan = cleaning_plan(dataset, df.columns, dict(df.dtypes))
    return df.withColumns({c: CLEANERS[k](F.col(c)) for c, k in plan.items()})


def _is_number(field):
    return isinstance(field.dataType, T.NumericType)


def smart_null_policy(df, sparse=80.0):
    """Per column, in table order: over ``sparse`` per cent null drops the column, critical
    columns drop rows, salaries and numbers take the median, texts a marker.

    Row drops of a critical column change the shares of the columns after it, so every null
    count and median is taken over the rows that are left by then - all in one aggregate,
    repeated only if a critical column itself turns out to be dropped.
    """
    fields = df.schema.fields
    dropped = set()
    while True:
        guards, left, exprs = {}, F.lit(True), []
        for f in fields:
            guards[f.name] = left
            here = left & F.col(f.name).isNull()
            exprs += [F.count_if(here).alias(f"n_{f.name}"), F.count_if(left).alias(f"t_{f.name}")]
            if f.name in lexicon.CRITICAL_COLUMNS + ["company_name"] and f.name not in dropped:
                left = left & F.col(f.name).isNotNull()
        seen = df.agg(*exprs).first().asDict()
        share = {f.name: 100.0 * seen[f"n_{f.name}"] / max(seen[f"t_{f.name}"], 1) for f in fields}
        now = {c for c, s in share.items() if s > sparse}
        critical = set(lexicon.CRITICAL_COLUMNS + ["company_name"])
        if now & critical == dropped & critical:
            break
        dropped = now
    out, required, fills = df.drop(*now), [], {}
    for f in fields:
        c = f.name
        if c in now or seen[f"n_{c}"] == 0:
            continue
        pay = "salary" in c.lower() or "income" in c.lower()
        if c in critical:
            required.append(c)
        elif _is_number(f):
            fills[c] = quantiles(df.filter(guards[c]), [c], [0.5])[c][0]
        elif pay:
            fills[c] = "Not Disclosed"
        elif c in ("location", "city", "state"):
            fills[c] = "Unknown"
        elif isinstance(f.dataType, T.StringType):
            fills[c] = "Not Specified"
    out = out.dropna(subset=required) if required else out
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c), F.lit(v))
        for c, v in fills.items() if v is not None})


def drop_missing(df, columns):
    """Rows that have a value in every one of ``columns`` that the table has."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df


def null_shares(df):
    """Null count per column as one row per column, from a single aggregate."""
    counted = df.agg(F.count(F.lit(1)).alias("__rows"),
                     *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot(["__rows"], df.columns, "column_name", "null_count")


def drop_sparse_columns(df, threshold=80.0):
    """Drops columns whose null share reaches the threshold."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    rows = max(row.pop("__rows"), 1)
    return df.drop(*[c for c, n in row.items() if 100.0 * n / rows >= threshold])


def recommended_action(df, threshold=80.0):
    """Missing-data analysis: null share, distinct values and the action it calls for."""
    types = dict(df.dtypes)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    long = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column_name", "value")
    # Two steps: equal values meet first, so a hot value reaches the second step as one row.
    per_value = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    stats = per_value.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0))).alias("null_count"),
        F.sum("n").alias("rows"), F.count("value").alias("distinct_values"))
    share = 100.0 * F.col("null_count") / F.col("rows")
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, _pandas_kind(types[c]))])
    action = (F.when(share >= threshold, "DROP")
              .when(F.col("column_name").isin(lexicon.IMPUTE_CRITICAL), "DROP_ROWS")
              .when(share == 0, "NONE")
              .when(kind[F.col("column_name")] == "text", "FILL_MODE")
              .when(kind[F.col("column_name")] == "flag", "FILL_FALSE")
              .when(kind[F.col("column_name")] == "number", "FILL_MEDIAN")
              .otherwise("FILL_DEFAULT"))
    return stats.select("column_name", "null_count", F.round(share, 4).alias("null_pct"),
                        "distinct_values", action.alias("action"))


def _pandas_kind(sql_type):
    if sql_type == "string":
        return "text"
    if sql_type == "boolean":
        return "flag"
    return "number" if sql_type in ("int", "bigint", "double", "float", "smallint") else "other"


def impute(df):
    """Six strategies in order: mode, default, false, median, zero, and the remainder rule.

    Columns without gaps stay as they are; a number column becomes double only where its median is no
    whole number.
    """
    types = dict(df.dtypes)
    modes = [c for c in lexicon.IMPUTE_MODE if c in types]
    numbers = [c for c, t in types.items() if _pandas_kind(t) == "number"]
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in modes + numbers]).first().asDict() if modes + numbers else {}
    numbers = [c for c in numbers if gaps[c]]
    common = {c: most_frequent(df, c) for c in modes if gaps[c]}
    medians = quantiles(df, numbers, [0.5])
    out = {}
    for c, t in types.items():
        kind = _pandas_kind(t)
        if c in modes:
            value = common.get(c)
            fill = F.lit("Unknown" if value is None else value)
        elif c in lexicon.IMPUTE_DEFAULT:
            fill = F.lit(lexicon.IMPUTE_DEFAULT[c])
        elif c in lexicon.IMPUTE_FALSE and kind == "flag":
            fill = F.lit(False)
        elif c in lexicon.IMPUTE_ZERO:
            fill = F.lit("0") if kind == "text" else F.lit(0)
        elif kind == "number":
            # A full column is left alone, a whole median keeps whole numbers whole.
            if c not in medians:
                continue
            value = medians[c][0]
            value = 0.0 if value is None else value
            fill = F.lit(value).cast(t) if value == int(value) else F.lit(value)
        elif kind == "flag":
            fill = F.lit(False)
        elif kind == "text":
            fill = F.lit("Not Available")
        else:
            continue
        out[c] = F.coalesce(F.col(c), fill)
    return df.withColumns(out)


def completeness(df):
    """Non-null cells over all cells."""
    filled = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(cells.alias("cells"), filled.alias("filled_cells"),
                  F.round(100.0 * filled / cells, 6).alias("completeness_pct"))


def training_nulls(df, numeric=(), categorical=(), boolean=(), text=(), required=()):
    """Null policy of the training tables: median, 'Unknown', 0/1 and empty text."""
    numeric = [c for c in numeric if c in df.columns]
    df = df.dropna(subset=list(required)) if required else df
    row = {c: v[0] for c, v in quantiles(df, numeric, [0.5]).items()}
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(row[c])) for c in numeric if row[c] is not None}
    out.update({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in categorical if c in df.columns})
    out.update({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in boolean if c in df.columns})
    out.update({c: F.coalesce(F.col(c), F.lit("")) for c in text if c in df.columns})
    return df.withColumns(out)
