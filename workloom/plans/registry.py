"""Registry of named queries and of the SQL that checks them."""

import re

from workloom.sources.catalog import STANDINS, Tables, needs

QUERIES = {}
CHECKS = {}
CHECK_VIEWS = {}


def query(name, sql=None):
    """Registers ``fn(tables)`` under ``name``; ``sql`` is the independent check."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


def check_view(name, sql):
    """A named sub-query that several checks share (never used by the Spark side)."""
    CHECK_VIEWS[name] = sql


def _body(name):
    if name in CHECK_VIEWS:
        return CHECK_VIEWS[name]
    return STANDINS[name].format(**{n: n for n in needs(STANDINS[name])})


def _ordered(sql, seen, out):
    for word in re.findall(r"[a-z_][a-z_0-9]*", sql):
        if (word in STANDINS or word in CHECK_VIEWS) and word not in seen:
            seen.add(word)
            body = _body(word)
            _ordered(body, seen, out)
            out.append((word, body))


def check_sql(sql):
    """The full statement: every derived table it names becomes a common table expression."""
    parts = []
    _ordered(sql, set(), parts)
    if not parts:
        return sql
    head = ", ".join(f"{n} AS ({b})" for n, b in parts)
    text = sql.strip()
    found = re.match(r"(?i)with\s+(recursive\s+)?", text)
    if found:
        return f"WITH {found[1] or ''}{head}, {text[found.end():]}"
    return f"WITH {head} {text}"


def runnable(fn):
    return lambda spark, folder: fn(Tables(spark, folder))
