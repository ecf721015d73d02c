"""Rule tables as Spark SQL expressions: first match, bins, lookups, filled tests.

Every function takes and returns expression text; callers wrap it in ``F.expr``. One parsed
expression per rule keeps plan building cheap, and the result is plain ``CASE`` / ``contains``
code that stays inside generated code. Pass the name of a prepared column where a rule tests
many words, so that the text is lower-cased once and not once per word.
"""

from workloom import lexicon


def quoted(value):
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return "NULL" if value is None else str(value)


def pattern(regex):
    return f"r'{regex}'"


def contains_any(x, words):
    """True where ``x`` holds one of ``words`` as a substring."""
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def holds_any(x, words):
    """Like :func:`contains_any`, as a loop over a list: few instructions where a step has many other rules."""
    return f"exists({texts(words)}, w -> contains({x}, w))"


def _rows(table):
    return table.items() if isinstance(table, dict) else table


def case(arms, otherwise=None):
    """``CASE`` over (condition, result) pairs of expression text."""
    tail = "" if otherwise is None else f" ELSE {otherwise}"
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in arms) + tail + " END"


def first_match(x, table, default):
    """Label of the first row of ``table`` (label, words) with a word inside ``x``."""
    return case([(contains_any(x, words), quoted(label)) for label, words in _rows(table)], quoted(default))


def bands_below(x, bands, top):
    """Label of the first band whose exclusive upper bound lies above ``x``."""
    return case([(f"{x} < {b}", quoted(label)) for b, label in bands], quoted(top))


def bands_upto(x, bands, top):
    """Like :func:`bands_below` with inclusive upper bounds."""
    return case([(f"{x} <= {b}", quoted(label)) for b, label in bands], quoted(top))


def cut(x, edges, labels, include_lowest=False):
    """Right-closed bins ``(a, b]``; values outside every bin give null."""
    arms = []
    for i, label in enumerate(labels):
        above = ">=" if include_lowest and i == 0 else ">"
        arms.append((f"{x} {above} {edges[i]} AND {x} <= {edges[i + 1]}", quoted(label)))
    return case(arms)


def lookup(x, table, default=None):
    """Value of ``x`` in a small fixed map, else ``default``."""
    return case([(f"{x} = {quoted(k)}", quoted(v)) for k, v in table.items()], quoted(default))


def is_filled(x, is_text=True):
    """Not null, not NaN, and not one of the texts that stand for an empty field."""
    if is_text:
        empty = ", ".join(quoted(w) for w in lexicon.EMPTY_TEXTS)
        return f"({x} IS NOT NULL AND trim({x}) NOT IN ({empty}))"
    return f"({x} IS NOT NULL AND NOT isnan({x}))"


def weighted(flags):
    """Sum of the weights whose flag holds: ``[(condition, weight), ...]``."""
    return "(" + " + ".join(f"CASE WHEN {f} THEN {w} ELSE 0 END" for f, w in flags) + ")"


def kept(pairs):
    """Array of the values whose condition holds, in order: ``[(condition, value), ...]``."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {f} THEN {quoted(v)} END" for f, v in pairs) + "))"


def texts(values):
    """Array of strings."""
    return "array(" + ", ".join(quoted(v) for v in values) + ")"


def total(columns):
    return "(" + " + ".join(columns) + ")"
