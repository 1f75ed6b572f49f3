"""Column expressions over text: lines, previews, paths.

All of them are built-in Catalyst expressions (whole-stage codegen), no
Python in the data path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def newline_count(text) -> Column:
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(NL), F.lit("")))).cast("int")


def line_count(text) -> Column:
    """Lines of a text the way ``count('\\n') + 1`` counts them (ENT-12)."""
    return newline_count(text) + F.lit(1)


def lines(text) -> Column:
    """``ARRAY<STRING>`` of lines; trailing empty line kept (split with limit -1)."""
    return F.split(_c(text), NL, -1)


def slice_lines(text, start, end) -> Column:
    """Lines ``start..end`` (1-based, inclusive) joined by newlines (ENT-10)."""
    s, e = _c(start), _c(end)
    return F.array_join(F.slice(lines(text), s, e - s + F.lit(1)), NL)


def preview(text, n: int, ellipsis: str = "...") -> Column:
    """First ``n`` characters, newlines as spaces, ``...`` appended when cut."""
    t = F.replace(_c(text), F.lit(NL), F.lit(" "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ellipsis))).otherwise(t)


def path_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def path_stem(path) -> Column:
    """Name without its last suffix (``a/b.tar.gz`` -> ``b.tar``; ``.rc`` stays)."""
    name = path_name(path)
    return F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0,
                  F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def path_suffix(path) -> Column:
    name = path_name(path)
    return F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0,
                  F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))


def path_parent(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def fill_template(template: str, values: dict) -> Column:
    """``template`` with ``{name}`` placeholders filled from ``values`` (name ->
    column), like ``str.format``: values are inserted once, never re-scanned."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in values:
            continue
        parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
