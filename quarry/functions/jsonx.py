"""JSON out of free text, natively (FIX-03, FIX-04).

The extraction ladder for model replies: a fenced block, else the whole
(stripped) text, else the span from the first ``{`` to the last ``}``; a
candidate counts only when it parses as a JSON *object*. All Catalyst
expressions (``try_parse_json`` gives a VARIANT), no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: fenced-block pattern (lazy object inside ``` or ```json)
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _object(text: Column) -> Column:
    """VARIANT of ``text`` when it is a JSON object, else null."""
    v = F.try_parse_json(text)
    return F.when(F.startswith(F.ltrim(text), F.lit("{")) | F.startswith(F.trim(text), F.lit("{")), v)


def _base(text) -> Column:
    t = _c(text)
    return F.when(t.rlike(FENCED), F.regexp_extract(t, FENCED, 1)).otherwise(t)


def _parsed(base) -> Column:
    b = _c(base)
    start = F.instr(b, "{")
    end = F.length(b) - F.instr(F.reverse(b), "}") + 1
    span = F.when((start > 0) & (F.instr(b, "}") > 0) & (end > start), F.substring(b, start, end - start + 1))
    return F.coalesce(_object(b), _object(span))


def extract_json(text) -> Column:
    """FIX-03: parsed object (VARIANT) or null when the reply holds none."""
    return _parsed(_base(text))


JSON = "_json"


def with_json(df: DataFrame, text: str) -> DataFrame:
    """``df`` with :func:`extract_json` of ``text`` as column ``JSON``, computed once for
    all the fields that are read from it. A column of that name is taken as it is."""
    if JSON in df.columns:
        return df
    return df.withColumn("_text", _base(text)).withColumn(JSON, _parsed("_text")).drop("_text")


def json_field(obj, key: str, dtype: str = "string", default=None) -> Column:
    """FIX-04: ``obj[key]`` cast to ``dtype``; ``default`` only when the key is absent
    (a present JSON null stays null)."""
    o = _c(obj)
    path = "$['" + key.replace("'", "\\'") + "']"
    present = F.try_variant_get(o, path, "variant").isNotNull()
    value = F.try_variant_get(o, path, dtype)
    d = default if isinstance(default, Column) else F.lit(default).cast(dtype)
    return F.when(o.isNull(), F.lit(None).cast(dtype)).when(present, value).otherwise(d)
