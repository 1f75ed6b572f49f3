"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, URL schemes,
``+`` before a digit, digits, and identifier cues. From each anchor a small
deterministic parser walks outwards to the boundaries and validates what it
found. For the four base kinds the result is that of scanning the text with the
kind's pattern from left to right without overlaps:

* ``email`` from an at-sign: local part to the left, dotted labels to the right;
* ``ip`` and ``card`` from the first digit of a run: chains of runs;
* ``phone`` from ``+`` before a digit, back to the last digit of the run.

The method adds ``url`` (from ``://``), ``iban`` (two capitals before two
digits; checked modulo 97) and ``account`` (an identifier cue, then a value of
digits). Anything that fails its check is dropped; the scan goes on behind it.

Defined results: null text is empty and has no spans; every row of the input has
one row in the result, repeated rows too; positions count code points, end
exclusive; a very long text is read in time linear in its length. Spans are ordered by start, then kind in the order of ``KINDS``, then
end. Other columns are kept by :func:`redact` and not read by
:func:`personal_data`.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
#: Cues before a number that names a person or an account.
CUES = ("account", "acct", "passport", "ssn", "konto", "compte", "cuenta")

_LOCAL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUNS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_SCHEME = re.compile(r"[A-Za-z0-9+.-]")
_VALUE = re.compile(r"\s{0,3}(?:no\.?|number|nr\.?|id)?\s{0,3}[:#=]?\s{0,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])", re.I)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, what in [("@", "@"), ("://", ":"), *((d, "d") for d in "0123456789"),
                       *((f"+{d}", "+") for d in "0123456789"),
                       *((form, "cue") for c in CUES for form in (c, c.capitalize(), c.upper()))]:
        found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of every span, in order."""
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys(range(len(KINDS)), 0)  # where the last match of a kind ended
    digit_before = -2
    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "d":
            if at != digit_before + 1:
                _from_digit(text, at, done, out)
            digit_before = at
        elif what == "@":
            if at < done[0]:
                continue
            begin = at
            while begin > done[0] and _LOCAL_LEFT.match(text, begin - 1):
                begin -= 1
            domain = _DOMAIN.match(text, at + 1)
            if begin < at and domain:
                out.append((begin, 0, domain.end()))
                done[0] = domain.end()
        elif what == "+":
            if at < done[3]:
                continue
            m = _PHONE.match(text, at)
            if m:
                done[3] = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((at, 3, m.end()))
        elif what == ":":
            if at < done[4]:
                continue
            begin = at
            while begin > done[4] and begin > at - 20 and _SCHEME.match(text, begin - 1):
                begin -= 1
            # The scheme first: the rest may be long, and is read once for a span that counts.
            scheme = begin < at and text[begin].isascii() and text[begin].isalpha()
            rest = _URL_REST.match(text, last + 1) if scheme else None
            if rest:
                end = last + 1 + len(rest.group().rstrip(".,;:!?)]"))
                if end > last + 1:
                    out.append((begin, 4, end))
                    done[4] = end
        elif at >= done[6] and not (at and text[at - 1].isalnum()):
            m = _VALUE.match(text, last + 1)
            if m:
                out.append((m.start(1), 6, m.end(1)))
                done[6] = m.end(1)
    out.sort()
    return out


def _from_digit(text: str, at: int, done: dict, out: list) -> None:
    """Chains that begin with the digit run at ``at``."""
    if at >= done[1]:
        # Runs joined by single dots, taken four at a time; a rest of fewer is no match.
        chain = _RUNS.match(text, at)
        begin, parts = at, chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((begin, 1, end))
            begin = end + 1
        done[1] = chain.end()
    if at >= done[2]:
        chain = _CHAIN.match(text, at)
        done[2] = chain.end()
        number = _digits(chain.group())
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((at, 2, chain.end()))
    if at >= 2 and at - 2 >= done[5]:
        m = _IBAN.match(text, at - 2)
        if m and not (at > 2 and text[at - 3].isalnum()) and _iban(m.group()):
            out.append((at - 2, 5, m.end()))
            done[5] = m.end()


_SCHEMA = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_DDL = "array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` per row of ``docs``."""
    def find(batches):
        anchors = _automaton()
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t.as_py() or "", anchors)]
                     for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SCHEMA)], ["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        find, f"id {docs.schema[id_col].dataType.simpleString()}, spans {_DDL}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by ``[KIND]``; of overlapping spans the
    one that starts first (and is longest) names what is replaced."""
    parts, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text_col`` (null stays null) and its
    length in code points in ``length_col``."""
    at = docs.columns.index(text_col)

    def mask(batches):
        anchors = _automaton()
        for b in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, spans_of(t, anchors)) for x in b.column(at)]
            yield b.set_column(at, b.schema.field(at).with_nullable(True), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(mask, docs.schema)
    return out if length_col is None else out.withColumn(
        length_col, F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[length_col].dataType))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: str, kind: str):
    return F.filter(spans, lambda s: s["kind"] == kind)


def op10_personal_data(spark, sf_dir):
    from .common import load
    found = personal_data(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.withColumn("base", base).select(
        F.col("id").alias("doc_id"),
        *[F.size(_of_kind("base", k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
