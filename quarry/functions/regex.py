"""Python-regex rules on the JVM.

Rules are written in Python's ``re`` dialect and compiled with MULTILINE and
IGNORECASE. Java's ``java.util.regex`` differs in places that change
results on real text:

* ``\\w``, ``\\d``, ``\\s`` (and ``\\W``, ``\\D``, ``\\S`` outside brackets) are ASCII in Java
  (and in RE2) but Unicode in Python -> spelled as classes that both engines read
  the same; ``\\b`` and the negated ones inside brackets are left as they are;
* ``$`` and ``.`` also stop at ``\\r``, ``\\u0085``, ``\\u2028`` in Java unless
  UNIX_LINES (``d``) is on;
* a ``{`` that repeats nothing and a ``[`` inside brackets need a backslash in Java;
* flags are inline: ``(?m)``, ``(?i)``; Java ignores case beyond ASCII with ``u`` only.

:func:`to_java` gives the pattern Spark compiles, :func:`to_re2` the same
pattern for a DuckDB oracle (RE2 has no ``d`` flag and no back-references).
"""

from __future__ import annotations

import re

_WORD = r"\p{L}\p{N}_"
_DIGIT = r"\p{Nd}"
_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_CLASS = {"w": _WORD, "d": _DIGIT, "s": _SPACE}
_REPEAT = re.compile(r"\{\d+(,\d*)?\}")


def unicode_classes(pattern: str) -> str:
    """Rewrite ``\\w``, ``\\d``, ``\\s`` and their negations to their Unicode spelling."""
    out = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in _CLASS:
                out.append(_CLASS[nxt] if in_class else f"[{_CLASS[nxt]}]")
            elif nxt.lower() in _CLASS and not in_class:
                out.append(f"[^{_CLASS[nxt.lower()]}]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a ']' right after '[' or '[^' is a literal
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "[" or ch == "{" and not in_class and not _REPEAT.match(pattern, i):
            out.append("\\" + ch)  # a plain character in Python
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def to_java(pattern: str, multiline: bool = True, ignore_case: bool = True) -> str:
    flags = "d" + ("m" if multiline else "") + ("iu" if ignore_case else "")
    return f"(?{flags}){unicode_classes(pattern)}"


def to_re2(pattern: str, multiline: bool = True, ignore_case: bool = True) -> str:
    flags = ("m" if multiline else "") + ("i" if ignore_case else "")
    body = unicode_classes(pattern)
    return f"(?{flags}){body}" if flags else body


def sql_literal(s: str) -> str:
    """Single-quoted SQL string literal (standard quoting, no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"
