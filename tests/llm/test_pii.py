"""Anchor expansion against plain left-to-right pattern scans."""
import hashlib
import random
import re

import pytest

from quarry.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


CASES = ["", "a@b.c@d.e", "x@y", "é.a@b.co.uk.", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1.1.1.1", "0001.02.3.4",
         "4111 1111 1111 1111 1", "4111-1111-1111-1111", "4111  1111", "+1 (415) 555-0100.", "+12", "+1-2",
         "++49 170 1234567", "+1.2.3.4.5.6.7.8.9.0", "a@-.-", "@@a.b", "a@b..c.d", "12@34.56.78.90", "١٢٣.1.1.1.1"]


def test_base_spans_equal_pattern_scans():
    a = pii._automaton()
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("a1@.+- ()%9é4") for _ in range(rng.randrange(60))) for _ in range(6000)]
    for t in texts:
        assert [s for s in pii.spans_of(t, a) if s[1] < 4] == brute(t), t


def test_added_kinds_and_masking():
    a = pii._automaton()
    t = "see https://x.org/a?b=1, IBAN GB82 WEST 1234 5698 7654 32; passport no: 12345678 and a@b.co"
    got = {(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans_of(t, a)}
    assert {("url", "https://x.org/a?b=1"), ("iban", "GB82 WEST 1234 5698 7654 32"),
            ("account", "12345678"), ("email", "a@b.co")} <= got
    assert pii.masked(t, pii.spans_of(t, a)) == "see [URL], IBAN [IBAN]; passport no: [ACCOUNT] and [EMAIL]"


def test_query_shape(spark, tmp_path):
    rows = [(1, "mail a@b.co 1.2.3.4", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x"),
            (3, "+49 170 1234567 " + "lorem ipsum " * 20000 + "4111 1111 1111 1111", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pii.op10_personal_data(spark, str(tmp_path)).collect()), key=str)
    for doc_id, n_email, n_ip, n_card, n_phone, sha, spans in got:
        text = next(t or "" for d, t, _ in rows if d == doc_id)
        base = brute(text)
        assert [n_email, n_ip, n_card, n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert sha == hashlib.sha256(joined.encode()).hexdigest()
    assert len(got) == 5


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", 6), (2, None, 0)], "doc_id long, text string, n_chars long")
    out = sorted(tuple(r) for r in pii.redact(df, length_col="n_chars").collect())
    assert out == [(1, "[EMAIL]", 7), (2, None, 0)]
    assert pii.redact(df.limit(0)).columns == df.columns and pii.redact(df.limit(0)).count() == 0


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(digits, ok):
    assert pii.luhn(digits) is ok


def test_long_texts_take_linear_time():
    import time

    from quarry.llm import pii
    anchors = pii._automaton()
    for piece in ("1://", "a://", "a://.", "@", "a@", "+1", "+1(", "1.", "1 ", "a@b.", "AB12", "account 1", "://x "):
        text = piece * (1_000_000 // len(piece))
        start = time.time()
        found = pii.spans_of(text, anchors)
        assert time.time() - start < 20, piece
        assert all(s < e <= len(text) for s, _, e in found)
