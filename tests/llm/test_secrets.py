import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from shoptrail.llm import secrets


def base(text):
    out = []
    for kind, pattern, ok in (
            ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return ",".join(x[2] for x in sorted(out))


def test_query_equals_brute_force(spark):
    at = SF.replace("sf0.001", "sf0.01")
    docs = dict(duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{at}/documents.parquet'").fetchall())
    got = secrets.op7(spark, at).collect()
    assert len(got) == len(docs) and any(r.spans for r in got)
    for r in got:
        want = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(want.split(",")) <= set(r.spans.split(","))


CASES = ["", "token=short", "token = 'abcdef'", "PassWord: hunter2a", "password=token=abcdef1", 'secret: "tok" api_key="1234567"', "é token=ééé token=abcdef",
         "AKIA" + "A" * 15, "AKIA" + "A" * 16, "aAKIAAKIA" + "9" * 13, "f" * 23 + " " + "0" * 24 + "g", "toKen=ſecret1 paſſword=abcdefg",
         "apikey=abc.def== api__key=zzzzzzz", "token=" + "a1" * 30]


def test_base_patterns():
    for text in CASES:
        assert secrets.written(secrets.base_spans(text)) == base(text), text


def slow_cost(value):
    """All segmentations, each part at its least cost."""
    low, plain = value.lower(), value.lower().translate(secrets.LEET)

    def part(s, a):
        b = a + len(s)
        found = [sum(map(secrets._pool, s)) + 0.3]
        if low[a:b] in secrets.RANK:
            found.append(secrets.RANK[low[a:b]] + (0.3 if low[a:b] != s else 0))
        elif plain[a:b] in secrets.RANK:
            found.append(secrets.RANK[plain[a:b]] + 0.6 + 0.3)
        m = secrets.DATE.match(value, a)
        if m and m.end() == b:
            found.append(math.log10(365 * 120) if len(s) > 4 else math.log10(120))
        steps = list(zip(low[a:b], low[a + 1:b]))
        if len(s) >= 3 and all(p in secrets.BESIDE for p in steps):
            ups = [ord(y) > ord(x) for x, y in steps]
            found.append(math.log10(48 * len(s)) + 0.6 * sum(x != y for x, y in zip(ups, ups[1:])))
        for unit in range(1, 9):
            k = len(s) // unit
            if k > 1 and s == s[:unit] * k and value[b:b + unit] != s[:unit]:
                found.append(sum(map(secrets._pool, s[:unit])) + math.log10(k) + 0.3)
        return min(found)

    def cost(a):
        if a == len(value):
            return 0.0
        return min(part(value[a:b], a) + (1.0 if a else 0) + cost(b) for b in range(a + 1, len(value) + 1))
    return cost(0)


@pytest.mark.parametrize("value", ["", "a", "password", "P4ssw0rd", "qwerty12", "20240131", "aaaaaaa", "ababab1", "x9$Kq2!", "admin2023", "zxcvbnm", "tokenkey"])
def test_cost_equals_all_segmentations(value):
    assert secrets.guess_cost(value) == pytest.approx(slow_cost(value))


def test_costs_are_ordered():
    easy = ["password", "password123", "qwertyuiop", "aaaaaaaaaaaa", "20240131", "monkey2024", "abcabcabcabc"]
    hard = ["x9$Kq2!mZw81", "45bb0d53635bf1b89d", "Tr0ub4dor&3xYz9"]
    assert max(map(secrets.guess_cost, easy)) < secrets.HARD < min(map(secrets.guess_cost, hard))
    assert secrets.guess_cost("z8" * 5000) < secrets.guess_cost("z8k3Pq1" + "mX0" * 7)


def test_contexts():
    text = "pwd=password123 pwd: x9$Kq2!mZw81 Bearer kJ8s7Df6gH5jK4l3 https://me:Zx81!kdQpw0e@host pass=${SECRET_VALUE} auth=2024-01-31 é pin='q8Zr1Wv90xT'"
    found = [text[a:b] for a, _, b in secrets.guess_spans(text)]
    assert found == ["x9$Kq2!mZw81", "kJ8s7Df6gH5jK4l3", "Zx81!kdQpw0e", "q8Zr1Wv90xT"]
    assert secrets.guess_spans("no context x9$Kq2!mZw81") == [] and secrets.guess_spans("a:b=c " * 1000) == []


def test_redaction_and_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0, 1), (2, "", 0, 2), (3, "a token=abcdef1234567890abcdef12 b AKIA" + "B" * 16, 9, 3), (3, "clean", 5, 4),
                                  (4, "x" * 300_000 + " password=hunter22", 1, 5)], "doc_id long, text string, n_chars long, spans int")
    got = {r.spans: r for r in secrets.redact_stage(spark, docs, SF).collect()}
    assert got[1].text is None and got[1].n_chars is None and got[2].text == "" and got[4].text == "clean"
    assert got[3].text == "a [ASSIGN] b [ACCESS]" and got[3].n_chars == 21 and got[5].text.endswith("x [ASSIGN]")
    s = {r.spans: r.s for r in docs.select("spans", secrets.scan(F.col("text")).alias("s")).collect()}
    assert s[1].base == s[2].base == "" and s[3].base == "assign:2:32,hex:8:32,access:35:55"
    assert secrets.redact_stage(spark, docs.limit(0), SF).count() == 0


HIDDEN = ['password = "x!9fK2#pQz7Lw"', "token: $k9!fQ2pLz7", "secret_key: kJ8s7Df6gH5jK4l3", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPx",
          "STRIPE_PRIVATE_KEY=kJ8s7Df6gH5jK4l3", "SMTP_PASS=kJ8s7Df6gH5", "password=Tr0ub4dor&3xYz9", "Authorization: Bearer kJ8s7Df6gH5jK4l3",
          "auth: password: x!9fK2#pQ", "pwd=x!9fK2@pQz,7Lw", "pass=%9fK!2pQz7Lw", "password='ab@cd,Ef;12!x9'"]


@pytest.mark.parametrize("text", HIDDEN)
def test_whole_values_of_common_contexts(text):
    """The value is one span up to its end, and nothing of it is left."""
    value = re.split(r"[=:] ?(?:Bearer )?", text)[-1].strip("\"'")
    assert [text[a:b] for a, _, b in secrets.guess_spans(text)] == [value]
    left = secrets.redacted(f"a {text} b")
    assert not any(value[i:i + 3] in left for i in range(len(value) - 2)) and secrets.redacted(left) == left


def test_placeholders_and_ends_of_values():
    text = "pass=${X_VALUE_A} pass=%PASS_WORD% token={secret_name} pwd=******** pwd=xxxxxxxxxx password=<mypassword> compass: qpwoeiruty1x"
    assert secrets.guess_spans(text) == []
    assert secrets.redacted("u?token=kJ8s7Df6gH5jK4l3&user=bobby") == "u?[ASSIGN]&user=bobby"
    assert secrets.redacted("password=abcdef&1 b") == "[ASSIGN] b"


PLAIN = ["auth: considerations", "see pin: somewhere", "credentials: documentation.", "signature: handwritten", "Authorization: required"]


def test_plain_words_of_the_corpus_are_no_secrets(spark):
    """Words that the corpus uses in its prose are cheap, a value that stands in credentials alone stays hard, however often it is there."""
    prose = "The considerations, somewhere in the documentation (handwritten notes), are required. "
    docs = spark.createDataFrame([(i, prose * 3 + PLAIN[i % 5] + " and token: qzxvkjhwpfmt rest") for i in range(40)], "doc_id long, text string")
    words = secrets.lexicon(docs)
    assert {"considerations", "documentation", "handwritten"} <= set(words) and "qzxvkjhwpfmt" not in words
    ranks = secrets.Ranks(words)
    assert all(secrets.guess_spans(t, ranks=ranks) == [] for t in PLAIN) and len(secrets.guess_spans("pin: qzxvkjhwpfmt", ranks=ranks)) == 1
    spans = [r.s.spans for r in docs.select(secrets.scan(F.col("text"), words).alias("s")).collect()]
    assert all(s.count("guess:") == 1 and s.count("assign:") == 1 for s in spans)


def test_lexicon_is_ordered_and_bounded(spark):
    docs = spark.createDataFrame([("bbb aaa aaa ccc ccc. Ddd x = eee eee",), (None,), ("ddd",)], "text string")
    assert secrets.lexicon(docs) == ["aaa", "ccc", "ddd"] or secrets.lexicon(docs)[:2] == ["aaa", "ccc"]
    assert secrets.lexicon(docs, 1) == ["aaa"] and secrets.lexicon(docs.limit(0)) == []
