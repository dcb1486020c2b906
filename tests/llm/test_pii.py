import hashlib
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import pii


def brute(text):
    out = []
    for kind, p in pii.BASE_PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.BASE.index(x[0])))


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


CASES = [
    "", "a@b", "a@b.c", "a@b.c@d.e.f", "é.x@y.z, 1.2.3.4.5.6.7.8.9", "256.1.1.1 255.255.255.255", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
    "+1 (578) 555-6437 4918187128635271", "+12-", "+1 23456789)", "++123456789", "+1234567890123456", "x@@y.z", "a@b..c", "..@-.-", "1 2  3", "@", "+", "9", "+٣ 123 456 789 0", "٣1.1.1.1",
    "a@b.c.", "%+-@a.b-", "4111111111111111.1.1.1", "a" * 5000 + "@", "1." * 3000, "1-" * 3000, "+1" + " " * 3000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_cases(text):
    assert base(text) == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@%+-() 0123459é:/=\n", max_size=60))
def test_base_is_the_patterns(text):
    assert base(text) == brute(text)


def test_added_kinds():
    t = 'account number: 12345678 x; token = "769b0074ad8f3a10fee0689c8d788a140298285a" and password=b3ce824dc6b4735759 see https://me:pw@host.example/x?y=1 or https://plain.example'
    got = {k: t[a:b] for k, a, b in pii.find(t) if k in pii.ADDED}
    assert got == {"account": "12345678", "secret": "b3ce824dc6b4735759", "url": "https://me:pw@host.example/x?y=1"}
    assert sum(k == "secret" for k, _, _ in pii.find(t)) == 2
    assert pii.find("the accountant took no account of tokens, a secret: unknown words; 10 accounts") == []


#: The added kinds as whole patterns after their cue, tried at every cue.
PATTERNS = {
    "account": (pii.ACCOUNT_CUES, pii._ACCOUNT.pattern, 4),
    "secret": (pii.SECRET_CUES, r"[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9+/_.=-]{8,})", 2),
}


def brute_added(text):
    out = []
    for kind, (cues, pattern, least) in PATTERNS.items():
        done = 0
        cue = re.compile("(?=(" + "|".join(cues) + "))", re.I | re.A)
        for m in sorted(cue.finditer(text), key=lambda m: m.end(1)):
            a, b = m.span(1)
            if a < done or kind == "account" and a and text[a - 1].isalnum():
                continue
            if (v := re.compile(pattern, re.A).match(text, b)) and sum(c.isdigit() for c in v[1]) >= least:
                out.append((kind, *v.span(1)))
                done = v.end(1)
    done = 0
    for m in re.finditer("://", text):
        if m.start() < done:
            continue
        head = re.search(r"[A-Za-z0-9+.-]+$", text[done : m.start()])
        tail = re.compile(r"[^\s/?#@\"'<>]+:[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*").match(text, m.end())
        if head and tail:
            out.append(("url", done + head.start(), tail.end()))
            done = tail.end()
    return sorted(out, key=lambda x: (x[1], pii.RANK[x[0]]))


PARTS = ["token", "apiKey", "API_KEY", "Password", "account", "IBAN", " no.", "id", "=", ":", " ", "\"", "://", "x", "@", "a1", "7", "12345", "DE", "-", "/", ".", "é", "\n", "secret", "abcdefgh"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_added_kinds_against_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.ADDED] == brute_added(text)


@pytest.mark.parametrize("unit", ["token=", "x://a:a:", "a:", "x://" + "a:" * 50, "a@", "1.1.1.", "4 ", "+1 ", "account 1", "iban A1 ", "secret: token=", "a@b.", "://", "é@"])
def test_a_megabyte_of_anything_is_linear(unit):
    text = ("x://" if unit == "a:" else "") + unit * ((1 << 20) // len(unit))
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 8  # some tenths of a second to two; quadratic would be hours


def test_cues_in_any_case():
    for cue in ("apiKey", "ApiKey", "API_KEY", "passWord", "toKen"):
        assert [k for k, _, _ in pii.find(f"{cue} = a1b2c3d4e5")] == ["secret"]


def test_frames(spark):
    rows = [(1, "write to a.b@c.example now, from 10.0.0.1", "x"), (1, "write to a.b@c.example now, from 10.0.0.1", "x"), (2, None, None), (None, "+1 (578) 555-6437", "y"), (3, "", "z"), (4, "clean text é", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.report(df).collect()), key=str)
    want = []
    for d, t, _ in rows:
        b = brute(t or "")
        s = ",".join(f"{k}:{x}:{y}" for k, x, y in b)
        want.append((d, *(sum(k == q for k, _, _ in b) for q in pii.BASE), hashlib.sha256(s.encode()).hexdigest(), s, len(b)))
    assert got == sorted(want, key=str)
    red = pii.redacted(df)
    assert red.columns == df.columns
    assert {(r.doc_id, r.text) for r in red.collect()} == {(1, "write to [EMAIL] now, from [IP]"), (2, None), (None, "[PHONE]"), (3, ""), (4, "clean text é")}
    assert pii.report(df.limit(0)).count() == 0 and pii.redacted(df.limit(0)).count() == 0


def test_sql_gives_the_same_spans():
    rnd = random.Random(7)
    parts = [*PARTS, "+12 345 678 9", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+", "(", "\u00a0", "\u0130", "konto", "cuenta", "0", "256.", "-"]
    texts = [*CASES, None] + ["".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(5000)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = con.execute(pii.ORACLE_SQL).df().set_index("doc_id")
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        spans = pii.find(text)
        of = [s for s in spans if s[0] in pii.BASE]
        row = got.loc[d]
        assert row["spans"] == pii.joined(spans), text
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in of) for k in pii.BASE]
        assert row["base_sha256"] == hashlib.sha256(pii.joined(of).encode()).hexdigest() and row["n_spans"] == len(spans)
