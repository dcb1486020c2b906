"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and identifier cues.  From each
anchor a deterministic local parser expands to the boundaries of the value and validates it.  No run is expanded
twice, also where its value is refused, so the work is linear in the text.  Cues match in any case of A-Z.

Base kinds, leftmost and non-overlapping per kind (``email``, ``ip``, ``card``, ``phone``), are those of the
patterns in ``BASE_PATTERNS``, which only the tests compile.  Further kinds: ``account`` (identifier after
an account cue), ``secret`` (value assigned to a credential cue), ``url`` (address with credentials in it).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret", "url")
RANK = {k: i for i, k in enumerate(BASE + ADDED)}

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "social security", "customer id", "member id", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "api key", "secret", "passwort")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"[\x20().0-9-]+")
_ACCOUNT = re.compile(r"(?i:[\x20_-]?(?:number|no|nr|num|id)\b\.?)?[\x20]?[:#=]?[\x20]?([A-Z]{0,4}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", re.ASCII)
_ASSIGNED = re.compile(r"[\x20]?[:=][\x20]?[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_USER = re.compile(r"[^\s/?#@\"'<>]+")
_HOST = re.compile(r"@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d += d - 9 if d > 4 else d
        total += d
    return total % 10 == 0


def find(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed; a null text has none."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*BASE, *ADDED, "at"), 0)
    refused = 0  # where the last run ends that holds no secret: a later part of it holds none either
    # of bytes only A-Z are lowered, so places stay the same
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (anchor, width) in _anchors().iter(lowered):
        at = last + 1 - width
        if anchor == "digit":
            if at >= done["ip"]:
                m = _DOTTED.match(text, at)
                done["ip"] = m.end()
                if m.end() - at > 6 and m[0].count(".") > 2:
                    parts, begin = m[0].split("."), at
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = begin + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in four):
                            found.append(("ip", begin, end))
                        begin = end + 1
            if at >= done["card"]:
                m = _SPACED.match(text, at)
                done["card"] = m.end()
                if m.end() - at > 11:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, m.end()))
        elif anchor == "at":
            begin, floor = at, max(done["email"], done["at"])
            while begin > floor and text[begin - 1] in LOCAL:
                begin -= 1
            done["at"] = at + 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                found.append(("email", begin, m.end()))
                done["email"] = m.end()
        elif anchor == "plus":
            if text[at + 1 : at + 2].isdigit() and text[at + 1] <= "9" and (m := _DIALLED.match(text, at + 2)):
                end = at + 2 + len(m[0].rstrip(" ().-"))
                if end > at + 3 and 9 <= sum(c.isdigit() for c in text[at:end]) <= 15:
                    found.append(("phone", at, end))
        elif at >= done["url" if anchor == "scheme" else anchor]:
            if anchor == "scheme":
                begin = at
                while begin > done["url"] and (text[begin - 1].isalnum() or text[begin - 1] in "+.-") and text[begin - 1].isascii():
                    begin -= 1
                # name and password are one run up to the at-sign with a colon inside
                if begin < at and (m := _USER.match(text, at + 3)) and ":" in m[0][1:-1] and (host := _HOST.match(text, m.end())):
                    found.append(("url", begin, host.end()))
                    done["url"] = host.end()
            elif anchor == "account":
                if not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 4:
                    found.append((anchor, m.start(1), m.end(1)))
                    done[anchor] = m.end(1)
            elif (m := _ASSIGNED.match(text, last + 1)) and m.end() >= refused and (m := _SECRET.match(text, m.end())):
                if sum(c.isdigit() for c in m[0]) >= 2:
                    found.append((anchor, m.start(), m.end()))
                    done[anchor] = m.end()
                else:
                    refused = m.end()
    found.sort(key=lambda x: (x[1], RANK[x[0]]))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column(1):
            spans = find(text.as_py())
            base = [s for s in spans if s[0] in BASE]
            for k, kind in enumerate(BASE):
                cols[k].append(sum(s[0] == kind for s in base))
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined(spans))
            cols[6].append(len(spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])


def report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, counts of base kinds, digest of base spans, all spans and their number.

    Null and empty texts have none; null ids and repeated rows each give a row, very long texts are read whole in
    time linear in their length, an empty table gives no rows; extra columns are ignored.
    """
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` masked; a null text stays null."""
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            text = pa.array([masked(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(text if k == at else c for k, c in enumerate(batch.columns))], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


# The same spans in SQL, by whole patterns.  RE2 has no look-ahead: what may not follow an account is taken with it.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_URL_SQL = rf"[A-Za-z0-9+.-]+://[^{_SPACE}/?#@\"'<>]+:[^{_SPACE}/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^{_SPACE}\"'<>]*"
#: What follows a cue up to the value, the value, and the digits that it must hold.
_AFTER = {
    "account": (r"(?i:[\x20_-]?(?:number|no|nr|num|id)\b\.?)?[\x20]?[:#=]?[\x20]?", r"[A-Z]{0,4}[0-9](?:[\x20-]?[A-Z0-9]){5,33}", r"(?:[^A-Za-z0-9]|\z)", 4),
    "secret": (r"[\x20]?[:=][\x20]?[\"']?", r"[A-Za-z0-9+/_.=-]{8,}", "", 2),
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _oracle() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    valid = {
        "email": "true",
        "ip": "list_bool_and([length(ltrim(x, '0')) < 4 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) < 256 FOR x IN string_split(v, '.')])",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN c WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END"
        f" FOR c, k IN list_transform(string_split(reverse({digits}), ''), lambda x: x::INT)]) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "url": "true",
    }
    whole = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, {RANK[kind]} AS rank, a, a + length(v) AS b FROM (SELECT rid, v, sum(length(gap)) OVER o + sum(length(v)) OVER o - length(v) AS a"
        f" FROM (SELECT rid, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap, unnest(found) AS v"
        f" FROM (SELECT rid, regexp_extract_all(t, {p}) AS found, regexp_split_to_array(t, {p}) AS gaps FROM d))"
        f" WHERE v IS NOT NULL WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE {valid[kind]}"
        for kind, p in ((kind, _quoted(p)) for kind, p in (BASE_PATTERNS | {"url": _URL_SQL}).items())
    )
    places = " UNION ALL ".join(
        f"SELECT rid, t, '{kind}' AS kind, {len(cue)} + place AS cue_end, place FROM (SELECT rid, t, i, len(gaps) AS n, (sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) + (i - 1) * {len(cue)})::BIGINT AS place"
        f" FROM (SELECT rid, t, gaps, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap FROM (SELECT rid, t, string_split(low, '{cue}') AS gaps FROM d))) WHERE i < n"
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES))
        for cue in cues
    )
    values = " UNION ALL ".join(
        f"SELECT rid, kind, place, cue_end, cue_end + length(regexp_extract(tail, {p}, 1)) AS a, regexp_extract(tail, {p}, 2) AS v, {least} AS least"
        f" FROM places WHERE kind = '{kind}' AND regexp_matches(tail, {p})" + (r" AND NOT regexp_matches(prior, '[\pL\pN]')" if kind == "account" else "")
        for kind, p, least in ((kind, _quoted(f"^({before})({value}){after}"), least) for kind, (before, value, after, least) in _AFTER.items())
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    joined_sql = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
whole AS ({whole}),
places AS (SELECT rid, kind, place, cue_end, substr(t, cue_end + 1) AS tail, CASE WHEN place > 0 THEN substr(t, place, 1) ELSE '' END AS prior FROM ({places})),
val AS (SELECT rid, kind, place, a, a + length(v) AS b, row_number() OVER (PARTITION BY rid, kind ORDER BY cue_end) AS k FROM ({values})
        WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= least),
walk AS (SELECT rid, kind, k, a, b, b AS done, true AS taken FROM val WHERE k = 1
         UNION ALL SELECT w.rid, w.kind, x.k, x.a, x.b, CASE WHEN x.place >= w.done THEN x.b ELSE w.done END, x.place >= w.done
         FROM walk AS w JOIN val AS x ON x.rid = w.rid AND x.kind = w.kind AND x.k = w.k + 1),
spans AS (SELECT rid, kind, rank, a::BIGINT AS a, b::BIGINT AS b FROM whole
          UNION ALL SELECT rid, kind, CASE kind WHEN 'account' THEN {RANK["account"]} ELSE {RANK["secret"]} END, a, b FROM walk WHERE taken),
s AS (SELECT rid, {base}, {joined_sql} FILTER (rank < {len(BASE)}) AS base, {joined_sql} AS spans, count(*) AS n FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n, 0)::BIGINT AS n_spans
FROM d LEFT JOIN s USING (rid)
"""


#: DuckDB SQL of ``report``'s rows over ``documents``.
ORACLE_SQL = _oracle()
