"""Licence scan by canonical digest lookup: DataFrame expressions only.

A text is lower-cased, its copyright lines go, every run of anything but letters and digits becomes one space,
and equivalent spellings become one.  Its SHA-256 is hash-joined to the digests of the known texts, which are
made by the same expressions, or to digests alone where the text is long (Apache, GPL, LGPL, MPL, CC).  The known
side is the constant table of ``license_texts`` (some dozens of rows), so broadcasting it is bounded.  One-line notices are looked up the same way, line by line, within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

#: A line that states a copyright, with what may stand before it in a comment.
COPYRIGHT_LINE = r"(^|\n)[\x20\t\r*/#;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Lines that can be notices: others aren't digested.
NOTICE_HINT = r"licen[cs]e|public domain"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null for null."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, " "), F.lit(" "))
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {found} "), F.lit(f" {kept} "))
    return F.btrim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """``known_digest, license_id`` of the whole texts and the notices, a row per digest."""
    row = lambda i, d: F.struct(F.lit(i).alias("license_id"), d.alias("known_digest"))
    rows = F.array(*(row(i, digest(F.lit(t))) for i, t in TEXTS + NOTICES), *(row(i, F.lit(d)) for i, d in DIGESTS))
    return spark.range(1).select(F.inline(rows)).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def _notices(text: Column) -> Column:
    """Licences that lines of the text name, sorted, each once."""
    by_form = F.create_map(*(x for i, t in NOTICES for x in (canonical(F.lit(t)), F.lit(i))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(NOTICE_HINT))
    named = F.transform(lines, lambda x: F.try_element_at(by_form, canonical(x)))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, digest, license_id`` (of the whole text; null if it is no known text) and ``notices``.

    A null text has a null digest, no licence and no notices; an empty one has the digest of nothing.  Null ids and
    repeated rows pass through; very long texts and lines are read whole; an empty table gives no rows; extra
    columns are ignored.  If two licences had one canonical text the first by name would be given.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    own = docs.select("doc_id", digest(text).alias("digest"), F.coalesce(_notices(text), F.array().cast("array<string>")).alias("notices"))
    table = F.broadcast(known(spark))
    return own.join(table, own["digest"] == table["known_digest"], "left").select("doc_id", "digest", "license_id", "notices")


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '\\1', 'g')"
        out = f"' ' || regexp_replace({out}, '{NOT_WORD}', ' ', 'g') || ' '"
        for found, kept in SPELLINGS:
            out = f"replace({out}, ' {found} ', ' {kept} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"

    rows = ", ".join(f"({quoted(i)}, {quoted(t)}, {k})" for k, part in ((0, TEXTS), (1, NOTICES)) for i, t in part)
    return f"""
WITH known(license_id, t, notice) AS (VALUES {rows}),
k AS (SELECT sha256({form("t")}) AS known_digest, min(license_id) AS license_id FROM known GROUP BY 1),
n AS (SELECT {form("t")} AS form, min(license_id) AS license_id FROM known WHERE notice = 1 GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({form("text")}) AS digest FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
      FROM (SELECT rid, {form("line")} AS form FROM l WHERE regexp_matches(lower(line), '{NOTICE_HINT}')) AS x JOIN n ON x.form = n.form GROUP BY rid)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON d.digest = k.known_digest LEFT JOIN m ON d.rid = m.rid
"""


ORACLE_SQL = _oracle()
