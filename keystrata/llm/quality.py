"""Rule-based document quality in one Spark projection, without user functions.

Counts of words, symbols, repeated lines and repeated word windows come from built-in string and array
functions over the whole text; ``RULES`` is a table of ratios with their bounds that ``verdict`` compiles
into the same projection.  No shuffle: a document is judged in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this are at from or have not but they which you were "
    "de la le les et des un une du en que qui est pour dans par au sur pas avec il elle ce son "
    "der die das und ist von zu den mit im nicht ein eine auf sich dem für als auch es an "
    "el los las y por con para su se al lo como más del una o sus fue"
).split()


class Rule(NamedTuple):
    """``numerator / denominator`` must lie within ``[low, high]``; a bound that is None doesn't hold, nor does a zero denominator."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The threshold table.  Every name is a count of ``counts``.
RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("mean_word_chars", "word_chars", "n_words", 2.5, 12),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.03, None),
    Rule("repeated_line_ratio", "n_dup_lines", "n_lines", None, 0.4),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in a window of three that the text holds twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; the positions found are merged.
    """

    def of(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def marked(s: Column) -> Column:
            n = F.size(s)
            at = F.transform(
                s,
                lambda x, j: F.when(
                    ((j > 0) & (F.get(s, j - 1)["w"] == x["w"])) | ((j < n - 1) & (F.get(s, j + 1)["w"] == x["w"])),
                    x["i"],
                ),
            )
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
            return F.aggregate(
                F.sort_array(F.filter(at, lambda i: i.isNotNull())),
                start,
                lambda a, i: F.struct((i + 3).alias("end"), (a["total"] + i + 3 - F.greatest(i, a["end"])).alias("total")),
                lambda a: a["total"],
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(pairs, marked))

    three = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(_let(three, of))


def counts(text: Column) -> Column:
    """All counts of one text as a struct of longs; a null text has none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def by_words(w: Column) -> Column:
        stop = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
        return F.struct(F.size(w).cast("long").alias("n_words"), stop.cast("long").alias("n_stop_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))

    def by_lines(x: Column) -> Column:
        bullets = F.size(F.filter(x, lambda v: F.btrim(v, F.lit(SPACES)).substr(1, 1).isin("-", "*", "•", "·", "–")))
        dots = F.size(F.filter(x, lambda v: F.rtrim(v).endswith("...") | F.rtrim(v).endswith("…")))
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            bullets.cast("long").alias("n_bullet_lines"),
            dots.cast("long").alias("n_ellipsis_lines"),
        )

    w, x = _let(words, by_words), _let(lines, by_lines)

    def all_of(w: Column, x: Column) -> Column:
        return F.struct(
            w["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            w["n_stop_words"].alias("n_stop_words"),
            *(x[k].alias(k) for k in ("n_lines", "n_bullet_lines", "n_ellipsis_lines")),
        )

    return _let(w, lambda a: _let(x, lambda b: all_of(a, b)))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def verdict(c: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the counts break, in the table's order."""
    broken = []
    for r in rules:
        value, over = c[r.numerator].cast("double"), c[r.denominator].cast("double") if r.denominator else F.lit(1.0)
        # products, not quotients: no division by zero, and exact at the bounds
        bad = [value < F.lit(float(r.low)) * over] if r.low is not None else []
        bad += [value > F.lit(float(r.high)) * over] if r.high is not None else []
        test = bad[0] if len(bad) == 1 else bad[0] | bad[1]
        broken.append(F.when(test & (over > 0), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def scored(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``broken_rules`` and ``kept``.

    Null, empty and blank texts have zero counts and fail.  A null ``doc_id`` and repeated rows are judged
    like any other, and so are very long texts; an empty table gives no rows; extra columns are ignored.
    """
    c = F.col("c")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), counts(F.col("text")).alias("c"))
        .select("doc_id", "c", base_failed(c).alias("base_failed"), verdict(c, rules).alias("broken_rules"))
        .select("doc_id", *(c[n].alias(n) for n in names), "base_failed", "broken_rules", (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"))
    )


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    ok = _let(counts(docs["text"]), lambda c: ~base_failed(c) & (F.size(verdict(c, rules)) == 0))
    return docs.filter(ok)


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        v, o = f"c.{r.numerator}::double", f"c.{r.denominator}::double" if r.denominator else "1::double"
        for bound, op in ((r.low, "<"), (r.high, ">")):
            if bound is not None:
                tests.append(f"({v} {op} {float(bound)}::double * {o} AND {o} > 0)")
    sp = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
x AS (SELECT rid, i, words[i] AS word, CASE WHEN i + 2 <= len(words) THEN words[i] || ' ' || words[i+1] || ' ' || words[i+2] END AS win
      FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) > 1 AND win IS NOT NULL AS rep FROM x),
m AS (SELECT rid, i, max(rep::int) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cov FROM r),
rw AS (SELECT rid, sum(cov)::bigint AS n_repeat_words FROM m GROUP BY rid),
sw AS (SELECT rid, count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words FROM x GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
       count(*) FILTER (trim(line, {sp})[1] IN ('-', '*', '•', '·', '–')) AS n_bullet_lines,
       count(*) FILTER (rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%…') AS n_ellipsis_lines
       FROM l WHERE trim(line, {sp}) <> '' GROUP BY rid),
c AS (SELECT d.doc_id, len(words)::bigint AS n_words,
      length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
      (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols,
      coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
      coalesce(n_stop_words, 0)::bigint AS n_stop_words, coalesce(n_lines, 0)::bigint AS n_lines,
      coalesce(n_bullet_lines, 0)::bigint AS n_bullet_lines, coalesce(n_ellipsis_lines, 0)::bigint AS n_ellipsis_lines
      FROM d JOIN w USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN sw USING (rid) LEFT JOIN ls USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept FROM v AS c
"""


ORACLE_SQL = _oracle()
