import re
from collections import Counter

from keystrata.llm import quality


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    win = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)


CLEAN = " ".join(f"the {k} of a {k}ing was by it and to{k} for {k}s is not with un{k}" for k in ("house", "river", "stone", "field", "garden", "meadow"))
TEXTS = [
    None, "", " \t\r\n\x0b\x0c ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x y z x y", "é b  c", "l1\nl2\nl1\n\n \nl1 \nl2", "# * $ % & | < > ##",
    "a b c d e f g h " * 20, CLEAN, "\n".join(["same line of the text"] * 30), "word### " * 60, " lead", "trail ", "\x1c\x1d", "q w e r t y " * 3 + "tail q w e",
]


def test_counts(spark):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(3, "a", 9), (None, CLEAN, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = Counter(tuple(r) for r in quality.scored(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((d, *brute(t)) for d, t, _ in rows)


def test_verdict(spark):
    rows = [(1, CLEAN), (2, CLEAN.replace(" ", "### ")), (3, " ".join(f"nonsense{k}" for k in range(80))), (4, "- " + CLEAN.replace(" it ", "\n- it ")), (5, None), (6, CLEAN.replace("was", "was...\n"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS c", "1 AS kept")
    got = {r.doc_id: (r.kept, list(r.broken_rules)) for r in quality.scored(df).collect()}
    assert got[1] == (True, [])
    assert "symbols_per_word" in got[2][1] and not got[2][0]
    assert got[3][1] == ["stop_word_ratio"]
    assert "bullet_line_ratio" in got[4][1]
    assert got[5] == (False, ["length"])
    assert "ellipsis_line_ratio" in got[6][1]
    out = quality.passing(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
    assert quality.scored(df.limit(0)).count() == 0


def test_no_text_fails_for_its_size_alone(spark):
    long = " ".join(f"the house{k} of river{k} was by it{k}" for k in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "word " * 1_000_001)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.kept) for r in quality.scored(df).collect()}
    assert got == {1: (1_050_000, True), 2: (1_000_001, False)}
    assert [r.doc_id for r in quality.passing(df).select("doc_id").collect()] == [1]


def test_no_python_in_the_plan(spark):
    plan = quality.passing(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
