import hashlib
import re
from pathlib import Path

import pytest

from keystrata.llm import licenses, license_texts


def brute(text):
    t = re.sub(r"(^|\n)[\x20\t\r*/#;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*", r"\1", text.lower())
    t = " " + re.sub(r"[\W_]+", " ", t) + " "
    for a, b in license_texts.SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return re.sub(" +", " ", t).strip(" ")


MIT = license_texts.TEXTS[1][1]
TEXTS = {
    1: MIT,
    2: "MIT LICENCE\n\nCopyright (c) 2020 Someone <a@b.c>\nAll rights reserved.\n" + license_texts.TEXTS[0][1].replace("\n", "  \n").replace("sublicense", "sub-license").upper(),
    3: "# " + MIT.replace("\n", "\n# "),
    4: MIT + "\nand one more word",
    5: "Some words of a page.\nLicensed under CC BY-NC 4.0.\nreleased under the MIT licence\nThe end. Licensed under nothing.",
    6: None,
    7: "",
    8: "©",
    9: "licence " * 20_000,
    10: license_texts.TEXTS[8][1].replace("copyright holder", "copyright owner"),
}


def test_scan(spark):
    rows = [(k, t, "x") for k, t in TEXTS.items()] + [(1, MIT, "y"), (None, MIT, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted(((str(r.doc_id), r.digest, r.license_id, list(r.notices)) for r in licenses.scan(df).collect()), key=str)
    ids = {1: "MIT", 2: "MIT", 3: "MIT", 10: "BSD-3-Clause"}
    want = []
    for k, t, _ in rows:
        d = hashlib.sha256(brute(t).encode()).hexdigest() if t is not None else None
        want.append((str(k), d, "MIT" if k is None else ids.get(k), ["CC-BY-NC-4.0", "MIT"] if k == 5 else []))
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_each_known_text_is_found(spark):
    rows = [(k, t) for k, (_, t) in enumerate(license_texts.TEXTS + license_texts.NOTICES)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: i for k, (i, _) in enumerate(license_texts.TEXTS + license_texts.NOTICES)}


def test_notices_in_lines_of_any_length(spark):
    rows = [(1, "/" + "*" * 300 + " Licensed under the MIT License. " + "*" * 5000 + "/"), (2, "x\n#" + " " * 250 + "Licensed under\tCC BY 4.0." + " -" * 150 + "\ny"), (3, "Licensed under the MIT License." + " and more" * 30)]
    got = {r.doc_id: list(r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-4.0"], 3: []}


FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
SHARED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not SHARED.exists(), reason="the system has no licence texts")
def test_full_texts(spark):
    texts = {i: (SHARED / f).read_text() for f, i in FULL.items()}
    end = "END OF TERMS AND CONDITIONS"
    rows = [(i, t) for i, t in texts.items()] + [(i, t[: t.index(end) + len(end)]) for i, t in texts.items() if end in t] + [(i, t[: t.index(end)]) for i, t in texts.items() if end in t]
    rows += [("none", t + " more") for t in texts.values()] + [("none", t[: len(t) // 2]) for t in texts.values()]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.license_id or "none") for r in got) == sorted((i, i) for i, _ in rows)


def test_digests_are_distinct():
    assert len({d for _, d in license_texts.DIGESTS}) == len(license_texts.DIGESTS) and all(re.fullmatch("[0-9a-f]{64}", d) for _, d in license_texts.DIGESTS)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
