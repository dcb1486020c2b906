"""The pipeline's rows against a plain Python version of the same stages."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from keystrata.llm import mixing, packing, pii, quality

from . import test_mixing, test_quality, test_simhash


SPACE = " \t\n\x0b\x0c\r"


def brute_kept(text):
    """The verdict of the quality rules, rule by rule."""
    n_words, word_chars, n_symbols, n_dup, _, failed = test_quality.brute(text)
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    bullets = sum(x.strip(SPACE)[0] in "-*•·–" for x in lines)
    dots = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    return not failed and (
        2.5 * n_words <= word_chars <= 12 * n_words
        and n_symbols <= 0.1 * n_words
        and stop >= 0.03 * n_words
        and n_dup <= 0.4 * len(lines)
        and bullets <= 0.9 * len(lines)
        and dots <= 0.3 * len(lines)
    )


def brute_sampled(rows):
    """The ids that mixing takes, by raked probabilities and the hash of the id."""
    key, p = test_mixing.brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows], mixing.TARGETS, mixing.BUDGET, mixing.ROUNDS)
    uniform = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32
    return {r["doc_id"] for k, r in enumerate(rows) if uniform(r["doc_id"]) < p[key[k]]}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    step = {n: f for n, f in corpus_pipeline.STAGES}

    kept = step["quality"](spark, docs, sf)
    names = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and names == {r["doc_id"] for r in rows if brute_kept(r["text"])}
    assert 0 < len(names) < len(rows)
    rows = [r for r in rows if r["doc_id"] in names]

    unique = step["near_duplicates"](spark, kept, sf)
    comp = test_simhash.brute_components([r["doc_id"] for r in rows], [test_simhash.brute_fp(r["text"]) for r in rows])
    rows = [r for r, c in zip(rows, comp) if r["doc_id"] == c]
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(r["doc_id"] for r in rows)

    clean = step["personal_data"](spark, unique, sf)
    for r in rows:
        r["text"] = pii.masked(r["text"])
    assert clean.columns == docs.columns and {(r.doc_id, r.text, r.n_chars) for r in clean.collect()} == {(r["doc_id"], r["text"], len(r["text"])) for r in rows}
    assert not any(k in pii.BASE for r in rows for k, _, _ in pii.find(r["text"]))

    mixed = step["mixing"](spark, clean, sf)
    ids = {r.doc_id for r in mixed.collect()}
    assert mixed.columns == docs.columns and ids == brute_sampled(rows) and 0 < len(ids) < len(rows)
    rows = [r for r in rows if r["doc_id"] in ids]

    t = Tokenizer.from_file(packing.VOCABULARY)
    tokens = {r["doc_id"]: np.array(t.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in rows}
    got = corpus_pipeline.run(spark, sf).collect()
    covered, places = defaultdict(int), defaultdict(list)
    for r in got:
        assert zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(tokens[r.doc_id]) == r.doc_tokens
        covered[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.offset + r.length))
    assert covered == {d: len(x) for d, x in tokens.items()}
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= packing.WINDOW
    assert len(places) <= sum(covered.values()) / packing.WINDOW + 2


def test_stages_take_odd_tables(spark):
    """Nulls in every column, repeated rows, empty tables, extra columns with the operators' own names."""
    clean = test_quality.CLEAN
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, _nth string, shard string, _mix_p double, digest binary"
    rest = (None, 1, "x", "y", 0.5, None)
    rows = [(1, clean, "en", "s", *rest), (1, clean, "en", "s", *rest), (None, clean + " and one more", None, None, *rest), (2, None, None, None, *rest), (3, "", "en", "s", *rest), (None, None, None, None, *rest)]
    rows.append((4, clean.replace("river", "a.b@c.example"), "de", None, *rest))
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert packed.agg({"length": "sum"}).first()[0] == (sum(len(packing.encode(r[1])) for r in table) if table else None)
    docs = spark.createDataFrame(rows, schema)
    step = dict(corpus_pipeline.STAGES)
    assert step["quality"](spark, docs, "").count() == 4
    kept = step["near_duplicates"](spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) in (["1", "2", "4", "None", "None"], ["1", "2", "None", "None"])
    assert sum("[EMAIL]" in (r.text or "") for r in step["personal_data"](spark, docs, "").collect()) == 1


def test_very_long_texts_pass_every_stage(spark):
    """Megabytes of text among ordinary ones: whole through every stage."""
    clean = test_quality.CLEAN
    long = " ".join(f"{clean} part {k} of the long one.\n" for k in range(3000))
    docs = spark.createDataFrame([(1, clean, "en", "s", 1), (2, long, "en", "s", 2), (3, "token=" * 200_000, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    step = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in step["quality"](spark, docs, "").select("doc_id").collect()} == {r for r, t in ((1, clean), (2, long), (3, "token=" * 200_000)) if brute_kept(t)}
    assert step["near_duplicates"](spark, docs, "").count() == 3
    assert [len(r.text) for r in step["personal_data"](spark, docs, "").orderBy("doc_id").collect()][1:] == [len(long), 1_200_000]
    assert step["mixing"](spark, docs, "").columns == docs.columns
    packed = step["packing"](spark, docs, "").filter("doc_id = 2").collect()
    assert sum(r.length for r in packed) == len(packing.encode(long)) and all(r.doc_tokens == len(packing.encode(long)) for r in packed)
