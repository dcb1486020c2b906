"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, language, topic).  Each cell starts with the same sampling
probability; raking then multiplies it by wanted / expected tokens along one marginal after the other,
never above one, for a fixed number of rounds.  What is then left between wanted and expected tokens is
returned as each cell's residual: targets that ask for more tokens of a value than there are cannot be met.
A document is sampled where a uniform number hashed from its id is below its cell's probability, so a rerun
or a lost executor takes the same documents.

Up to ``LOCAL_CELLS`` cells, which are counted first, are raked in memory.  More stay distributed: marginals are
sums by ``groupBy`` (combined before the shuffle, so a value that most cells share is a row per task) joined back to
the cells, which are written once a round.  Both take the same steps.  Documents are read, never moved.

The topic is the cluster of a document's terms: each term votes for the cluster that its hash falls in, and the
cluster with most votes is the topic.  Texts on one subject repeat its terms, so they share a cluster; a caller who
has topics of their own gives the column.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written

UNKNOWN = "(unknown)"
DIMS = ("source", "lang", "topic")

#: Target shares of tokens: an exponent tempers the shares found (0: even, 1: as found); a mapping fixes them,
#: values that it doesn't name share what it leaves in the proportions found.
TARGETS: dict[str, float | Mapping[str, float]] = {"source": 0.7, "lang": 0.5, "topic": 0.8}
#: Share of all tokens to sample, and rounds of raking.
BUDGET, ROUNDS, SEED = 0.7, 8, "mix-1"


#: Topics: a cluster for each hexadecimal digit, and one for texts without a term.  Terms are words of so many bytes.
NO_TOPIC, TERM_BYTES = "none", 6


def topic_of(counts: Mapping[bytes, int], memo: dict[bytes, int]) -> str:
    """The cluster with most terms, of equals the smallest; ``counts`` are of lower-cased words."""
    votes = [0] * 16
    for word, n in counts.items():
        if len(word) >= TERM_BYTES:
            c = memo.get(word)
            if c is None:
                if len(memo) > 1_000_000:  # a cache, made anew: bounded whatever the vocabulary
                    memo.clear()
                c = memo[word] = hashlib.md5(word).digest()[0] >> 4
            votes[c] += n
    top = max(votes)
    return f"t{votes.index(top):x}" if top else NO_TOPIC


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _described(docs: DataFrame, topic: str | None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for words and the three dimensions, under names of their own."""
    own = {k: fresh(docs, f"_mix_{k}") for k in ("words", *DIMS)}
    found = docs.withColumn(own["source"], F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN))).withColumn(own["lang"], F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)))
    given = F.coalesce(F.col(topic).cast("string"), F.lit(NO_TOPIC)) if topic else None
    found = found.withColumn(own["words"], F.col("text").cast("string").cast("binary"))
    schema = T.StructType([f for f in found.schema.fields if f.name != own["words"]] + [T.StructField(own["words"], T.LongType()), T.StructField(own["topic"], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            words, topics = [], []
            for text in batch.column(batch.num_columns - 1):
                w = (text.as_py() or b"").lower().split()
                words.append(len(w))
                topics.append(None if topic else topic_of(Counter(w), memo))
            cols = [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(topics, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    found = found.mapInArrow(run, schema)
    return (found.withColumn(own["topic"], given) if topic else found), own


def _wants(cells: DataFrame, dim: str, target: float | Mapping[str, float], total: float, budget: float) -> DataFrame:
    """``of, want``: the tokens that each value of ``dim`` shall have.  A few sums are read to the driver, never the values."""
    per = cells.groupBy(F.col(dim).alias("of")).agg((F.sum("tokens") / F.lit(total)).alias("s"))
    if isinstance(target, Mapping):
        given = {str(k): float(v) for k, v in target.items()}
        seen = per.agg(F.sum(F.when(~F.col("of").isin(list(given)), F.col("s")))).first()[0] or 0.0
        left = max(0.0, 1.0 - sum(given.values()))
        share = F.col("s") * (left / seen if seen else 0.0)
        for k, v in given.items():
            share = F.when(F.col("of") == k, v).otherwise(share)
    else:
        norm = per.filter("s > 0").agg(F.sum(F.pow("s", F.lit(float(target))))).first()[0] or 1.0
        share = F.when(F.col("s") > 0, F.pow("s", F.lit(float(target))) / F.lit(norm)).otherwise(0.0)
    return per.select("of", (share * F.lit(total * budget)).alias(f"want_{dim}"))


def _with_sums(p: DataFrame, dim: str) -> DataFrame:
    """The cells with ``now``: the tokens that their value of ``dim`` is expected to give."""
    now = p.groupBy(F.col(dim).alias("of")).agg(F.sum(F.col("tokens") * F.col("p")).alias("now"))
    return p.join(now, p[dim] == now["of"]).drop("of")


#: Cells that are raked in memory: some megabytes.
LOCAL_CELLS = 50_000


def _raked_here(cells: pd.DataFrame, targets: Mapping, budget: float, rounds: int) -> pd.DataFrame:
    """``_raked`` over cells in memory."""
    tokens, total = cells["tokens"].to_numpy(float), float(cells["tokens"].sum())
    p, off, codes, wants = np.full(len(cells), float(min(1.0, budget))), np.zeros(len(cells)), {}, {}
    if total > 0:
        for d in DIMS:
            codes[d], values = pd.factorize(cells[d])
            s, target = np.bincount(codes[d], tokens) / total, targets[d]
            if isinstance(target, Mapping):
                given = {str(k): float(v) for k, v in target.items()}
                named = np.array([v in given for v in values])
                rest = s[~named].sum()
                share = s * (max(0.0, 1.0 - sum(given.values())) / rest if rest else 0.0)
                share[named] = [given[v] for v in values[named]]
            else:
                share = np.where(s > 0, s ** float(target), 0.0)
                share /= share.sum() or 1.0
            wants[d] = (share * total * budget)[codes[d]]
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(rounds):
                for d in DIMS:
                    now = np.bincount(codes[d], tokens * p)[codes[d]]
                    p = np.where(now > 0, np.minimum(1.0, p * wants[d] / now), p)
            for d in DIMS:
                now = np.bincount(codes[d], tokens * p)[codes[d]]
                off = np.maximum(off, np.where(wants[d] > 0, np.abs(now / wants[d] - 1), 0.0))
    return cells.assign(probability=p, residual=off)


def _raked(cells: DataFrame, targets: Mapping, budget: float, rounds: int, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``source, lang, topic, documents, tokens, probability, residual`` of cells ``source, lang, topic, documents, tokens``."""
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    total = total or 0.0
    if n <= local_cells:
        schema = T.StructType([*cells.schema.fields, T.StructField("probability", T.DoubleType()), T.StructField("residual", T.DoubleType())])
        raked = _raked_here(cells.toPandas(), targets, budget, rounds)
        # of bounded size, so what is joined to it needn't move
        return F.broadcast(cells.sparkSession.createDataFrame(list(raked.itertuples(index=False, name=None)), schema))
    p = cells.withColumn("p", F.lit(float(min(1.0, budget))))
    off = F.lit(0.0)
    if total > 0:
        for d in DIMS:
            want = _wants(cells, d, targets[d], total, budget)
            p = p.join(want, p[d] == want["of"]).drop("of")
        for _ in range(rounds):
            p = written(p, "round")
            for d in DIMS:
                now = F.col("now")
                p = _with_sums(p, d).withColumn("p", F.when(now > 0, F.least(F.lit(1.0), F.col("p") * F.col(f"want_{d}") / now)).otherwise(F.col("p"))).drop("now")
        p = written(p, "round")
        for d in DIMS:
            p = _with_sums(p, d).withColumnRenamed("now", f"now_{d}")
            want = F.col(f"want_{d}")
            off = F.greatest(off, F.when(want > 0, F.abs(F.col(f"now_{d}") / want - 1)).otherwise(0.0))
    return written(p.select(*DIMS, "documents", "tokens", F.col("p").alias("probability"), off.alias("residual")), "probabilities")


def _summed(described: DataFrame, own: Mapping[str, str]) -> DataFrame:
    cells = described.groupBy(*(F.col(own[d]).alias(d) for d in DIMS)).agg(F.count("*").alias("documents"), F.sum(own["words"]).cast("double").alias("tokens"))
    return written(cells, "cells")


def probabilities(docs: DataFrame, targets: Mapping = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, topic: str | None = None) -> DataFrame:
    """``source, lang, topic, documents, tokens, probability, residual`` per cell.

    ``residual`` is the greatest of the cell's three marginals' |expected / wanted - 1| after the last round.
    Missing sources and languages count as ``(unknown)``.  Cells without a token keep the budget's probability.
    """
    return _raked(_summed(*_described(docs, topic)), targets, budget, rounds)


def _joined(described: DataFrame, own: dict[str, str], p: DataFrame, seed: str) -> tuple[DataFrame, dict[str, str]]:
    own = own | {k: fresh(described, f"_mix_{k}") for k in ("p", "residual", "sampled")}
    p = p.select(*(F.col(d).alias(f"_of_{own[d]}") for d in DIMS), F.col("probability").alias(own["p"]), F.col("residual").alias(own["residual"]))
    on = [described[own[d]] == p[f"_of_{own[d]}"] for d in DIMS]
    joined = described.join(p, on, "left").drop(*(f"_of_{own[d]}" for d in DIMS))
    return joined.withColumn(own["sampled"], _uniform(F.col("doc_id"), F.col("text"), seed) < F.col(own["p"])), own


def decisions(docs: DataFrame, targets: Mapping = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED, topic: str | None = None) -> DataFrame:
    """Per row: ``doc_id, source, lang, topic, n_words, probability, residual, sampled``.

    Rows that repeat a ``doc_id`` in one cell are decided alike; a null ``doc_id`` is replaced by a digest of the text.
    Null and empty texts have no words and no topic; very long texts are counted whole; an empty table gives no rows;
    extra columns are ignored.  Texts are read once: what is written of them is their words and dimensions.
    """
    kept = docs.select("doc_id", "text", "source", "lang", *([F.col(topic).alias("_topic")] if topic else []))
    found, own = _described(kept, "_topic" if topic else None)
    # the text is needed once more where there is no id to hash
    found = written(found.withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text"))), "described")
    d, own = _joined(found, own, _raked(_summed(found, own), targets, budget, rounds), seed)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(own[k]).alias(k) for k in DIMS), F.col(own["words"]).alias("n_words"), F.col(own["p"]).alias("probability"), F.col(own["residual"]).alias("residual"), F.col(own["sampled"]).alias("sampled"))


def sampled(docs: DataFrame, targets: Mapping = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED, topic: str | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with their columns."""
    p = probabilities(docs, targets, budget, rounds, topic)
    d, own = _joined(*_described(docs, topic), p, seed)
    return d.filter(F.col(own["sampled"])).select(*(d[c] for c in docs.columns))


def _oracle() -> str:
    """SQL for ``decisions`` with the default parameters."""
    steps, at = [], "c0"
    for r in range(ROUNDS):
        for d in DIMS:
            name = f"r{r}_{d}"
            now = f"sum(tokens * p) OVER (PARTITION BY {d})"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {now} > 0 THEN least(1.0::double, p * want_{d} / {now}) ELSE p END AS p) FROM {at})")
            at = name
    shares = ", ".join(f"s_{d} AS (SELECT {d}, sum(tokens) / (SELECT t FROM total) AS s FROM cells GROUP BY {d}), n_{d} AS (SELECT sum(pow(s, {float(TARGETS[d])}::double)) AS n FROM s_{d} WHERE s > 0)" for d in DIMS)
    wants = ", ".join(f"CASE WHEN s_{d}.s > 0 THEN pow(s_{d}.s, {float(TARGETS[d])}::double) / (SELECT n FROM n_{d}) ELSE 0 END * (SELECT t FROM total) * {BUDGET}::double AS want_{d}" for d in DIMS)
    joins = " ".join(f"JOIN s_{d} ON cells.{d} = s_{d}.{d}" for d in DIMS)
    off = ", ".join(f"CASE WHEN want_{d} > 0 THEN abs(sum(tokens * p) OVER (PARTITION BY {d}) / want_{d} - 1) ELSE 0 END" for d in DIMS)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang, coalesce(text, '') AS text,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
v AS (SELECT rid, substr(md5(word), 1, 1) AS c, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM w) WHERE octet_length(encode(word)) >= {TERM_BYTES} GROUP BY ALL),
t AS (SELECT rid, 't' || arg_min(c, {{'n': -n, 'c': c}}) AS topic FROM v GROUP BY rid),
d AS MATERIALIZED (SELECT w.rid, doc_id, source, lang, text, len(words)::bigint AS n_words, coalesce(topic, '{NO_TOPIC}') AS topic FROM w LEFT JOIN t USING (rid)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_words)::double AS tokens FROM d GROUP BY ALL),
total AS (SELECT sum(tokens) AS t FROM cells),
{shares},
c0 AS MATERIALIZED (SELECT cells.source, cells.lang, cells.topic, tokens, {BUDGET}::double AS p, {wants} FROM cells {joins}),
{", ".join(steps)},
f AS MATERIALIZED (SELECT source, lang, topic, p, greatest({off}) AS residual FROM {at})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_words, round(p, 6) AS probability, round(residual, 6) AS residual,
       ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, md5(d.text))), 1, 8))::bigint / 4294967296.0::double < p AS sampled
FROM d JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic
"""


ORACLE_SQL = _oracle()
