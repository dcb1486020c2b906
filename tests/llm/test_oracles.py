"""Each query that SQL can express against its SQL over a small table set."""

from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from keystrata.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (datetime, date)):
        return str(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    cur = c.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = Counter(tuple(plain(r[cols.index(k)]) for k in order) for r in cur.fetchall())
    got = Counter(tuple(plain(r[k]) for k in order) for r in df.collect())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
