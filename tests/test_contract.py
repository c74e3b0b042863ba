"""Every registered query against its SQL, on the small tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in sorted(columns)) for x in df.collect()) == want


def test_text_chunks_match_the_chunker(spark):
    import hashlib

    from lakeseek.operators.chunk import chunk_text
    from lakeseek.operators.split import split_text

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted((r.doc_id, r.sequence, r.content_md5) for r in entry.queries()["text_chunks"](spark, SF).collect())
    assert got == sorted((i, p.serial, hashlib.md5(p.content.encode()).hexdigest()) for i, t in docs.items() if t and t.strip() for p in chunk_text(t, "text"))
    parts = sorted((r.doc_id, r.ord, r.piece) for r in entry.queries()["split_text_windows"](spark, SF).collect())
    assert parts == sorted((i, k, p) for i, t in docs.items() for k, p in enumerate(split_text(t or "", 480, 64, 24)))
