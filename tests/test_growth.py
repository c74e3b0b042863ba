"""Steps whose cost must not grow faster than the input."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeseek.operators import search
from lakeseek.operators.batches import BATCH_BYTES
from lakeseek.operators.chunk import chunk_documents, windows
from lakeseek.operators.embed import hash_dense, hash_sparse
from lakeseek.operators.search import Best, Nearest
from lakeseek.plans.store import EVENTS, validity


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    return [None if k % 29 == 0 else "" if k % 31 == 0 else " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 30))) for k in range(n)]


def test_bm25_makes_no_row_for_a_hit(spark, monkeypatch):
    docs, asked = texts(400), [(k, t) for k, t in enumerate(texts(40, 2)) if t is not None]
    words = [Counter(re.findall(r"\w+", t or "")) for t in docs]
    df = Counter(w for c in words for w in c)
    mean = sum(map(Counter.total, words)) / len(docs)
    want = []
    for i, t in asked:
        scores = []
        for d, c in enumerate(words):
            if common := set(re.findall(r"\w+", t)) & set(c):
                s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in common)
                scores.append((-round(s, 6), d))
        want += [(i, d, -s, n) for n, (s, d) in enumerate(sorted(scores)[:7])]
    monkeypatch.setattr(Nearest, "CELLS", 64 * len(asked))
    monkeypatch.setattr(Best, "FREQUENT", 5)
    q = spark.createDataFrame(asked, "query_id long, query string")
    p = spark.createDataFrame(list(enumerate(docs)), "point_id long, content string").repartition(3)
    got = search.bm25_topk(q, p, 7)
    assert sorted((r.query_id, r.point_id, round(r.score, 6), r["rank"]) for r in got.collect()) == sorted(want)
    assert "Join" not in plan(got)  # hits were joined to rows before


def test_sparse_search_makes_no_row_for_a_hit(spark):
    rng = random.Random(3)
    vector = lambda: {i: float(rng.randint(1, 3)) for i in rng.sample(range(40), rng.randint(0, 9))}
    docs, asked = [vector() for _ in range(300)], [vector() for _ in range(20)]
    want = []
    for i, q in enumerate(asked):
        hits = sorted((-sum(w * d[t] for t, w in q.items() if t in d), n) for n, d in enumerate(docs) if set(q) & set(d))
        want += [(i, n, -s, r) for r, (s, n) in enumerate(hits[:6])]
    column = lambda v: (sorted(v), [v[t] for t in sorted(v)])
    kind = "struct<indices:array<bigint>,values:array<double>>"
    q = spark.createDataFrame([(i, column(v)) for i, v in enumerate(asked)], f"query_id long, sparse {kind}")
    p = spark.createDataFrame([(i, column(v)) for i, v in enumerate(docs)], f"point_id long, sparse {kind}").repartition(3)
    got = search.sparse_dot_topk(q, p, 6)
    assert sorted((r.query_id, r.point_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)
    assert "Join" not in plan(got)  # hits were joined to rows before


def test_reranked_places_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    name = "rerank_fail_open"
    docs = [(k, (t or "w1") + " w2" * (k % 7)) for k, t in enumerate(texts(60))]
    turns = [(c, t, "user", f"w{1 + t} w2 w3") for c in (0, 100) for t in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' as lang", "'src1' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    r = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(r.fetchall())


@pytest.mark.parametrize("name", ["large_class_methods", "code_chunks", "window_pieces", "word_chunks", "legal_chunks", "sql_dump_chunks", "json_fragments"])
def test_rows_of_one_file_are_chunked_in_several_tasks(spark, tmp_path, name):
    n = F.col("id")
    for table, columns in {
        "part": (n.alias("p_partkey"), (n % 9).alias("p_size")),
        "customer": (n.alias("c_custkey"),),
        "orders": (n.alias("o_orderkey"), F.lit("O").alias("o_orderstatus")),
        "lineitem": ((n / 4).cast("long").alias("l_orderkey"), (n % 4).alias("l_linenumber"), F.lit("R").alias("l_returnflag")),
        "events": (n.alias("event_id"), (n % 700).alias("user_id"), F.lit("click").alias("event_type"), n.cast("double").alias("value")),
    }.items():
        spark.range(3000).coalesce(1).select(*columns).write.parquet(f"{tmp_path}/{table}.parquet")
    # the tasks of the stage that chunks: partitions of what its Python step reads
    node = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    child = node.children().head().toString()
    assert re.search(r"RepartitionByExpression \[[^\]]*\], 6", child)  # none before: one task for a file


def test_versions_end_without_meeting_all_deactivations(spark):
    rng = random.Random(5)
    log, want = [], []
    for d in range(60):
        mine, version = [], 0
        for seq in range(1, rng.randint(2, 25)):
            if rng.random() < 0.5:
                version += 1
                mine.append((f"d{d}", seq, f"i{seq}", "ingest", version, None, rng.random(), f"t{seq}"))
            else:
                mine.append((f"d{d}", seq, f"i{seq}", "deactivate", None, rng.choice([None, *range(1, 9)]), rng.random(), f"t{seq}"))
        for r in (r for r in mine if r[3] == "ingest"):
            later = [x for x in mine if x[1] > r[1] and (x[4] == r[4] + 1 or x[3] == "deactivate" and (x[5] is None or r[4] < x[5]))]
            end = min(later, key=lambda x: x[1], default=None)
            want.append((r[0], r[4], r[2], r[6], r[7], end and end[6], end and end[7], end is None))
        log += mine
    got = validity(spark.createDataFrame(log, EVENTS).repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in plan(got)  # each version met all later deactivations before


@pytest.mark.parametrize("step", [lambda d: hash_sparse(d, "key", "content"), lambda d: hash_sparse(d, "key", "content", way="sha1"), lambda d: hash_dense(d, "key", "content"), lambda d: windows(d, "content", 480), chunk_documents])
def test_workers_get_small_batches(spark, step):
    session, name = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    assert session.conf.get(name) != str(BATCH_BYTES)
    step(session.createDataFrame([(1, "a b")], "key long, content string").select("key", "content"))
    assert session.conf.get(name) == str(BATCH_BYTES)
