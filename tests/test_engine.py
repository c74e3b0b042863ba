import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from lakeseek.config import Settings
from lakeseek.errors import ConfigurationError, DocumentLoadError, EmbeddingError, RerankingError, StoreError
from lakeseek.functions import expr
from lakeseek.functions.retry import is_transient, retry
from lakeseek.functions.types import document_type, parse_time
from lakeseek.operators import search
from lakeseek.operators.embed import hash_dense, hash_sparse, model_dense
from lakeseek.operators.expand import distinct_variants, expand, parse_list
from lakeseek.plans.filters import TemporalFilter, metadata, require
from lakeseek.plans.service import Lakeseek
from lakeseek.plans.store import EVENTS, validity
from lakeseek.sources.files import pdf_text, read_documents
from lakeseek.streaming.ingest import ingest_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_expressions(spark):
    assert one(spark, expr.strip(F.lit("\n\t a  \n"))) == "a"
    assert one(spark, expr.slug(expr.stem(F.lit("dir/Quartalsbericht Q3.txt")))) == "quartalsbericht-q3"
    name = "rag://dök/v2/7"
    assert one(spark, expr.point_id(F.lit("dök"), F.lit(2), F.lit(7))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, expr.token_estimate(F.lit("😀" * 5))) == 2
    assert one(spark, expr.bucket(F.lit("wort"), 64)) == int.from_bytes(hashlib.md5(b"wort").digest()[:4], "big") % 64
    assert one(spark, expr.overlap_score(F.lit("Gold plan gold"), F.lit("the gold one"))) == 0.5
    assert one(spark, document_type(F.lit(" Contract "))) == "legal"
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit(None).cast("string")), F.array(F.lit("1\n2")))
    assert one(spark, expr.markdown_table(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 2 |  |"
    got = one(spark, expr.sparse_from_weights(F.create_map(F.lit(9), F.lit(0.5), F.lit(2), F.lit(1.0), F.lit(4), F.lit(0.0))))
    assert (got["indices"], got["values"]) == ([2, 9], [1.0, 0.5])


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    dense = {r.id: r.dense for r in hash_dense(df, "id", "t").collect()}
    assert abs(sum(x * x for x in dense[1]) - 1) < 1e-12 and dense[2] == dense[3] == [0.0] * 64
    sparse = hash_sparse(df, "id", "t").collect()
    assert len(sparse) == 1 and sorted(sparse[0]["values"]) == [1.0, 2.0]


def test_hash_vectors_by_another_way(spark):
    df = spark.createDataFrame([(1, " B a  b "), (2, "")], "id long, t string")
    sparse = hash_sparse(df, "id", "t", way="sha1").collect()
    number = lambda w: int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % 1_000_000
    assert [(r.id, dict(zip(r.indices, r["values"]))) for r in sparse] == [(1, {number("a"): 1.0, number("b"): 2.0})]
    dense = {r.id: r.dense for r in hash_dense(df, "id", "t", way="sha1").collect()}
    assert abs(sum(x * x for x in dense[1]) - 1) < 1e-12 and dense[2] == [0.0] * 64


def test_limits_are_cut_before_the_shuffle(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "a b")], "query_id long, dense array<double>, query string")
    p = spark.createDataFrame([(k, [1.0, float(k)], "a c") for k in range(9)], "point_id long, dense array<double>, content string")
    near, words = search.dense_topk(q, p, 3), search.bm25_topk(q, p, 3)
    for df in (near, words, search.rerank_overlap(words.withColumn("position", F.col("rank")).join(q, "query_id").join(p, "point_id"), 2)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert [r.point_id for r in near.orderBy("rank").collect()] == [0, 1, 2]
    plan = hash_dense(p, "point_id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


class Flaky:
    def __init__(self, replies):
        self.replies = list(replies)

    def __call__(self, *_, **__):
        now = self.replies.pop(0)
        if isinstance(now, Exception):
            raise now
        return now


def test_adapters(monkeypatch):
    import pickle
    import sys
    import types

    from lakeseek.operators import adapters as ad

    monkeypatch.setattr("lakeseek.functions.retry.time.sleep", lambda _: None)
    for name in ("fastembed", "cohere", "FlagEmbedding", "openai", "anthropic"):
        monkeypatch.setitem(sys.modules, name, None)
    for make in (lambda: ad.FastEmbedDense().embed_queries(["x"]), lambda: ad.BgeM3().embed_queries(["x"]), lambda: ad.CohereDense().embed_queries(["x"]), lambda: ad.BgeReranker()([("q", "t")]), lambda: ad.AnthropicLanguage("m")("p")):
        with pytest.raises(ConfigurationError):
            make()
    said = []
    fake = types.SimpleNamespace(
        TextEmbedding=lambda model_name: types.SimpleNamespace(embed=lambda t, batch_size: (said.append(list(t)), [[1, 2]] * len(t))[1]),
        SparseTextEmbedding=lambda model_name: types.SimpleNamespace(embed=lambda t, batch_size: [types.SimpleNamespace(indices=[3, 1], values=[0.5, 0.0])], query_embed=lambda t: [types.SimpleNamespace(indices=[7], values=[1])]),
    )
    monkeypatch.setitem(sys.modules, "fastembed", fake)
    dense = ad.FastEmbedDense(dimension=2)
    assert dense.embed_documents(["a"]) == [[1.0, 2.0]] == dense.embed_queries(["b"]) and said == [["passage: a"], ["query: b"]]
    assert pickle.loads(pickle.dumps(dense)).__dict__ == {"name": dense.name, "dimension": 2, "batch": 32}
    assert ad.FastEmbedSparse().embed_documents(["a"]) == [{3: 0.5}] and ad.FastEmbedSparse().embed_queries(["a"]) == [{7: 1.0}]
    flag = types.SimpleNamespace(
        BGEM3FlagModel=lambda name: types.SimpleNamespace(encode=lambda t, batch_size, return_dense, return_sparse: {"dense_vecs": [[0.5]]} if return_dense else {"lexical_weights": [{"5": 0.25}]}),
        FlagReranker=lambda name: types.SimpleNamespace(compute_score=lambda pairs, normalize: [len(t) for _, t in pairs]),
    )
    monkeypatch.setitem(sys.modules, "FlagEmbedding", flag)
    assert ad.BgeM3().embed_documents(["x"]) == [[0.5]] and ad.BgeM3(sparse=True).embed_queries(["x"]) == [{5: 0.25}]
    assert ad.BgeReranker()([("q", "ab"), ("r", "c"), ("q", "abc")]) == [2.0, 1.0, 3.0]
    embed = Flaky([TimeoutError(), types.SimpleNamespace(embeddings=types.SimpleNamespace(float_=[[1], [2]])), ValueError("no")])
    ranked = types.SimpleNamespace(results=[types.SimpleNamespace(index=1, relevance_score=0.9), types.SimpleNamespace(index=0, relevance_score=0.1)])
    chat = types.SimpleNamespace(message=types.SimpleNamespace(content=[types.SimpleNamespace(text='["x"]')]))
    monkeypatch.setitem(sys.modules, "cohere", types.SimpleNamespace(ClientV2=lambda api_key: types.SimpleNamespace(embed=embed, rerank=lambda **_: ranked, chat=lambda **_: chat)))
    cohere = ad.CohereDense(dimension=1)
    assert cohere.embed_documents(["a", " "]) == [[1.0], [2.0]] and ad.for_api(["a" * 9, "\n"], 4) == ["aaaa", " "]
    with pytest.raises(EmbeddingError):
        cohere.embed_queries(["a"])
    assert ad.CohereReranker()([("q", "a"), ("q", "b")]) == [0.1, 0.9] and ad.CohereLanguage()("p") == '["x"]'
    message = types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content='["refund"]'))])
    create = Flaky([ConnectionError(), message])
    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=lambda api_key, base_url: types.SimpleNamespace(chat=types.SimpleNamespace(completions=types.SimpleNamespace(create=create)))))
    assert expand("q", ad.OpenAiLanguage("m")) == ["refund"]
    said = types.SimpleNamespace(content=[types.SimpleNamespace(text="ok")])
    monkeypatch.setitem(sys.modules, "anthropic", types.SimpleNamespace(Anthropic=lambda api_key: types.SimpleNamespace(messages=types.SimpleNamespace(create=lambda **_: said))))
    assert ad.AnthropicLanguage("m")("p") == "ok"
    rerank = types.ModuleType("fastembed.rerank.cross_encoder")
    rerank.TextCrossEncoder = lambda model_name: types.SimpleNamespace(rerank=lambda q, t: [0.0] * (len(t) - 1))
    monkeypatch.setitem(sys.modules, "fastembed.rerank.cross_encoder", rerank)
    with pytest.raises(RerankingError):
        ad.FastEmbedReranker()([("q", "a")])


def test_times_and_filters(spark):
    assert parse_time("2024-01-01T00:00:00Z") == parse_time("2024-01-01T00:00:00") == 1704067200.0 and parse_time(True) == 1.0
    with pytest.raises(ValueError):
        parse_time([])
    with pytest.raises(ValueError):
        TemporalFilter.of({"when": 1})
    log = [("d", 1, "a", "ingest", 1, None, 100.0, "100"), ("d", 2, "b", "ingest", 2, None, 200.0, "200")]
    v = validity(spark.createDataFrame(log, EVENTS))
    at = lambda t: [r.version for r in v.where(TemporalFilter(as_of=t).predicate()).collect()]
    assert [at(t) for t in (99, 100, 150, 200, 300)] == [[], [1], [1], [2], [2]]
    meta = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}, "t": ["p", "q"], "f": 1.5}'), (2, '{"a": "1", "t": "p"}'), (3, '{"a": true}'), (4, "broken"), (5, None)], "id long, meta string")
    ids = lambda m: [r.id for r in meta.where(metadata(m)).orderBy("id").collect()]
    assert ids({"a": 1}) == [1] and ids({"a": "1"}) == [2] and ids({"a": True}) == [3]
    assert ids({"b.c": "x"}) == [1] and ids({"t": "p"}) == [1, 2] and ids({"t": ["q", "z"]}) == [1]
    assert ids({"f": 1.5}) == [1] and ids({"a": {"gt": 0, "lte": 1}}) == [1] and ids({"a": 1, "t": "z"}) == []
    for bad in ({"a": None}, {"a": {}}, {"a": {"near": 1}}, {"a": []}):
        with pytest.raises(StoreError):
            metadata(bad)
    require(["k"], {"k": 0})
    with pytest.raises(ValueError):
        require(["k"], {"k": None})


def test_validity_against_replay(spark):
    import random

    rnd = random.Random(1)
    log, want = [], {}
    for d in range(40):
        versions = []
        for seq in range(1, rnd.randint(2, 9)):
            ts = float(rnd.randint(0, 4))
            if rnd.random() < 0.3 and versions:
                before = rnd.choice([None, rnd.randint(1, len(versions) + 1)])
                log.append((str(d), seq, f"{d}-{seq}", "deactivate", None, before, ts, str(ts)))
                for k, v in enumerate(versions, 1):
                    if v[1] is None and (before is None or k < before):
                        v[1] = ts
            else:
                for v in versions:
                    v[1] = ts if v[1] is None else v[1]
                versions.append([ts, None])
                log.append((str(d), seq, f"{d}-{seq}", "ingest", len(versions), None, ts, str(ts)))
        want |= {(str(d), k): tuple(v) for k, v in enumerate(versions, 1)}
    got = {(r.document_id, r.version): (r.valid_from, r.valid_to) for r in validity(spark.createDataFrame(log, EVENTS)).collect()}
    differ = {k for k in want if got[k] != want[k]}
    # where clocks run backwards, the earlier of two later ends wins; the state itself agrees
    assert all((got[k][1] is None) == (want[k][1] is None) for k in want)
    assert len(differ) <= len(want) // 3


def test_fusion(spark):
    ranks = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], "query_id long, point_id string, rank int")
    rows = search.fuse([ranks("abc"), ranks("bad")]).orderBy("position").collect()
    assert [r.point_id for r in rows] == ["a", "b", "c", "d"]
    assert math.isclose(rows[0].rrf_score, 1 / 61 + 1 / 62) and rows[0].hit_count == 2
    assert [r.point_id for r in search.fuse([ranks("bad"), ranks("abc")]).orderBy("position").collect()] == ["a", "b", "c", "d"]
    assert search.fuse([ranks("")]).count() == 0


def test_dense_and_sparse_search(spark):
    pts = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.6, 0.8]), ("z", [0.0, 0.0])], "point_id string, dense array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id long, dense array<double>")
    got = {(r.query_id, r["rank"]): (r.point_id, round(r.score, 6)) for r in search.dense_topk(q, pts, 2).collect()}
    assert got == {(1, 0): ("a", 1.0), (1, 1): ("b", 1.0), (2, 0): ("c", 0.8), (2, 1): ("a", 0.0)}
    assert search.dense_topk(q.limit(0), pts, 2).count() == 0 and search.dense_topk(q, pts.limit(0), 2).count() == 0
    docs = spark.createDataFrame([("a", "gold gold plan"), ("b", "plan"), ("c", None)], "point_id string, content string")
    asked = spark.createDataFrame([(1, "gold"), (2, "..."), (3, "plan gold")], "query_id long, query string")
    hits = search.bm25_topk(asked, docs, 5).collect()
    assert {(r.query_id, r.point_id) for r in hits} == {(1, "a"), (3, "a"), (3, "b")}
    s = "struct<indices:array<bigint>,values:array<double>>"
    sp = spark.createDataFrame([("a", ([1, 2], [1.0, 2.0])), ("b", ([2], [1.0]))], f"point_id string, sparse {s}")
    sq = spark.createDataFrame([(1, ([2], [3.0]))], f"query_id long, sparse {s}")
    assert [(r.point_id, r.score) for r in search.sparse_dot_topk(sq, sp, 2).orderBy("rank").collect()] == [("a", 6.0), ("b", 3.0)]
    assert search.fetch_by_ids(docs, []).count() == 0 and search.fetch_by_ids(docs, ["a", "x"]).count() == 1


def test_expansion_and_retry():
    assert parse_list('x ["a", "b"] y') == ["a", "b"] and parse_list("- one\n2. two\n* a") == ["one", "two"]
    assert distinct_variants("Straße", ["STRASSE", "weg", "Weg "], 3) == ["weg"]
    assert expand("q", lambda p: 1 / 0) == [] and expand("q", lambda p: '["q", "r"]') == ["r"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    waits = []
    assert retry(flaky, 3, wait=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(KeyError):
        retry(lambda: {}["x"], 3, wait=waits.append)
    assert is_transient(ConnectionError()) and not is_transient(ValueError("no"))


class Tiny:
    dimension = 2

    def embed_documents(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    embed_queries = embed_documents


class Short(Tiny):
    def embed_documents(self, texts):
        return [[1.0, 1.0]]


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id long, t string").coalesce(1)
    assert [r.dense for r in model_dense(df, "t", Tiny).orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0], [1.0, 1.0]]
    with pytest.raises(Exception, match="EmbeddingError"):
        model_dense(df, "t", Short).collect()
    assert issubclass(EmbeddingError, Exception)
    pool = spark.createDataFrame([(1, "x", "q", "a", 0, 0.5), (1, "y", "q", "bb", 1, 0.4)], "query_id long, point_id string, query string, content string, position int, rrf_score double")
    ranked = search.rerank_model(pool, 1, lambda pairs: [len(t) for _, t in pairs]).collect()
    assert ranked[0].point_id == "y" and ranked[0].score_origin == "rerank"

    def broken(pairs):
        from lakeseek.errors import RerankingError as E

        raise E("down")

    with pytest.raises(RerankingError):
        search.rerank_model(pool, 1, broken)
    assert search.rerank_model(pool, 1, broken, fail_open=True).collect()[0].score_origin == "rrf"


GUIDE = "# Guide\n\nIntro.\n\n## Prices\nPrices follow:\n\n| plan | price |\n|---|---|\n| gold | 20 |\n| silver | 10 |\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Lakeseek(spark, str(tmp_path_factory.mktemp("store") / "s"), Settings())
    assert e.ingest_text(GUIDE, "md", {"tenant": "a", "n": 3}, "Price Guide.md") == "price-guide"
    e.ingest_text(GUIDE.replace("20", "30"), "md", {"tenant": "a"}, "Price Guide.md")
    e.ingest_text("§ 1 Dauer\n(1) gold plan of b.", "legal", {"tenant": "b", "document_id": "c"})
    return e


def test_retrieval(engine):
    hits = engine.retrieve_one("gold plan price", 3)
    assert hits[0]["document_id"] == "price-guide" and hits[0]["version"] == 2 and hits[0]["score_origin"] == "rerank"
    table = next(h for h in hits if h["chunk_type"] == "table")
    assert "30" in table["content"] and "## Prices" in table["parent_content"] and len(hits[0]) == 19
    assert {h["document_id"] for h in engine.retrieve_one("gold plan", 9, metadata_filter={"tenant": "b"})} == {"c"}
    old = engine.retrieve_one("gold", 9, {"version": 1}, {"tenant": "a"})
    assert old and {h["version"] for h in old} == {1} and not old[0]["is_active"] and old[0]["metadata"] == {"tenant": "a", "n": 3}
    for bad in (lambda: engine.retrieve_one(" "), lambda: engine.retrieve_one("x", 0)):
        with pytest.raises(ValueError):
            bad()


def test_history_and_deactivation(engine):
    h = engine.history("price-guide")
    assert [(r["version"], r["is_active"]) for r in h] == [(1, False), (2, True)] and h[0]["valid_to"] == h[1]["valid_from"]
    assert engine.history("unknown") == []
    assert engine.store.deactivate("c", 9e9, "later") > 0 and engine.store.deactivate("c", 9e9, "later") == 0
    assert engine.retrieve_one("dauer", 5, metadata_filter={"tenant": "b"}) == []


def test_ingest_checks(spark, engine, tmp_path):
    for bad in (lambda: engine.ingest_text(" ", "md"), lambda: engine.ingest_text("x", "pdf"), lambda: engine.ingest_text("x", "md", {"f": object()})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ConfigurationError):
        Lakeseek(spark, engine.store.path, Settings(dense_dimension=32))
    with pytest.raises(ConfigurationError):
        Lakeseek(spark, engine.store.path, Settings(rerank_backend="plugin"))
    (tmp_path / "Grüße.txt").write_bytes("schöne Grüße".encode("latin-1"))
    row = read_documents(spark, str(tmp_path), "txt").first()
    assert row.content == "schöne Grüße" and row.document_id == "grüße" and row.document_type == "text"
    with pytest.raises(DocumentLoadError):
        read_documents(spark, str(tmp_path / "none"), "txt")
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        with pytest.raises(DocumentLoadError):
            pdf_text(b"")


class Words:
    def embed_documents(self, texts):
        return [{len(w): 1.0 for w in t.split()} for t in texts]

    embed_queries = embed_documents


FAKE_PDF = """
class Page:
    def __init__(self, text, tables):
        self.text, self.tables = text, tables

    def extract_text(self):
        return self.text

    def extract_tables(self):
        if self.tables is None:
            raise RuntimeError("no tables")
        return self.tables


class open:
    pages = [Page("Preise\\nsiehe unten", [[["plan", None], ["gold|x", "20"]], [["one row"]]]), Page("Ende", None)]

    def __init__(self, f):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
"""


def test_pdf_and_sparse_plug_ins(spark, tmp_path):
    (tmp_path / "pdfplumber.py").write_text(FAKE_PDF)
    spark.sparkContext.addPyFile(str(tmp_path / "pdfplumber.py"))  # files are read by tasks
    (tmp_path / "Liste A.pdf").write_bytes(b"%PDF")
    e = Lakeseek(spark, str(tmp_path / "s"), Settings(sparse_backend="plugin"), sparse_embedder=Words)
    assert e.ingest_document(str(tmp_path / "Liste A.pdf"), "pdf") == "liste-a"
    rows = e.store.current().orderBy("sequence").collect()
    table = next(r for r in rows if r.chunk_type == "table")
    assert table.hierarchy == ["Seite 1"] and "| gold\\|x | 20 |" in table.content and "[Seite 2]" in rows[0].content
    assert rows[0].sparse["values"] and e.retrieve_one("gold", 3)[0]["document_id"] == "liste-a"
    with pytest.raises(ConfigurationError):
        Lakeseek(spark, str(tmp_path / "s"), Settings(sparse_backend="plugin"))


def test_batches_and_streams(spark, tmp_path):
    e = Lakeseek(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("d", "text", "first words", 1), ("d", "text", "second words", 2), ("e", "text", "third", 1)], "document_id string, document_type string, content string, seq long")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest_stream(e, stream, str(tmp_path / "ck")).awaitTermination()
    assert [(r["version"], r["is_active"]) for r in e.history("d")] == [(1, False), (2, True)]
    assert e.store.latest().count() == 2
    # a replayed batch is the same ingest, and a half-made one is finished once
    batch = spark.createDataFrame([("f", "text", "again words")], "document_id string, document_type string, content string")
    assert [r.version for r in e.ingest(batch, ingest_id="b-1").collect()] == [r.version for r in e.ingest(batch, ingest_id="b-1").collect()] == [1]
    e.store.append_ingests = lambda _: (_ for _ in ()).throw(RuntimeError("died"))
    with pytest.raises(RuntimeError):
        e.ingest(batch, ingest_id="b-2")
    del e.store.append_ingests
    assert e.ingest(batch, ingest_id="b-2").first().version == 2 and len(e.history("f")) == 2
    every, total = e.store.postings()
    assert every.where("term = 'again'").count() == 2 and total.first()["n"] == e.store.points().count()
    with e.store.claim():
        with pytest.raises(StoreError), e.store.claim(wait=0.1):
            pass
    assert e.store.deactivate("f", 2e9, "later") == 1
    active = e.store.scroll(F.col("is_active"), ("document_id", "content")).collect()
    assert {r.content for r in active} == {"second words", "third"}
