"""Operators 7, 8 and 9, the pipeline, and what they share."""

import io
import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakeseek.llm import _text as tx
from lakeseek.llm import html_extract as hx
from lakeseek.llm import quality_classifier as qc
from lakeseek.llm import token_binary as tb
from lakeseek.llm._shared import drop, tidied, written
from lakeseek.llm.components import components
from lakeseek.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# 7


def test_tokens_come_back(docs, rows, empty, tok):
    got = sorted(tuple(r) for r in tb.token_binary(docs, tokenizer_path()).collect())
    start, want = 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0], x[1] is not None, (x[1] or "").encode())):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert tb.token_binary(empty, tokenizer_path()).count() == 0


def test_words_encode_like_texts(tok):
    rnd = random.Random(1)
    letters = ["a", "B", "É", "é", "́", " ", "\n", "\t", "\x1c", "\x85", "　", "Σ", "<|endoftext|>", "'s", "9", "#", "ß", "İ", "漢", "​", "😀", "\x0b", "\x00", "½", "_"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    ids, n = tb.TokenIds(tokenizer_path())(*tx.texts(pa.array(texts)), 2)
    ends = np.cumsum(n)
    for k, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] - n[k] : ends[k]].tolist() == [*e.ids, 2]


def test_coder_round_trip_checkpoints_and_checksums():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 700_000) % 50_000).astype(np.uint16)
    coder = tb.Coder(tb.quantise(np.bincount(ids)))
    sink = io.BytesIO()
    w = tb.Writer(sink, coder)
    for k in range(0, len(ids), 70_001):
        w.add(ids[k : k + 70_001])
    w.close(pa.array([1]), np.array([len(ids)]))
    assert (np.concatenate(list(tb.read_file(sink, coder))) == ids).all()
    part = tb.read_file(sink, coder, 0, 1)
    at = tb.CHECK_STEPS * tb.LANES
    assert (part == ids[at : at + len(part)]).all()
    broken = bytearray(sink.getvalue())
    broken[len(tb.MAGIC) + 5] ^= 255
    with pytest.raises(ValueError):
        list(tb.read_file(io.BytesIO(bytes(broken)), coder))
    one = tb.Coder(tb.quantise(np.bincount(np.full(100, 2))))
    body, points = one.encode(np.full(100, 2), 4)
    assert (one.decode(np.frombuffer(body, "<u4"), 100, points[0]["state"]) == 2).all()


# 8

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><p>Best news since 1999, every single day.</p></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Please accept them all to go on reading this page.</p></div><div class="ad">Buy this thing now.</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br><p>Second &eacute;, with <a href="/x">a link</a>.<div class="comments"><p>I do agree with this article, it is very good.</p></div></article>
<aside class="sidebar"><p>Related stories that you may like to read as well.</p></aside><form><label>Mail</label><input><button>Send</button></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert hx.main_text(PAGE) == "Title & more\nFirst line\nSecond é, with a link."
    assert hx.main_text(None) == hx.main_text("") == hx.main_text("<p></p>") == hx.main_text("<!-- never closed") == ""
    hx.main_text("<" * 3000 + "a href='")
    long = "<div id=content><p>Long text without an article element, which is content all the same. It has two sentences.</p></div><div id=sidebar>Foo bar</div>"
    assert hx.main_text(long).startswith("Long text") and "Foo" not in hx.main_text(long)


def test_names_around_articles_and_of_headings():
    body = "<article><h1>Title</h1><p>A first sentence that is long enough, of an article.</p><h2 id='related-work'>Related work</h2><p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> it ends.</p></article>"
    want = "Title\nA first sentence that is long enough, of an article.\nRelated work\nWith x=1 it ends."
    assert hx.main_text(body) == hx.main_text(f"<div class='has-sidebar'>{body}</div>") == want
    comments = "<div class='comments'><article><p>I do agree with this article, it is very good.</p></article></div>"
    assert hx.main_text(f"<div class='has-sidebar'>{body}</div>{comments}") == want


PROSE = "This is a sentence of the article that is long enough, and another one follows it here. "


def test_blocks_keep_their_text():
    assert hx.main_text("<article><p>foo\u200bbar " + PROSE + "</p></article>") == "foo\u200bbar " + PROSE.strip()
    line = "<p>The formula <math><mi>x</mi></math> holds. Press <button>OK</button> now, <svg><text>12</text></svg> <object>of</object> it.</p>"
    assert hx.main_text(f"<article><p>{PROSE}</p>{line}</article>") == PROSE.strip() + "\nThe formula x holds. Press OK now, 12 of it."
    page = f"<article><h1>T</h1><p>{PROSE}</p><section class='related work'><h2>Related work</h2><p>{PROSE}2</p></section><div class='legal-side'><p>{PROSE}3</p></div><div class=related><h3>Related</h3><ul><li><a href=x>Another article</a></ul></div></article>"
    assert hx.main_text(page).split("\n") == ["T", PROSE.strip(), "Related work", PROSE + "2", PROSE + "3"]


def test_deep_pages_take_linear_time():
    import time

    for unit in ("<div>x ", "<p><b>x ", "<ul><li><a>x "):
        began = time.perf_counter()
        hx.main_text(unit * 8000 + "<p>end</p></span>" * 500)
        assert time.perf_counter() - began < 4, unit


def test_generated_pages():
    rnd = random.Random(11)
    say = lambda n: " ".join(rnd.choice(("alpha", "beta", "gamma", "delta", "of", "the", "and")) + rnd.choice(("", "", ",")) for _ in range(n)).strip(",") + "."
    hit = kept = true = 0
    for k in range(60):
        links = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{rnd.choice('ABC')} link {k} {i}</a></li>" for i in range(n)) + "</ul>"
        body = [("h1", f"Title {k}")] + [(rnd.choice(("p", "p", "p", "h2", "li", "blockquote")), f"{i} {say(rnd.randint(2, 60))}") for i in range(rnd.randint(3, 12))]
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in body)
        wrap = rnd.choice(("<article>{}</article>", "<main>{}</main>", "<div class='page'><article class='post'>{}</article></div>"))
        around = [f"<nav>{links(5)}</nav>", f"<header><a href='/'>{say(3)}</a></header>", f"<div class='cookie-banner'>{say(12)}</div>", wrap.format(inner), f"<aside>{say(20)}{links(3)}</aside>", f"<div class='comments'><p>{say(15)}</p></div>", f"<form><p>{say(5)}</p></form>", f"<footer>{say(8)}</footer>"]
        want, got = [x for _, x in body], hx.main_text("<html><body>" + "\n".join(around) + "</body></html>").split("\n")
        hit += len(set(want) & set(got))
        kept, true = kept + len(got), true + len(want)
    assert hit >= 0.97 * true and hit >= 0.97 * kept


def test_min_cut_is_least():
    rnd = random.Random(0)
    for _ in range(150):
        n = rnd.randint(1, 6)
        s, t = ([rnd.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rnd.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        cost = lambda on: sum(t[i] if on[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if on[a] != on[b])
        assert cost(hx.min_cut(s, t, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in hx.extract_main_text(df).select("page_id", "n_chars").collect())
    assert got == [(1, len(hx.main_text(PAGE))), (2, 0), (2, 0)]
    assert hx.extract_main_text(df.limit(0)).count() == 0


# 9


def test_classifier_learns_and_keeps_its_fold(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    good = lambda: ". ".join(" ".join(rnd.choice(words) for _ in range(9)).capitalize() for _ in range(8)) + "."
    bad = lambda: " ".join(rnd.choice(words) + rnd.choice(["***", " |", "!!"]) for _ in range(70))
    rows = [(k, good() if k % 3 else bad(), 1 if k % 3 else 0) for k in range(400)] + [(900, None, None), (901, "", 1), (902, good(), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[0] != 902], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.quality_classifier(docs, labels).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows[:400] if got[r[0]].held_out]
    assert sum(got[r[0]].predicted == r[2] for r in held) / len(held) > 0.97
    one = qc.quality_classifier(docs, labels.where("quality = 1")).agg({"score": "min"}).first()[0]
    assert one > 0.99
    assert qc.quality_classifier(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0.5
    assert qc.quality_classifier(docs.limit(0), labels).count() == 0


def test_training_sample_is_of_whole_rows(spark, monkeypatch):
    rows = [(k % 40, ("Good words here. " if k % 2 else "bad | bad | ") * (20 + 300 * (k == 7))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(qc, "fit", lambda x, off, y, **_: seen.append((np.diff(off), y)) or {})
    qc.train(docs, labels)
    qc.train(docs, labels, max_documents=5)
    qc.train(docs, labels, max_passages=9)
    size, y = seen[0]
    train = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    texts = {(k, t) for k, t in rows if k in train}
    assert len(y) == len(texts) and sorted(size) == sorted(-(-len(t.split()) // qc.PASSAGE) for _, t in texts)
    assert 1 <= len(seen[1][1]) <= 5 and 1 <= len(seen[2][1]) and (seen[2][0].sum() <= 9 or len(seen[2][1]) == 1)


def test_fit_separates_bags():
    rng = np.random.default_rng(0)
    x, off, y = rng.normal(size=(12, 5)), np.array([0, 3, 7, 12]), np.array([1.0, 0.0, 1.0])
    m = qc.fit(x, off, y, hidden=4, gate=3, epochs=200, batch=3)
    p, _ = qc.forward(m, x, off)
    assert ((p > 0.5) == (y > 0.5)).all()


# shared


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scan_matches_regex():
    import re

    rnd = random.Random(3)
    texts = [None, "", " ", *("".join(rnd.choice(" \n\tabÄ€z😀#") for _ in range(rnd.randint(0, 40))) for _ in range(300))]
    buf, off = tx.texts(pa.array(texts, pa.string()))
    w = tx.scan(buf, off)
    raw = buf.tobytes()
    seen = {}
    for d, t in enumerate(texts):
        got = [raw[w.start[k] : w.end[k]].decode() for k in range(w.off[d], w.off[d + 1])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k, x in zip(range(w.off[d], w.off[d + 1]), got):
            assert seen.setdefault(x, w.hash[k]) == w.hash[k]
    assert len(set(seen.values())) == len(seen)


def test_pipeline(spark, docs, rows, tmp_path, tok):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    table = docs.select(*cp.COLUMNS)
    table.write.parquet(f"{sf}/documents.parquet")
    passage = rows[8][1].split()[2:16]
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        kept[name] = now.collect()
        if k < 4:
            assert now.columns == list(cp.COLUMNS)
    ids = lambda n: {r.doc_id for r in kept[n]}
    assert {r[0] for r in rows[:24]} <= ids("quality_rules")
    near = {r[0] for r in rows[24:30]}
    assert not ids("near_duplicates") & near and 0 in ids("near_duplicates")
    text = {r.doc_id: r.text for r in kept["decontaminate"]}
    assert " ".join(passage) not in text[8] and len(text) == len(ids("near_duplicates"))
    assert len(kept["token_binary"]) == len(kept["mix_sources"])
    by = {}
    for r in kept["mix_sources"]:
        by.setdefault(r.doc_id, []).append(len(tok.encode(r.text, add_special_tokens=False).ids) + 1)
    assert sorted(x.n_tokens for x in kept["token_binary"]) == sorted(n for v in by.values() for n in v)
    assert sorted(tuple(r) for r in cp.run(spark, sf).collect()) == sorted(tuple(r) for r in kept["token_binary"])


def test_pipeline_against_brute_force(spark, rows, tmp_path, tok):
    """The stages that make no choice by seed, recomputed from their definitions."""
    import re

    import corpus_pipeline as cp
    from tests.llm.test_ngram_jaccard import shingles
    from tests.llm.test_text_ops import quality_brute

    table = [r[:5] for r in rows] + [(None, rows[0][1], "de", "b", 1), (700, rows[0][1], "de", "hot", 1), (700, "Another text that is unlike all others but bears an id twice, with words enough.", "de", "b", 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    sf = str(tmp_path / "sf")
    good = cp.keep_quality(spark, docs, sf)
    passed = [tuple(r) for r in good.collect()]
    base = lambda t: (lambda c: c[0] < 10 or 100 * c[4] > 20 * c[0])(quality_brute(t))
    assert all(not base(t[1]) for t in passed) and {r[0] for r in table if not base(r[1])} >= {t[0] for t in passed}
    good.write.parquet(str(tmp_path / "good"))
    near = cp.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "good")), sf)
    sets = [shingles(t[1]) for t in passed]
    group = [k for k in range(len(passed))]
    for _ in passed:  # labels go round until nothing changes
        for i in range(len(passed)):
            for j in range(len(passed)):
                n = len(sets[i] & sets[j])
                if i != j and 100 * n >= 60 * (len(sets[i]) + len(sets[j]) - n):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for k, t in enumerate(passed):
        if t[0] is not None:
            least[group[k]] = min(t[0], least.get(group[k], t[0]))
    want = {(t[0], t[1]) for k, t in enumerate(passed) if t[0] is None or t[0] == least[group[k]]}
    kept = [(r.doc_id, r.text) for r in near.collect()]
    assert set(kept) == want and len(kept) == len(want) and {700} <= {k for k, _ in kept} and (None, rows[0][1]) in kept
    near.write.parquet(str(tmp_path / "near"))
    clean = cp.remove_benchmarks(spark, spark.read.parquet(str(tmp_path / "near")), sf)
    assert sorted((r.text for r in clean.collect())) == sorted(re.sub(r"\bx y\b", " ", t) for _, t in kept)


def test_pipeline_over_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert cp.run(spark, sf).count() == 0


def test_workers_give_memory_back():
    """After a task that took 300 MB in pieces which malloc keeps."""
    kept = []

    def hungry(batches):
        for batch in batches:
            blocks = [bytearray(60_000) for _ in range(5000)]
            kept.append(bytearray(60_000))  # at the heap's end, so that it can't shrink by itself
            del blocks
            yield batch

    def resident(run):
        list(run(iter([1])))
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4 // 1024

    plain = resident(hungry)
    assert resident(tidied(hungry)) < plain - 150


def test_shuffle_files_go_with_their_step(spark):
    """Without a further query, after which a listener would let go of the step before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    for _ in range(3):
        before = files()
        table = written(spark.range(20_000, numPartitions=3).selectExpr("id % 997 as k").groupBy("k").count())
        until = time.time() + 5
        while files() - before and time.time() < until:
            time.sleep(0.05)
        assert not files() - before
        drop(spark, table)
