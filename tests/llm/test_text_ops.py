"""Operators 2 to 6 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from lakeseek.llm import decontaminate as dc
from lakeseek.llm import license_scan as ls
from lakeseek.llm import mixing as mx
from lakeseek.llm import quality_rules as qr
from lakeseek.llm import substring_chain as sc
from lakeseek.llm import suffix_dedup as sd
from lakeseek.llm.queries import source_weights

WORD = r"[^\x20\x09-\x0D]+"


# 2


def test_licenses_are_found_with_their_differences(docs, rows, empty):
    got = {(r.doc_id, r.license) for r in ls.license_scan(docs).collect()}
    want = {(r[0], k) for r in rows if r[1] for k, t in (("Apache-2.0", "Apache License"), ("MIT", "MIT License")) if t in r[1]}
    assert got == want
    assert ls.license_scan(empty).count() == 0
    s = ls.Scanner()
    found = s.scan("Licensed under the Apache Public License, Version 2.0, as is.")
    assert [f["license"] for f in found] == ["Apache-2.0"] and found[0]["added"] == ["public"]
    assert s.scan("The license of this car is old.") == []
    assert s.rank("Released under the MIT License.")[0][1] == "MIT"


def test_wrapped_licenses_are_found_whole():
    s = ls.Scanner()
    for name in ("MIT-grant", "BSD-clauses", "GPL-notice", "MPL-2.0", "BSD", "ISC", "Apache-2.0-header"):
        w = ls.TEMPLATES[name].split()
        for width in (3, 5, 9, 14):
            notice = "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))
            text = f"one line before\n{notice}\nand one after\n"
            found = [(a + f["start"], f) for a, b in ls.blocks(text) for f in s.scan(b)]
            assert [(a, f["license"], f["n_words"], f["missing"]) for a, f in found] == [(16, name, len(ls.words(" ".join(w))), [])]
    twice = "Released under the MIT License.\nmore\nReleased under the MIT License."
    assert [f["license"] for _, b in ls.blocks(twice) for f in s.scan(b)] == ["MIT", "MIT"]


def test_usual_wordings_of_licenses():
    s = ls.Scanner()
    names = lambda t: [f["license"] for _, b in ls.blocks(t) for f in s.scan(b)]
    for text, want in (
        ("Licensed under the MIT License", ["MIT"]),
        ("MIT License", ["MIT-title"]),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0-or-later-spdx"]),
        ("Under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        (ls.TEMPLATES["MIT-text"], ["MIT-text"]),
        (ls.TEMPLATES["ISC-text"], ["ISC-text"]),
        ("Licensed under the Foo License, Version 2.0.", []),
        ("Rights are not reserved here. No license.", []),
    ):
        assert names(text) == want, text
    far = "this is the work of a library under a roof " + "x " * 40
    assert names(far + "This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]


def test_licenses_against_all_pairs():
    """Every template in every place of a block is found, also where several stand in one, and only by its rank."""
    s = ls.Scanner()
    names = [n for n in ls.TEMPLATES if n not in ("MIT-grant", "BSD-clauses", "ISC", "Unlicense")]  # the rest stand within longer ones
    for k, name in enumerate(names):
        other = names[(k + 7) % len(names)]
        for text, want in ((f"some words\n{ls.TEMPLATES[name]}\nother words here", [name]), (f"{ls.TEMPLATES[name]}\nwords between\n{ls.TEMPLATES[other]}", [name, other])):
            got = [f["license"] for _, b in ls.blocks(text) for f in s.scan(b)]
            fits = {n for n in ls.TEMPLATES if s.differences(n, ls.words(ls.TEMPLATES[name])) or s.differences(n, ls.words(ls.TEMPLATES[other]))}
            assert len(got) == len(want) and all(g in fits for g in got), (name, other, got)
            assert sum(g == w for g, w in zip(got, want)) >= len(want) - 1, (name, other, got)
    blind = ls.Scanner()
    blind.saved = lambda block, name: 0.0 if name == "MIT" else -1.0  # a rank that never picks a template that saves
    assert blind.scan("Released under the MIT License.") == []


# 3


def test_more_grams_than_a_map_holds(docs, rows):
    got = sd.substring_dedup(docs, map_keys=0).collect()
    assert sorted(tuple(r) for r in got) == substring_brute(rows, 200)


def substring_brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for r, b in zip(rows, texts):
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((r[0], len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [sd.HOT_ENTRIES, 0])
def test_substrings_against_brute_force(docs, rows, hot):
    got = sd.substring_dedup(docs, hot_entries=hot).collect()
    assert sorted(tuple(r) for r in got) == substring_brute(rows, 200)


def test_short_substrings_and_empty(spark, empty):
    rows = [(1, "abcabcabcabcabcabcabcabcxyz"), (2, "hello world, hello there"), (3, "world, hello then"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in sd.substring_dedup(df, length=12, gram=8).collect()) == substring_brute(rows, 12)
    assert sd.substring_dedup(empty).count() == 0


def test_family_finds_every_repeat():
    rng = np.random.default_rng(1)
    family, everything, found = sd.Family(), [], set()
    for k in range(40):
        keys = rng.integers(0, 900, rng.integers(1, 60)).astype(np.uint64)
        at = np.arange(len(keys)) + 1000 * k
        everything += zip(keys.tolist(), at.tolist())
        found |= set(family.add(keys, at).tolist())
    counts = {}
    for key, _ in everything:
        counts[key] = counts.get(key, 0) + 1
    want_keys = {key for key, n in counts.items() if n > 1}
    where = dict((a, key) for key, a in everything)
    assert {where[a] for a in found} == want_keys
    assert len(family.levels) <= 8


# 4


def test_families_are_of_bounded_size():
    """One gram, or many, in a task: the same ranges whatever a family holds, and no memory for all suffixes at once."""
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(0)
    n, length = 30_000, 200
    shared = rnd.integers(97, 123, (40, 336), dtype=np.uint8)
    body = rnd.integers(97, 123, (n, 336), dtype=np.uint8)
    for k in range(0, n, 3):  # the anchor's gram and a part around it is another's
        a, b = rnd.integers(0, 137), rnd.integers(200, 337)
        body[k, a:b] = shared[k % 40, a:b]
    for grams in (1, 500):
        gram = np.arange(n) % grams
        columns = [pa.array(gram), pa.array(np.arange(n)), pa.array(np.full(n, 136, np.int32)), pa.array([x.tobytes() for x in body], pa.binary()), pa.array(np.arange(n) % 7 == 0)]
        table = pa.table(columns, names=["gram", "context", "left", "body", "twice"])
        found, peak = {}, {}
        for suffixes in (50_000, 1 << 40):
            tracemalloc.start()
            found[suffixes] = sorted(r for b in sd.covered_ranges(iter(table.to_batches(1000)), length, suffixes) for r in zip(*(c.to_pylist() for c in b.columns)))
            peak[suffixes] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
        print(grams, peak, len(found[50_000]))
        assert found[50_000] == found[1 << 40] and len(found[50_000]) > n // 4
        assert peak[50_000] < peak[1 << 40] / 2
    assert list(sd.covered_ranges(iter([]), length)) == []


def quality_brute(x):
    x = x or ""
    w = re.findall(WORD, x)
    lines = [t for t in x.split("\n") if re.search(WORD, t)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(docs, rows, empty):
    got = sorted((tuple(r) for r in qr.quality_report(docs).collect()), key=repr)
    want = []
    for r in rows:
        c = quality_brute(r[1])
        want.append((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert sorted((g[:7] for g in got), key=repr) == sorted(want, key=repr)
    for g in got:
        assert g[7] == (g[8] is None) and (not g[6] or g[8] == "base")
    junk = {r[0] for r in rows if r[1] and r[1].startswith("*** ###")}
    assert all(not g[7] for g in got if g[0] in junk)
    clean = [r[0] for r in rows[:24]]
    assert all(g[7] for g in got if g[0] in clean)
    assert qr.quality_report(empty).count() == 0


def test_rule_order_changes_no_verdict(rows):
    import pyarrow as pa

    from lakeseek.llm import _text as tx

    s = qr.Slice(*tx.texts(pa.array([r[1] for r in rows], pa.string())))
    counts = qr.base_counts(s)
    a = qr.judge(s, counts, qr.RULES) < 0
    assert (a == (qr.judge(s, counts, qr.RULES[::-1]) < 0)).all()
    assert {r.name for r in qr.plan([r[1] for r in rows])} == {r.name for r in qr.RULES}


# 5


def test_mix_meets_targets(docs, rows, empty):
    run = lambda: sorted((tuple(r) for r in mx.mix_sources(docs, source_weights, keep=("source",)).collect()), key=repr)
    got = run()
    assert len(got) == len(rows) and got == run()
    sizes, taken, target, largest = {}, {}, {}, {}
    for _, size, source_size, goal, copies, words, source in got:
        assert words == size * copies and 0 <= copies <= 2
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + words
        target[source], largest[source] = goal, max(size, largest.get(source, 0))
    assert sum(sizes.values()) == sum(len(re.findall(WORD, r[1] or "")) for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mx.quotas([sizes[s] for s in order], source_weights(order))
    for s, t in zip(order, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= largest[s] + 1
    assert mx.mix_sources(empty, source_weights).count() == 0


def test_flow_prefers_fresh_words():
    flow = mx.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150.0, "b": 60.0})
    assert sum(f.get("a", 0) for f in flow.values()) == 150 and sum(f.get("b", 0) for f in flow.values()) == 60
    assert sum(flow["a",].values()) == 100 and sum(flow["a", "b"].values()) == 100  # nothing twice
    assert mx.quotas([100, 10], [1, 1]) == [145.0, 20.0]


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(k, "w " * 10, ["a", "b"] if k % 2 else ["a"]) for k in range(40)], "doc_id long, text string, source array<string>")
    out = mx.mix_sources(df, lambda names: [1, 1])
    assert {r.copies for r in out.collect()} <= {0, 1, 2}


# 6


def test_passages_of_fifty_words(docs, rows, empty):
    got = sc.fuzzy_passages(docs).collect()
    words = {}
    for r in rows:
        words.setdefault(r[0], re.findall(WORD, (r[1] or "").lower()))
    at = {}
    for i, r in enumerate(rows):
        w = re.findall(WORD, (r[1] or "").lower())
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(i)
    must = {rows[i][0] for v in at.values() if len(v) > 1 for i in v}
    hit = {r.doc_id for r in got}
    assert must <= hit and len(must) > 8
    unlike = {r[0] for r in rows[6:24]}
    assert not hit & unlike
    assert all(r.n_match >= 40 for r in got)
    assert sc.fuzzy_passages(empty).count() == 0


def test_alignment_and_chains():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(0, 25))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[i] == b[j]))
        pairs = sc.align(a, b)
        assert len(pairs) == best[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    x = np.array([0, 10, 20, 500, 510, 520])
    four = np.full(6, 4)
    assert [c.tolist() for c in sc.chains(x, x + 7, four, four)] == [[0, 1, 2], [3, 4, 5]]
    assert [a.tolist() for a in sc.segments(np.array([0, 2, 9, 60, 61]), np.array([5, 7, 14, 65, 90]))] == [[0, 60, 61], [5, 65, 90], [13, 4, 4], [10, 4, 4]]


def test_every_run_of_an_alignment_is_found():
    rng = np.random.default_rng(3)
    for first, gap, second in ((60, 40, 60), (60, 60, 60), (100, 60, 60), (100, 80, 100), (120, 140, 120), (60, 140, 60)):
        one, two = rng.integers(0, 9999, first), rng.integers(0, 9999, second)
        a, b = (np.concatenate([one, rng.integers(0, 9999, gap), two]) for _ in range(2))
        pairs = sc.align(a, b)
        got = sc.parts(pairs, 50, 0.8)
        assert [any(abs(pairs[p][0] - s) < 9 and abs(pairs[q - 1][0] + 1 - e) < 9 for p, q in got) for s, e in ((0, first), (first + gap, first + gap + second))] == [True, True]
    fits = lambda x, p, q: min(x[q][0] - x[p][0], x[q][1] - x[p][1]) + 1 >= 10 and q - p + 1 >= 0.8 * (max(x[q][0] - x[p][0], x[q][1] - x[p][1]) + 1)
    for _ in range(300):
        x = np.cumsum(rng.choice([1, 1, 1, 2, 6], (rng.integers(2, 60), 2)), axis=0).tolist()
        got = sc.parts(x, 10, 0.8)
        assert all(fits(x, p, q - 1) for p, q in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        for p in range(len(x)):
            for q in range(p + 1, len(x)):
                assert not fits(x, p, q) or any(p < e and s <= q for s, e in got)


def test_passages_whose_seeds_lead_elsewhere(spark):
    rnd = random.Random(8)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(24):
        one = say(60)
        for part in (one, one, one[:30], one[30:]):
            texts.append(say(70) + part + say(70))
    for _ in range(6):  # two passages of one pair, in one order
        one, two = say(60), say(60)
        texts += [say(9) + one + say(50) + two + say(9) for _ in range(2)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sc.fuzzy_passages(docs).collect()
    found = {(r.doc_id, r.partner_id) for r in got}
    assert found == {x for k in range(0, 96, 4) for x in ((k, k + 1), (k + 1, k))} | {x for k in range(96, 108, 2) for x in ((k, k + 1), (k + 1, k))}
    assert all(sum(r.doc_id == k for r in got) == 2 for k in range(96, 108))


@pytest.mark.parametrize("quotes", [0, 4, 12, 32])
def test_quotations_hide_no_passage(spark, quotes):
    rnd = random.Random(quotes)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(60):
        one = say(72)
        pairs.append((len(texts), len(texts) + 1))
        texts += [say(60) + one + say(60) for _ in range(2)]
        for _ in range(quotes):
            k = rnd.randrange(54)
            texts.append(say(50) + one[k : k + 18] + say(50))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    docs = spark.createDataFrame([(ids[k], " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.partner_id) for r in sc.fuzzy_passages(docs).collect()}
    assert got == {x for a, b in pairs for x in ((ids[a], ids[b]), (ids[b], ids[a]))}


def test_all_places_of_repeated_seeds_meet():
    rnd = random.Random(3)
    x, y = ([sorted(rnd.sample(range(3000), n)) for n in sizes] for sizes in ((1, 40, 3, 200, 0), (5, 60, 4, 300, 9)))
    flat = lambda v: (np.array([p for g in v for p in g]), np.cumsum([0, *map(len, v)])[:-1], np.array([*map(len, v)]))
    rows = [r for part in sc.meetings(*flat(x), *flat(y), 50) for r in zip(*(c.tolist() for c in part))]
    for i, (one, two) in enumerate(zip(x, y)):
        met = np.zeros((len(one), len(two)), bool)
        for _, a, b, c, d in (r for r in rows if r[0] == i):
            met |= np.outer((np.array(one) >= a) & (np.array(one) <= b), (np.array(two) >= c) & (np.array(two) <= d))
        assert met.all()
    assert any(a < b and c < d for _, a, b, c, d in rows)


@pytest.mark.parametrize("texts", [2, 5])
def test_passages_of_repeated_seeds(spark, texts):
    rnd = random.Random(texts)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    phrases = [say(7) for _ in range(9)]

    def scattered():
        return [w for j in rnd.sample(range(9), 9) for w in (*phrases[j], *say(12), *phrases[(j + 3) % 9], *say(70))]

    rows = []
    for k in range(texts):  # the passage is at another place among those of its seeds in each text, and no seed lies across phrases
        whole = [w for p in phrases for w in (*p, *say(1))]
        before = [w for _ in range(k + 1) for w in scattered()]
        rows.append((k, " ".join([*say(60), *before, *whole, *say(70), *[w for _ in range(texts - k) for w in scattered()]]), 60 + len(before)))
    rows += [(90 + k, "again and " * 10_000 + " ".join(say(60)), None) for k in range(3)]
    got = sc.fuzzy_passages(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    for k, _, at in rows:
        assert any(r.doc_id == k and (at is None or r.start <= at + 5 and r.end >= at + 58) for r in got), k


def test_recall_of_changed_passages(spark):
    rnd = random.Random(9)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, must = [], set()
    for share in (0.8, 0.85, 0.9, 0.95):
        for n in (50, 60):
            for _ in range(40):
                one = say(n)
                two = list(one)
                for i in rnd.sample(range(1, n - 1), int(n * (1 - share) + 1e-9)):
                    two[i] = say(1)[0]
                pair = [say(40) + one + say(40), say(40) + two + say(40)]
                ids = {w: k for k, w in enumerate({w for t in pair for w in t})}
                pairs = sc.align(*(np.array([ids[w] for w in t]) for t in pair))
                if sc.parts(pairs, 50, 0.8):
                    must |= {len(texts), len(texts) + 1}
                texts += pair
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    hit = {r.doc_id for r in sc.fuzzy_passages(docs).collect()}
    assert len(must) == len(texts) and hit <= must and len(hit) >= 0.98 * len(must), len(hit) / len(must)


def test_copies_give_no_seeds(monkeypatch):
    rnd = random.Random(4)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    one, two = say(60), say(60)
    texts = [" ".join(t) for t in (one, two + say(9), two + say(9), say(99), say(99))] + ["copy " * 4 + " ".join(say(60))] * 2
    batch = sc._batch(["mark", "text"], [sc.pa.int64(), sc.pa.string()], list(enumerate(texts)))
    keys = sc.text_key(*sc.tx.texts(sc.pa.array(texts)))
    name = sc.text_names(batch.column(0), keys)
    maps = np.zeros(1 << 13, np.uint8), np.zeros(1 << 13, np.uint8)
    for at in sc.holds.__globals__["_places"](name[6:], 16):
        maps[0][at >> 3] |= np.left_shift(1, at & 7).astype(np.uint8)
    assert sc.copied(name, maps).tolist() == [False] * 6 + [True] and not sc.copied(name, (None, maps[1])).any()
    pieces = list(sc.seed_pieces(iter([batch]), 50, 4, maps))
    shared = [r for b in sc.shared_seeds(iter(pieces)) for r in zip(*(c.to_pylist() for c in b.columns))]
    first = np.frombuffer(next(r[3] for r in shared if r[1] < 0), np.int64)
    places = np.concatenate([sc._places(r[2], r[3]) for r in shared if r[1] >= 0])
    assert set(np.searchsorted(first, places, "right") - 1) == {1, 2}
    # texts that no one asks for aren't cut into words
    sizes, scan = [], sc.tx.scan
    monkeypatch.setattr(sc.tx, "scan", lambda buf, off, **more: sizes.append(len(off) - 1) or scan(buf, off, **more))
    named = np.zeros(1 << 13, np.uint8)
    for at in sc.holds.__globals__["_places"](keys[[3, 6]], 16):
        named[at >> 3] |= np.left_shift(1, at & 7).astype(np.uint8)
    (got,) = sc.named_words(iter([batch]), named, maps)
    words = scan(*sc.tx.texts(sc.pa.array([texts[3], texts[5]])), lower=True).hash >> np.uint64(32)
    assert sizes == [2] and got.column(0).to_pylist() == keys[[3, 5]].tolist()
    assert b"".join(got.column(1).to_pylist()) == words.astype("<u4").tobytes()


def test_alignments_of_long_texts_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9000, 16_000), rng.integers(0, 9000, 16_000)
    tracemalloc.start()
    pairs = sc.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) > 100 and all(a[i] == b[j] for i, j in pairs)
    assert peak < 25_000_000, peak  # all rows of bits: 32 MB


# 10

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items):
    split = lambda x: ITEM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    win = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for r in rows:
        w = split(r[1])
        hit, found = set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if s := win.get(tuple(w[k : k + n])):
                    found |= s
                    hit.update(range(k, k + n))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench_items(rows):
    part = rows[2][1].split()
    return [(1, " ".join(part[3:20])), (2, " ".join(part[10:24])), (11, "two, WORDS"), (3, None), (4, ""), (5, "the the the"), (6, rows[7][1]), (7, rows[7][1])]


def test_contamination_against_brute_force(spark, docs, rows, empty):
    items = bench_items(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.contamination(docs, bench).collect()), key=repr)
    assert got == leaks(rows, items)
    assert dc.contamination(empty, bench).count() == 0
    nothing = dc.contamination(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0]
    assert nothing == 0
    # many shards, more than a worker keeps, give the same
    assert len(dc.build_shards(bench, shard_words=3)) > dc.KEPT_SHARDS
    sharded = sorted((tuple(r) for r in dc.contamination(docs, bench, shard_words=3).collect()), key=repr)
    assert sharded == got


def test_spans_are_cut(spark, docs, rows):
    bench = spark.createDataFrame(bench_items(rows)[:2], "item_id long, text string")
    clean = dc.decontaminate(docs, bench, max_coverage=1.0)
    assert clean.columns == docs.columns
    assert dc.contamination(clean, bench).where("contaminated").count() == 0
    assert clean.count() == len(rows)
    whole = spark.createDataFrame([(1, rows[7][1])], "item_id long, text string")
    assert {r[0] for r in rows} - {r.doc_id for r in dc.decontaminate(docs, whole).collect()} == {7}


def test_automata_are_written_as_plain_values(spark):
    """Workers know the package by value, so a shard must not need its classes by name."""
    import pickletools

    from lakeseek.llm._shared import file_system

    items = [(1, "a b c d"), (None, "b c"), (3, "x")]
    (file,) = dc.build_shards(spark.createDataFrame(items, "item_id long, text string"), window=3)
    fs, name = file_system(file)
    with fs.open_input_stream(name) as f:
        raw = f.read()
    assert not any("lakeseek" in str(arg) for _, arg, _ in pickletools.genops(raw))
    w = dc.tx.scan(*dc.tx.texts(dc.pa.array(["z a b c d z b c", "x"])), dc.tx.ALNUM, lower=True)
    hit, found = dc.all_hits([file], w)
    assert hit.tolist() == [False, True, True, True, True, False, True, True, True]
    assert found == {0: {"1", None}, 1: {"3"}}
