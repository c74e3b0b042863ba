"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Documents give k-mers of words, sampled by minimizers: a common run of
``k + window - 1`` words (7) has a common seed. Passages of 50 and 60 words
with 80 to 95 % of equal words are found like by brute force but for 2 % at
most (tests/llm). Seeds travel as packed arrays to buckets, which keep those
that occur twice; back at their documents, those without others near them go.

A seed is then joined with its leader, of the texts that hold it the one with
the longest stretch of shared seeds there (of equal ones, that of least key),
so a passage that thousands share gives a row a text and not a row a pair, and
a short quotation leads no passage. All places of a seed in a text meet all in
its leader. Where these are more than ``PLACES`` pairs, places within
``min_words`` of each other are runs, and two runs of more pairs than that meet
as one box, from the first to the last place of each, which goes to the
alignment whatever else lies in it; so a seed that both repeat closely costs a
row and not a product. Seeds on one diagonal are segments, and the segments of a text
and its leader are chained in order: a chain scores the words of its segments less a cost
for the gaps, and the best predecessor is a prefix maximum in a Fenwick
tree. The words of a chain and ``min_words`` around it are then aligned
(longest common subsequence on bit vectors) and cut into all runs with enough
matching words.

A passage may have seeds whose leaders hold too little of it. So seeds that
lie in no passage found go through further rounds: each is paired with the
seed of least hash 30 to 46 words after it, the texts that hold such a pair
meet ``LEADERS`` leaders of it at all its places, and four times as many in the next round, until no
pair has two texts left. Few texts hold such a pair but for a common passage.

Equal texts are one text here and reported as copies: but for a few, only the
first gives seeds. Texts and k-mers are
known by 64-bit hashes, words in an alignment by 32 bits.

Result: one row for each passage of a text and its leader, in both directions
(a leader has at least one row, with its least partner), so that every
document with a repeated passage has a row and no pair list is needed: the
documents of one ``class_id`` share passages with it.

Edge cases: null, empty and short texts have no passage; a passage repeated
within one text alone isn't reported; repeated rows are copies; very long texts
are read whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._bitmap import bit_map, holds
from ._exchange import batch as _batch
from ._exchange import bucket_of, content_name, gathered, split_rows
from ._shared import drop, small_batches, tidied, written
from .suffix_dedup import _window_min, text_key

_U = np.uint64
_I = np.int64
K, WINDOW = 4, 4
GAP = 0.12
#: Seeds and words of one exchanged piece, and text looked at together.
CHUNK_SEEDS, CHUNK_WORDS, SLICE_BYTES = 1_500_000, 1 << 24, 1 << 20
#: Places of a seed in a text times those in its leader that meet as pairs; runs of more meet as a box.
PLACES = 16
#: Places, or pairs of them, that are looked at together.
MEET = 1_000_000
#: Matches of an alignment that are looked at together.
BLOCK = 256
#: Leaders of a seed pair in the second round, and the distance of its seeds.
LEADERS, FAR = 8, (30, 46)
#: Seeds further apart than this don't belong to one stretch.
STRETCH = 16


def seeds(w: tx.Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, word positions and documents of the minimizers of a slice."""
    n = len(w.hash) - k + 1
    none = np.zeros(0, _I)
    if n < 1:
        return none.astype(_U), none, none
    with np.errstate(over="ignore"):
        h = np.zeros(n, _U)
        for j in range(k):
            h = h * _U(0xFF51AFD7ED558CCD) + w.hash[j : n + j]
        h = tx.mix(h)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    inside = doc[:n] == doc[k - 1 :]
    key = h & ~_U((1 << 22) - 1)
    key[~inside] = np.iinfo(np.uint64).max - _U((1 << 22) - 1)
    if n >= window:
        low = _window_min(key | (np.arange(n, dtype=_U) & _U((1 << 22) - 1)), window) & _U((1 << 22) - 1)
        base = np.arange(len(low))
        at = base - (base & ((1 << 22) - 1)) + low.astype(_I)
        at = np.where(at < base, at + (1 << 22), at)
        at = np.unique(at)
    else:
        at = np.arange(n)
    at = at[inside[at]]
    return h[at], at - w.off[:-1][doc[at]], doc[at]


def segments(x: np.ndarray, y: np.ndarray, k: int = K, reach: int = 2 * WINDOW + K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds (x, y) on one diagonal within ``reach`` of each other as segments: first x, first y, length and words in seeds."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (y[1:] - x[1:] != y[:-1] - x[:-1]) | (x[1:] - x[:-1] > reach)
    at = np.flatnonzero(new)
    step = np.minimum(np.diff(x, append=x[-1:] + k), k)
    step[np.append(at[1:] - 1, len(x) - 1)] = k
    last = np.append(at[1:], len(x)) - 1
    return x[at], y[at], x[last] - x[at] + k, np.add.reduceat(step, at)


def chains(x: np.ndarray, y: np.ndarray, size: np.ndarray, gain: np.ndarray, gap: float = GAP) -> list[np.ndarray]:
    """Best chains of segments, as index arrays; each segment is in one chain at most.

    A segment covers ``size`` words of both texts from (x, y) on and is worth
    ``gain``. With a gap cost linear in both distances, its best predecessor is the
    prefix maximum over smaller ends of ``score + gap * (x + y)`` at the end.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(1, _I)]
    ends = np.unique(y + size)
    xs, ys, rank = x.tolist(), y.tolist(), (np.searchsorted(ends, y + size) + 1).tolist()
    below = np.searchsorted(ends, y, "right").tolist()
    x_end, length = (x + size).tolist(), size.tolist()
    width = len(ends) + 1
    tree_v, tree_i = [float("-inf")] * width, [-1] * width
    score, back = [0.0] * n, [-1] * n
    worth = gain.tolist()
    todo = sorted(range(n), key=x_end.__getitem__)
    done = 0
    for i in np.lexsort((y, x)).tolist():
        while done < n and x_end[todo[done]] <= xs[i]:
            j = todo[done]
            done += 1
            v, r = score[j] + gap * (xs[j] + ys[j] + 2 * length[j]), rank[j]
            while r < width:
                if v > tree_v[r]:
                    tree_v[r], tree_i[r] = v, j
                r += r & -r
        best, j, r = float("-inf"), -1, below[i]
        while r > 0:
            if tree_v[r] > best:
                best, j = tree_v[r], tree_i[r]
            r -= r & -r
        more = best - gap * (xs[i] + ys[i]) if j >= 0 else 0.0
        score[i] = worth[i] + max(0.0, more)
        back[i] = j if more > 0 else -1
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        out.append(np.array(chain[::-1]))
    return out


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each group of ``n`` members, and the number of each member in it."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def bounded(n: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of groups with about ``most`` members together, one group at least."""
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def meetings(x: np.ndarray, x_at: np.ndarray, x_n: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_n: np.ndarray, margin: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Where the places ``x[x_at[i]:x_at[i] + x_n[i]]`` and those of y meet: i, first and last place in x, and in y.

    Places ascend. Every pair of places is given, or lies in a box of two runs
    whose places are within ``margin`` of each other.
    """

    def runs(v: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First run of each group and number of its runs; first place of each run and number of its places."""
        w, k = spread(n)
        place = at[w] + k
        new = k == 0
        new[1:] |= v[place[1:]] - v[place[:-1]] > margin
        edge = np.flatnonzero(new)
        per = np.bincount(w[edge], minlength=len(n))
        return np.cumsum(per) - per, per, place[edge], np.diff(np.append(edge, len(w)))

    def pairs(i: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for part in bounded(m * n, MEET):
            w, k = spread((m * n)[part])
            p, q = x[a[part][w] + k // n[part][w]], y[b[part][w] + k % n[part][w]]
            yield i[part][w], p, p, q, q

    few = np.flatnonzero(x_n * y_n <= PLACES)
    yield from pairs(few, x_at[few], x_n[few], y_at[few], y_n[few])
    many = np.flatnonzero(x_n * y_n > PLACES)
    for part in bounded((x_n + y_n)[many], MEET):
        i = many[part]
        first, per, x_run, x_size = runs(x, x_at[i], x_n[i])
        first_y, per_y, y_run, y_size = runs(y, y_at[i], y_n[i])
        for now in bounded(per * per_y, MEET):
            w, k = spread((per * per_y)[now])
            r, t = first[now][w] + k // per_y[now][w], first_y[now][w] + k % per_y[now][w]
            who, a, m, b, n = i[now][w], x_run[r], x_size[r], y_run[t], y_size[t]
            one = m * n <= PLACES
            yield from pairs(who[one], a[one], m[one], b[one], n[one])
            yield who[~one], x[a[~one]], x[(a + m - 1)[~one]], y[b[~one]], y[(b + n - 1)[~one]]


def boxes(x: np.ndarray, y: np.ndarray, min_words: int, least: int, wide: list[tuple] | None = None) -> list[tuple]:
    """Ranges (start, end, start, end) of the chains of a text's and its leader's common seeds; of ``least`` seeds, and a third of ``min_words``.

    ``wide``: boxes of runs of repeated seeds, which stay as they are or are joined with chains.
    """
    a, b, size, gain = segments(x, y) if len(x) else (x, y, x, x)
    out = list(dict.fromkeys(wide or []))
    kept = [*out]
    for c in chains(a, b, size - (K - 1), gain) if len(x) else []:
        s, e, ls, le = int(a[c[0]]), int(a[c[-1]] + size[c[-1]]), int(b[c].min()), int((b[c] + size[c]).max())
        if gain[c].sum() > K or least < 2:
            out.append((s, e, ls, le))
    third = min_words // 3
    return [b for b in joined(out, min_words) if max(b[1] - b[0], b[3] - b[2]) >= third or any(b[0] <= w[0] and w[1] <= b[1] and b[2] <= w[2] and w[3] <= b[3] for w in kept)]


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matching word pairs of a longest common subsequence: equal ends as they are, the rest by bit vectors."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    same = a[len(a) - (n - head) :] == b[len(b) - (n - head) :]
    foot = 0 if not len(same) or not same[-1] else len(same) if same.all() else int(np.argmin(same[::-1]))
    if head or foot:
        inner = align(a[head : len(a) - foot], b[head : len(b) - foot])
        return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in inner] + [(len(a) - foot + i, len(b) - foot + i) for i in range(foot)]
    if not n:
        return []
    where: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        where[w] = where.get(w, 0) | 1 << j
    full, width = (1 << len(b)) - 1, (len(b) + 7) // 8
    al, bl = a.tolist(), b.tolist()
    # only each ``step``-th row is kept, those between are made again on the way back
    step = max(64, int(len(al) ** 0.5))
    v, kept = full, []
    for i, w in enumerate(al):
        if i % step == 0:
            kept.append(v)
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full

    def block(k: int) -> list[bytes]:
        """The row before the block and its rows."""
        v = kept[k]
        rows = [v.to_bytes(width, "little")]
        for w in al[k * step : (k + 1) * step]:
            u = v & where.get(w, 0)
            v = ((v + u) | (v - u)) & full
            rows.append(v.to_bytes(width, "little"))
        return rows

    out, i, j = [], len(al) - 1, len(bl) - 1
    first, rows = len(al), []
    while i >= 0 and j >= 0:
        if i < first:
            first = i // step * step
            rows = block(i // step)
        above, here = rows[i - first], rows[i - first + 1]
        up = above[j >> 3] >> (j & 7) & 1
        if al[i] == bl[j] and not here[j >> 3] >> (j & 7) & 1 and (up or j and here[(j - 1) >> 3] >> ((j - 1) & 7) & 1 == 0):
            out.append((i, j))
            i -= 1
            j -= 1
        elif not up:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def best_part(pairs: np.ndarray, penalty: float = 0.5) -> tuple[int, int]:
    """The run of matches whose number, less a cost for the words between them, is greatest."""
    cost = np.zeros(len(pairs))
    cost[1:] = penalty * (np.diff(pairs, axis=0).max(axis=1) - 1)
    total = np.cumsum(1 - cost)
    # a run from p on is worth total[q] - total[p] + 1
    low = np.minimum.accumulate(total)
    q = int(np.argmax(total - low))
    return int(np.argmin(total[: q + 1])), q + 1


def joined(boxes: list[tuple], margin: int) -> list[tuple]:
    """Boxes of chains, those within ``margin`` of each other on both sides made one."""
    out = sorted(boxes)
    k = 0
    while k < len(out):
        s, e, ls, le = out[k]
        for j in range(k + 1, len(out)):
            if out[j][0] > e + margin:
                k += 1
                break
            if out[j][2] <= le + margin and ls <= out[j][3] + margin:
                out[k] = (s, max(e, out[j][1]), min(ls, out[j][2]), max(le, out[j][3]))
                del out[j]
                break
        else:
            k += 1
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows alike in the first ``by`` columns stay together."""
    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(p) for p in zip(rest, columns)]
        n = len(columns[0])
        if not n:
            continue
        same = np.logical_and.reduce([c == c[-1] for c in columns[:by]])
        last = n - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def whole_lists(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Fields of an Arrow column of lists of two-field structs, each sorted in its list; first element and length of each list."""
    off = column.offsets.to_numpy().astype(_I)
    n = np.diff(off)
    at = off[:-1] - off[0]
    fields = {}
    for name, values in zip(("pos", "far"), column.flatten().flatten()):
        v, w = values.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
        fields[name] = v[np.lexsort((v, w))]
    return fields, at, n


def free_seeds(pos: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which seeds of a text (in order) lie in no passage."""
    if not len(start):
        return np.ones(len(pos), bool)
    at = np.searchsorted(start, pos, "right") - 1
    return (at < 0) | (np.maximum.accumulate(end)[at] < pos + K)


def near_others(pos: np.ndarray, min_words: int) -> np.ndarray:
    """Which seeds of a text (in order) have others near them over a third of ``min_words``."""
    lo, hi = np.searchsorted(pos, pos - min_words), np.searchsorted(pos, pos + min_words, "right")
    return pos[hi - 1] - pos[lo] + K >= min_words // 3


def open_pairs(seed: np.ndarray, pos: np.ndarray, near: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``far_pairs`` of a text's free seeds, of those with others near them."""
    lo, hi = np.searchsorted(pos, pos - min_words), np.searchsorted(pos, pos + min_words, "right")
    on = np.flatnonzero(near & (hi - lo > 1))
    return far_pairs(seed[on], pos[on])


def parts(pairs: np.ndarray | list[tuple[int, int]], min_words: int, min_share: float) -> list[tuple[int, int]]:
    """Runs of matches of ``min_words`` words and ``min_share`` at least; every other such run overlaps one of them.

    The best part is taken if it is such a run, else the one with most matches;
    what lies left and right of it is cut in the same way.
    """
    if len(pairs) < 2:
        return []
    at = np.asarray(pairs, _I)

    def fits(p: int, q: int) -> bool:
        span = at[q - 1] - at[p] + 1
        return q - p >= 2 and span.min() >= min_words and q - p >= min_share * span.max()

    def longest(lo: int, hi: int) -> tuple[int, int] | None:
        # matches less the words they may span, which no end of a run may have fewer of than its start
        height = np.arange(lo, hi)[:, None] - min_share * at[lo:hi]
        edge = np.arange(0, hi - lo, BLOCK)
        top = np.maximum.reduceat(height, edge, axis=0)
        found, n = None, 1
        for p in range(lo, hi):
            if hi - p <= n or hi - p < min_share * min_words:
                break
            # the last block with an end of a longer run
            for k in np.flatnonzero((top[(p + n - lo) // BLOCK :] >= height[p - lo] - 1).all(axis=1))[::-1].tolist():
                a = lo + (k + (p + n - lo) // BLOCK) * BLOCK
                a, b = max(p + n, a), min(hi, a + BLOCK)
                span = at[a:b] - at[p] + 1
                ok = (span.min(axis=1) >= min_words) & (np.arange(a - p + 1, b - p + 1) >= min_share * span.max(axis=1))
                if ok.any():
                    n = a + int(np.flatnonzero(ok)[-1]) + 1 - p
                    found = (p, p + n)
                    break
        return found

    out, todo = [], [(0, len(pairs))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(2, min_share * min_words):
            continue
        p, q = (lo + i for i in best_part(at[lo:hi]))
        if not fits(p, q):
            run = longest(lo, hi)
            if run is None:
                continue
            p, q = (run[0] + i for i in best_part(at[run[0] : run[1]]))
            if not fits(p, q):
                p, q = run
        out.append((p, q))
        todo += [(lo, p), (q, hi)]
    return sorted(out)


def far_pairs(seed: np.ndarray, pos: np.ndarray, lo: int = FAR[0], hi: int = FAR[1]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of seeds in order, those with others ``lo`` to ``hi`` words on: hash of the pair with the one of least hash, and both places."""
    first, end = np.searchsorted(pos, pos + lo), np.searchsorted(pos, pos + hi, "right")
    h = tx.mix(seed.view(_U))
    best = first.copy()
    for k in range(1, int((end - first).max(initial=0))):
        now = first + k
        on = np.flatnonzero(now < end)
        better = h[now[on]] < h[best[on]]
        best[on[better]] = now[on[better]]
    on = np.flatnonzero(first < end)
    with np.errstate(over="ignore"):
        pair = tx.mix(h[on] * _U(0x9E3779B97F4A7C15) + h[best[on]])
    return pair.view(_I), pos[on], pos[best[on]]


_SEEDS = "chunk long, bucket int, high binary, own binary, low binary"
_NAMES, _KINDS = ["chunk", "bucket", "high", "own", "low"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _places(high: bytes, own: bytes) -> np.ndarray:
    n = np.frombuffer(high, "<i4")
    return (np.repeat(np.arange(len(n)), n) << 16) + np.frombuffer(own, "<u2")


def _packed(at: np.ndarray) -> tuple[bytes, bytes]:
    return np.bincount(at >> 16).astype("<i4").tobytes(), at.astype("<u2").tobytes()


def chosen(buf: np.ndarray, off: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of some of the texts, in their order."""
    size = np.diff(off)
    which = np.zeros(len(size), bool)
    which[on] = True
    return buf[np.repeat(which, size)], np.concatenate([[0], np.cumsum(size[which])]).astype(off.dtype)


def text_names(mark: pa.Array, key: np.ndarray) -> np.ndarray:
    """A number for each row, of the hash of its id and its text's key."""
    with np.errstate(over="ignore"):
        return tx.mix(mark.to_numpy(zero_copy_only=False).view(_U) * _U(0x9E3779B97F4A7C15) + key.view(_U)).view(_I)


#: Bit maps of the names of rows that repeat another row's text, and of the other rows that the first map holds by chance.
Copies = tuple[np.ndarray | None, np.ndarray | None]


def copied(name: np.ndarray, copies: Copies) -> np.ndarray:
    """True for most rows that repeat a text, and for no other row; for none if a map is missing."""
    if copies[0] is None or copies[1] is None:
        return np.zeros(len(name), bool)
    return holds(copies[0], name) & ~holds(copies[1], name)


def seed_pieces(batches: Iterator[pa.RecordBatch], min_words: int, buckets: int, copies: Copies) -> Iterator[pa.RecordBatch]:
    """Seeds of the texts of ``min_words``, without most copies, by chunk and bucket; a row a chunk (bucket -1) has its texts and their first words."""
    known: set[int] = set()
    held: list[tuple] = []
    words = have = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([h[0] for h in held])
        first = np.concatenate([h[1] for h in held])
        h, at = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        name = content_name(keys)
        rows = [(name, -1, keys.tobytes(), first.astype(_I).tobytes(), b"")]
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        h, at, bucket = h[order].astype("<u4"), at[order], bucket[order]
        for b, lo, hi in split_rows(bucket, buckets):
            rows.append((name, b, *_packed(at[lo:hi]), h[lo:hi].tobytes()))
        yield _batch(_NAMES, _KINDS, rows)

    for batch in batches:
        for part, buf, off in tx.slices(batch, "text", SLICE_BYTES):
            key = text_key(buf, off)
            on = np.flatnonzero(~copied(text_names(part.column(0), key), copies))
            key = key[on]
            w = tx.scan(*chosen(buf, off, on), lower=True)
            new = np.zeros(len(key), bool)
            for d in np.flatnonzero(w.counts >= min_words).tolist():
                x = int(key[d])
                new[d] = x not in known
                if len(known) < 500_000:
                    known.add(x)
            if not new.any():
                continue
            h, at, doc = seeds(w)
            on = new[doc]
            size = np.where(new, w.counts, 0)
            start = np.cumsum(size) - size
            if held and (have + int(on.sum()) > CHUNK_SEEDS or words + int(size.sum()) > CHUNK_WORDS):
                yield from flush()
                held, words, have = [], 0, 0
            held.append((key[new], start[new] + words, h[on], (at + start[doc])[on] + words))
            have, words = have + int(on.sum()), words + int(size.sum())
    if held:
        yield from flush()


def shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the seeds that occur twice or more."""
    groups = gathered(batches, 1)
    for row in groups.pop(-1, []):
        yield _batch(_NAMES, _KINDS, [row])
    while groups:
        _, rows = groups.popitem()
        low = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
        order = np.argsort(low)
        same = low[order[1:]] == low[order[:-1]]
        twice = np.zeros(len(low), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at, out = 0, []
        for chunk, bucket, high, own, raw in rows:
            now = np.frombuffer(raw, "<u4")
            on = twice[at : at + len(now)]
            at += len(now)
            if on.any():
                out.append((chunk, bucket, *_packed(_places(high, own)[on]), now[on].tobytes()))
        yield _batch(_NAMES, _KINDS, out)


def near_seeds(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the shared seeds with others near them, under their text's key, with place and length of their stretch."""
    groups = gathered(batches, 0)
    while groups:
        _, rows = groups.popitem()
        keys, first = next((np.frombuffer(r[2], _I), np.frombuffer(r[3], _I)) for r in rows if r[1] < 0)
        rows = [(r[1], _places(r[2], r[3]), np.frombuffer(r[4], "<u4")) for r in rows if r[1] >= 0]
        if not rows:
            continue
        at, low = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        bucket = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
        order = np.argsort(at)
        at, low, bucket = at[order], low[order], bucket[order]
        doc = np.searchsorted(first, at, "right") - 1
        pos = at - first[doc]
        far = doc * (1 << 32) + pos
        lo, hi = np.searchsorted(far, far - min_words), np.searchsorted(far, far + min_words, "right")
        near = far[hi - 1] - far[lo] + K >= min_words // 3
        edge = np.flatnonzero(np.concatenate([[True], np.diff(far) > STRETCH]))
        run = np.repeat(np.diff(np.append(edge, len(far))), np.diff(np.append(edge, len(far))))
        last = np.repeat(np.append(edge[1:], len(far)) - 1, np.diff(np.append(edge, len(far))))
        length = np.minimum(far[last] - far[last - run + 1] + K, 255)
        order = np.flatnonzero(near)[np.argsort(bucket[near], kind="stable")]
        low, key, pos, length, bucket = low[order], keys[doc[order]], pos[order], length[order], bucket[order]
        out, n = [], int(bucket.max(initial=-1)) + 1
        for b, x, y in split_rows(bucket, n):
            out.append((b, low[x:y].tobytes(), key[x:y].tobytes(), pos[x:y].astype("<i4").tobytes(), length[x:y].astype(np.uint8).tobytes()))
        yield _batch(["bucket", "low", "key", "pos", "length"], [pa.int32(), *[pa.binary()] * 4], out)


def named_words(batches: Iterator[pa.RecordBatch], named: np.ndarray | None, copies: Copies) -> Iterator[pa.RecordBatch]:
    """Keys and words of the texts that a bit map names, without most copies; no others are cut into words."""
    known: set[int] = set()
    for batch in batches:
        for part, buf, off in tx.slices(batch, "text", SLICE_BYTES):
            key = text_key(buf, off)
            some = holds(named, key) & ~copied(text_names(part.column(0), key), copies)
            on = np.array([d for d in np.flatnonzero(some).tolist() if key[d] not in known], _I)
            if not len(on):
                continue
            if len(known) < 500_000:
                known.update(key[on].tolist())
            w = tx.scan(*chosen(buf, off, on), lower=True)
            h = (w.hash >> _U(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array([h[w.off[d] : w.off[d + 1]].tobytes() for d in range(len(on))], pa.binary())], names=["key", "words"])


class Holders:
    """The texts that hold each seed of a bucket: runs of places by seed and text."""

    def __init__(self, rows: list[tuple]):
        low, key, pos, length = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((1, "<u4"), (2, "<i8"), (3, "<i4"), (4, np.uint8)))
        order = np.lexsort((pos, key, low))
        self.low, self.key, self.pos, length = low[order], key[order], pos[order], length[order]
        new_seed = np.concatenate([[True], self.low[1:] != self.low[:-1]])
        self.start = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]]) | new_seed)
        self.size = np.diff(np.append(self.start, len(self.low)))
        self.seed = (np.cumsum(new_seed) - 1)[self.start]
        self.texts = np.bincount(self.seed)
        best = np.maximum.reduceat(length, self.start)
        order = np.lexsort((self.key[self.start], -best.astype(_I), self.seed))
        self.leader = order[np.concatenate([[True], np.diff(self.seed[order]) > 0])]

    def anchors(self, margin: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Where the places of a text and of its leader meet: keys of both, first and last place of both."""
        lead = self.leader[self.seed]
        run = np.flatnonzero(lead != np.arange(len(lead)))
        one, two = self.start[run], self.start[lead[run]]
        for i, *ends in meetings(self.pos, one, self.size[run], self.pos, two, self.size[lead[run]], margin):
            yield self.key[one[i]], self.key[two[i]], *ends


def fuzzy_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, min_share: float = 0.8, least: int = 2) -> DataFrame:
    """(id, ``partner_id``, ``class_id``, ``start``, ``end``, ``partner_start``, ``partner_end``, ``n_match``): passages, in words."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select(F.xxhash64("doc_id").alias("mark"), "text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                w = tx.scan(buf, off, hashed=False)
                key = text_key(buf, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array(w.counts.astype(np.int64)), pa.array(text_names(part.column(1), key))], names=["doc_id", "key", "n", "name"])

    ids = written(docs.select("doc_id", F.xxhash64("doc_id").alias("mark"), "text").mapInArrow(tidied(keys), f"doc_id {kind}, key long, n long, name long").where(F.col("n") >= min_words), "keys")
    reps = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"), F.min("name").alias("first"))

    def held_by(batches: Iterator[pa.RecordBatch], named) -> Iterator[pa.RecordBatch]:
        """Rows whose first column a bit map may hold."""
        for batch in batches:
            yield batch.filter(pa.array(holds(named.value, batch.column(0).to_numpy(zero_copy_only=False))))

    twice = written(ids.join(reps.where("k > 1").select("key", "first"), "key").where("name <> first").select("name"), "copies")
    named = sc.broadcast(bit_map(twice, "name"))
    others = None
    if named.value is not None:
        chance = written(reps.select("first").mapInArrow(tidied(lambda it: held_by(it, named)), "first long"), "chance")
        others = bit_map(chance, "first")
        drop(spark, chance)
    copies = sc.broadcast((named.value, others))
    drop(spark, twice)

    found = marked.mapInArrow(tidied(lambda it: seed_pieces(it, min_words, buckets, copies.value)), _SEEDS)
    found = found.repartitionById(buckets, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod("chunk", F.lit(buckets)).cast("int"))).mapInArrow(tidied(shared_seeds), _SEEDS)
    found = found.repartition(buckets, "chunk").mapInArrow(tidied(lambda it: near_seeds(it, min_words)), "bucket int, low binary, key binary, pos binary, length binary")
    shared = written(found, "shared")
    by_seed = shared.repartitionById(buckets, F.col("bucket"))

    meet = "key long, leader long, pos int, last int, at int, last_at int"

    def met_rows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in columns], names=["key", "leader", "pos", "last", "at", "last_at"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = gathered(batches, 0)
        while groups:
            h = Holders(groups.popitem()[1])
            for columns in h.anchors(min_words):
                yield from met_rows(*columns)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the seeds that more than two texts hold."""
        groups = gathered(batches, 0)
        while groups:
            b, rows = groups.popitem()
            h = Holders(rows)
            on = np.repeat((h.texts > 2)[h.seed], h.size)
            seed = h.low[on].astype(_I) | b << 32
            for lo in range(0, len(seed), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in (seed, h.key[on], h.pos[on])], names=["seed", "key", "pos"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, leader, pos, last, at, last_at in whole_groups(batches, 2):
            run = (pos < last) | (at < last_at)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (leader[1:] != leader[:-1])) + 1
            edge = np.concatenate([[0], cut, [len(key)]])
            out = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                some = run[a:b]
                if b - a >= least or some.any():
                    wide = list(zip(pos[a:b][some].tolist(), (last[a:b][some] + K).tolist(), at[a:b][some].tolist(), (last_at[a:b][some] + K).tolist()))
                    out += [(key[a], leader[a], *box) for box in boxes(pos[a:b][~some].astype(_I), at[a:b][~some].astype(_I), min_words, least, wide)]
            yield _batch(["key", "leader", "s", "e", "ls", "le"], [pa.int64()] * 6, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(lo, 64).to_pylist():
                    n = len(row["words"]) // 4
                    for s in row["spans"]:
                        a, b = max(0, s["a"]), min(n, s["b"])
                        out.append((row["key"], s["a"], s["b"], a, row["words"][4 * a : 4 * b]))
                yield _batch(["key", "a", "b", "from", "words"], [*[pa.int64()] * 4, pa.binary()], out)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(lo, 256).to_pylist():
                    one, two = np.frombuffer(row["w1"], "<u4"), np.frombuffer(row["w2"], "<u4")
                    if min(np.isin(one, two).sum(), np.isin(two, one).sum()) < min_share * min_words:
                        continue
                    pairs = np.array(align(one, two), _I).reshape(-1, 2)
                    for p, q in parts(pairs, min_words, min_share):
                        (s, ls), (e, le) = pairs[p].tolist(), (pairs[q - 1] + 1).tolist()
                        out.append((row["key"], row["leader"], row["f1"] + s, row["f1"] + e, row["f2"] + ls, row["f2"] + le, q - p))
                yield _batch(["key", "partner", "start", "end", "partner_start", "partner_end", "n_match"], [pa.int64()] * 7, out)

    kinds = "key long, partner long, start long, end long, partner_start long, partner_end long, n_match long"

    def all_words(named) -> DataFrame:
        return marked.mapInArrow(tidied(lambda it: named_words(it, named.value, copies.value)), "key long, words binary")

    def words_of(named: DataFrame, words: DataFrame | None) -> DataFrame:
        """Words of the texts of these keys, by ``words`` or from the documents."""
        bits = sc.broadcast(bit_map(named, "key"))
        found = all_words(bits) if words is None else words.mapInArrow(tidied(lambda it: held_by(it, bits)), "key long, words binary")
        return found.join(named.select("key"), "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))

    def verified(rows: DataFrame, words: DataFrame | None = None) -> DataFrame:
        """Passages of the pairs that have common seeds; ``words``: a table of the words of their texts, if there is one."""
        found = rows.repartition(buckets, "key", "leader").sortWithinPartitions("key", "leader").mapInArrow(tidied(chain), "key long, leader long, s long, e long, ls long, le long")
        found = written(found, "chains")
        # the words of both sides, from the texts that hold them
        sides = found.select("key", (F.col("s") - min_words).alias("a"), (F.col("e") + min_words).alias("b")).unionByName(found.select(F.col("leader").alias("key"), (F.col("ls") - min_words).alias("a"), (F.col("le") + min_words).alias("b"))).distinct()
        wanted = written(sides.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "sides")
        held = words_of(wanted, words).join(wanted, "key")
        pieces = written(held.select("key", "words", "spans").mapInArrow(tidied(cut), "key long, a long, b long, `from` long, words binary"), "pieces")
        left = pieces.select("key", (F.col("a") + min_words).alias("s"), (F.col("b") - min_words).alias("e"), F.col("from").alias("f1"), F.col("words").alias("w1"))
        right = pieces.select(F.col("key").alias("leader"), (F.col("a") + min_words).alias("ls"), (F.col("b") - min_words).alias("le"), F.col("from").alias("f2"), F.col("words").alias("w2"))
        both = found.join(left, ["key", "s", "e"]).join(right, ["leader", "ls", "le"]).select("key", "leader", "f1", "w1", "f2", "w2")
        out = written(both.mapInArrow(tidied(match), kinds), "passages")
        drop(spark, pieces, found, wanted)
        return out

    def unexplained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text: its seeds in no passage, if there are pairs of them."""
        for key, kind, a, b, seed in whole_groups(batches, 1):
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            out = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                n = lo + int(np.searchsorted(kind[lo:hi], 1))
                pos, at = np.unique(a[n:hi], return_index=True)
                free = np.flatnonzero(free_seeds(pos, a[lo:n], b[lo:n]))
                near = near_others(pos, min_words)[free]
                pos, now = pos[free], seed[n:hi][at[free]]
                if len(open_pairs(now, pos, near, min_words)[0]):
                    out.append((key[lo], now.tobytes(), pos.astype("<i4").tobytes(), near.tobytes()))
            yield _batch(["key", "seed", "pos", "near"], [pa.int64(), *[pa.binary()] * 3], out)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the seeds in no passage, those found since then included, with all their places in a text."""
        for batch in batches:
            out, size = [], []
            for key, seed, pos, near, spans in zip(*(c.to_pylist() for c in batch.columns)):
                seed, pos, near = np.frombuffer(seed, "<i8"), np.frombuffer(pos, "<i4").astype(_I), np.frombuffer(near, bool)
                start, end = np.array(sorted((s["start"], s["end"]) for s in spans or []), _I).reshape(-1, 2).T
                free = free_seeds(pos, start, end)
                pair, one, two = open_pairs(seed[free], pos[free], near[free], min_words)
                order = np.lexsort((one, pair))
                pair, one, two = pair[order], one[order], two[order]
                edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
                out.append((pair[edge], np.full(len(edge), key), one, two))
                size.append(np.diff(np.append(edge, len(pair))))
            if out:
                pair, key, one, two = (np.concatenate(c) for c in zip(*out))
                places = pa.StructArray.from_arrays([pa.array(one), pa.array(two)], names=["pos", "far"])
                at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(size))]), pa.int32()), places)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(key), at], names=["seed", "key", "at"])

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the places of the seed pairs of a text and of a leader meet, at both seeds."""
        for batch in batches:
            keys, leaders = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            (x, x_at, x_n), (y, y_at, y_n) = (whole_lists(batch.column(k)) for k in (2, 3))
            for seed in ("pos", "far"):
                for i, *ends in meetings(x[seed], x_at, x_n, y[seed], y_at, y_n, min_words):
                    yield from met_rows(keys[i], leaders[i], *(e.astype(np.int32) for e in ends))

    def both_sides(rows: DataFrame) -> DataFrame:
        return rows.select("key", "start", "end").unionByName(rows.select(F.col("partner").alias("key"), F.col("partner_start").alias("start"), F.col("partner_end").alias("end"))).distinct()

    passages = verified(by_seed.mapInArrow(tidied(lead), meet))
    # what no passage explains meets further leaders, more in each round, until none is left
    rest = by_seed.mapInArrow(tidied(several), "seed long, key long, pos int")
    every = both_sides(passages).select("key", F.lit(0).alias("kind"), F.col("start").alias("a"), F.col("end").alias("b"), F.lit(0).cast("long").alias("seed"))
    every = every.unionByName(rest.select("key", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "seed"))
    rest = written(every.repartition(buckets, "key").sortWithinPartitions("key", "kind", "a").mapInArrow(tidied(unexplained), "key long, seed binary, pos binary, near binary"), "rest")
    drop(spark, shared)
    words = written(all_words(sc.broadcast(bit_map(rest, "key"))), "words")
    leaders, tried, every = LEADERS, None, [passages]
    while True:
        since = both_sides(reduce(DataFrame.unionByName, every[1:], passages.limit(0)))
        spans = since.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        pairs = rest.join(spans, "key", "left").select("key", "seed", "pos", "near", "spans").mapInArrow(tidied(again), "seed long, key long, at array<struct<pos: long, far: long>>")
        if tried is not None:
            pairs = pairs.join(tried, ["seed", "key"], "left_anti")
        pairs = written(pairs, "pairs")
        alone = pairs.groupBy("seed").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("seed")
        pairs = pairs.join(alone, "seed", "left_semi")
        heads = written(pairs.groupBy("seed", F.pmod(F.xxhash64("key"), F.lit(leaders)).alias("slot")).agg(F.min(F.struct("key", "at")).alias("m")).select("seed", F.col("m.key").alias("leader"), F.col("m.at").alias("there")), "heads")
        if heads.isEmpty():
            break
        met = pairs.join(heads, "seed").where("key <> leader").join(heads.select("seed", F.col("leader").alias("key"), F.lit(True).alias("_head")), ["seed", "key"], "left").where("_head is null or key > leader")
        more = verified(met.select("key", "leader", "at", "there").mapInArrow(tidied(meet_again), meet).distinct(), words)
        every.append(more)
        led = heads.select("seed", F.col("leader").alias("key"))
        tried = led if tried is None else tried.unionByName(led)
        drop(spark, pairs)
        leaders *= 4
    passages = written(reduce(DataFrame.unionByName, every).distinct(), "passages")
    drop(spark, rest, words, pairs, *every)
    back = passages.groupBy("partner", "partner_start", "partner_end").agg(F.min(F.struct("key", "start", "end", "n_match")).alias("m"))
    back = back.select(F.col("partner").alias("key"), F.col("m.key").alias("partner"), F.col("partner_start").alias("start"), F.col("partner_end").alias("end"), F.col("m.start").alias("partner_start"), F.col("m.end").alias("partner_end"), F.col("m.n_match").alias("n_match"), F.col("partner").alias("class_key"))
    every = passages.withColumn("class_key", F.col("partner")).unionByName(back)

    out = every.join(reps.select(F.col("key").alias("partner"), F.col("rep").alias("partner_id")), "partner").join(reps.select(F.col("key").alias("class_key"), F.col("rep").alias("class_id")), "class_key")
    out = ids.select("doc_id", "key").join(out, "key").select("doc_id", "partner_id", "class_id", "start", "end", "partner_start", "partner_end", "n_match")
    # copies of one text share all of it with the first
    same = ids.join(reps.where("k > 1"), "key").select("doc_id", F.col("rep").alias("partner_id"), F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(0).cast("long").alias("partner_start"), F.col("n").alias("partner_end"), F.col("n").alias("n_match"))
    out = written(out.unionByName(same), "result")
    drop(spark, ids, passages)
    return out
