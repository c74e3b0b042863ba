"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by the set of sources they belong to. Token capacity
flows from these membership patterns to the source quotas; each further copy
of a pattern's words costs more (convex), so repetition is used only where
fresh words run out. Seeded documents then fill each pattern's flow.

Edge cases: a null source is a source of its own, last in order; a null or
empty text has size 0 and is never taken; an empty table gives no rows;
repeated rows are separate documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Membership patterns, and sources, that the driver's flow network may hold.
MAX_PATTERNS = 200_000


def quotas(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets that split ``share`` of all sizes by weight; none above ``most`` times its size, the excess shared again."""
    total = share * sum(sizes)
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        if weight <= 0:
            break
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(most * sizes[i])
            free.discard(i)
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
    return target


def route(patterns: dict[tuple, int], target: dict, max_copies: int = 2, cost: Callable[[int], int] = lambda copy: copy * copy) -> dict[tuple, dict]:
    """Words of each pattern for each of its sources: a maximal flow of least repetition cost.

    Successive shortest paths with potentials; capacities are words, so the
    number of augmentations follows the network, not the corpus.
    """
    pats, srcs = list(patterns), list(target)
    node = {("s",): 0, ("t",): 1}
    for p in pats:
        node[("p", p)] = len(node)
    for s in srcs:
        node[("q", s)] = len(node)
    to, cap, price, out = [], [], [], [[] for _ in node]

    def arc(a: int, b: int, c: int, w: int) -> int:
        out[a].append(len(to))
        to.extend((b, a))
        cap.extend((c, 0))
        price.extend((w, -w))
        out[b].append(len(to) - 1)
        return len(to) - 2

    uses = {}
    for p in pats:
        for k in range(max_copies):
            arc(0, node[("p", p)], patterns[p], cost(k))
        for s in p:
            if s in target:
                uses[p, s] = arc(node[("p", p)], node[("q", s)], max_copies * patterns[p], 0)
    for s in srcs:
        arc(node[("q", s)], 1, math.floor(target[s] + 0.5), 0)
    potential = [0] * len(node)
    while True:
        far, via = [None] * len(node), [-1] * len(node)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if cap[e] > 0:
                    nd = d + price[e] + potential[a] - potential[to[e]]
                    if far[to[e]] is None or nd < far[to[e]]:
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if far[1] is None:
            break
        for a, d in enumerate(far):
            if d is not None:
                potential[a] += d
        push, a = None, 1
        while a:
            push = cap[via[a]] if push is None else min(push, cap[via[a]])
            a = to[via[a] ^ 1]
        a = 1
        while a:
            cap[via[a]] -= push
            cap[via[a] ^ 1] += push
            a = to[via[a] ^ 1]
    return {p: {s: cap[uses[p, s] ^ 1] for s in p if (p, s) in uses} for p in pats}


def seeded(doc_id: Column, seed: int = 0) -> Column:
    """A pseudo-random order of documents: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix_sources(
    docs: DataFrame,
    weights: Callable[[list], Sequence[float]],
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    share: float = 1.5,
    max_copies: int = 2,
    seed: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row a document: id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted).

    ``source`` is a string column, or an array of strings where sources
    overlap; ``source_size`` and ``target`` are then sums over the document's
    sources. ``weights`` gets the sources by code point, null last. The order
    within a pattern is an md5 of seed and id; its first 16 bits cut every
    pattern into 65,536 buckets, so no task holds a whole source.
    """
    several = docs.schema[source].dataType.typeName() == "array"
    member = F.array_sort(F.array_distinct(F.col(source))) if several else F.array(F.col(source))
    base = docs.select(F.col(doc_id), member.alias("_pattern"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), seeded(F.col(doc_id), seed).alias("_key"), *keep)
    base = written(base, "sizes")
    rows = base.groupBy("_pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources first")
    patterns = {tuple(r[0] or ()): r[1] for r in rows}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for p, n in patterns.items() if s in p) for s in names]
    target = dict(zip(names, quotas(sizes, weights(names), share, max_copies)))
    flow = route(patterns, target, max_copies)
    spark = docs.sparkSession
    size_of = dict(zip(names, sizes))
    plan = spark.createDataFrame(
        [(list(p), sum(size_of[s] for s in p), float(sum(target[s] for s in p)), int(sum(flow[p].values())), int(n)) for p, n in patterns.items()],
        "_pattern array<string>, source_size long, target double, _flow long, _whole long",
    )
    base = base.withColumn("_bucket", F.substring("_key", 1, 4))
    order = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = base.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("_sum")).select("_pattern", "_bucket", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_pattern", "_bucket").orderBy("_key", F.col(doc_id).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # arrays with nulls join null-safe
    placed = placed.join(buckets, placed["_pattern"].eqNullSafe(buckets["_pattern"]) & (placed["_bucket"] == buckets["_bucket"])).drop(buckets["_pattern"]).drop(buckets["_bucket"])
    placed = placed.join(plan, placed["_pattern"].eqNullSafe(plan["_pattern"])).drop(plan["_pattern"])
    middle = 2 * (F.col("_ahead") + F.col("_within")) + F.col("size")
    copies = sum((F.when(middle <= 2 * (F.col("_flow") - k * F.col("_whole")), 1).otherwise(0) for k in range(max_copies)), F.lit(0)).cast("int")
    return placed.select(doc_id, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *keep)
