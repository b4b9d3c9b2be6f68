"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. Each pattern offers its words up to ``copies`` times; the r-th
time costs r - 1, so costs are convex and repeats are used only when needed. A min-cost flow routes this capacity to the sources' quotas. Each flow then
becomes an interval of the pattern's documents in the order of a seeded hash; the interval's ends are found by
refining histograms of the hash, eight bits at a time, so no group of documents is ever sorted or collected. What the document at the edge of
an interval leaves open is filled from documents behind it and then from further copies, until no document with copies left fits. The same is done with the
edge document taken and others left out for it; of both ways the one nearer to the target stays. Where neither comes within ``NEAR`` of the words wanted and the pattern has at most ``FEW``
different hashes, all sums of its documents' copies are searched for the nearest one.

Only the patterns, their flows and 256 sums for each pattern with a divided flow reach the driver; ``MAX_PATTERNS`` bounds them.

Edge cases: a null source is a source of its own, last; a null or empty text has size 0 and takes 0 words; repeated rows of a doc_id have equal hashes and
are taken together; an empty table gives no rows; documents of any length count whole, and a document is
taken at most ``copies`` times; columns besides those named are ignored, or kept where stated.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stage

COPIES = 3
MAX_PATTERNS = 4096
BITS = 32
#: Share of the words wanted that may stay open, hashes of a pattern whose sums are searched, and the most words of such a pattern.
NEAR, FEW, FEW_WORDS = 0.005, 64, 300_000


def default_weight(position: int) -> float:
    return float(1 + position % 3)


def targets(sizes: list[int], weights: list[float], copies: int = COPIES) -> list[float]:
    """Weighted shares of the total; what is above ``copies`` times a source's size is shared again among the others."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > copies * sizes[i]}
        if not over:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = float(copies * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], quotas: list[int], copies: int = COPIES) -> list[tuple[int, int, int, int]]:
    """(pattern, copy, source, words): successive shortest paths with potentials.

    Nodes: a start, one for each pattern, one for each source, an end. Parallel arcs from the start carry the copies of a pattern.
    """
    n_p, n_s = len(supply), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    arcs: list[list] = []  # head, capacity, cost; the arc back is at index ^ 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    first = [[arc(start, p, supply[p], r) for r in range(copies)] for p in range(n_p)]
    route = [(p, s, arc(p, n_p + s, copies * supply[p], 0)) for p in range(n_p) for s in members[p]]
    for s in range(n_s):
        arc(n_p + s, end, quotas[s], 0)
    price = [0] * (end + 1)
    while True:
        far, via, heap, tick = {start: 0}, {}, [(0, 0, start)], count(1)
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b, room, cost = arcs[i]
                if room > 0 and (new := d + cost + price[a] - price[b]) < far.get(b, 1 << 62):
                    far[b], via[b] = new, i
                    heapq.heappush(heap, (new, next(tick), b))
        if end not in far:
            break
        most = max(far.values())
        for v in range(end + 1):
            price[v] += far.get(v, most)
        push, v = 1 << 62, end
        while v != start:
            push, v = min(push, arcs[via[v]][1]), arcs[via[v] ^ 1][0]
        v = end
        while v != start:
            arcs[via[v]][1] -= push
            arcs[via[v] ^ 1][1] += push
            v = arcs[via[v] ^ 1][0]
    flows = []
    for p in range(n_p):
        level = [arcs[i ^ 1][1] for i in first[p]]
        wanted = [(s, arcs[i ^ 1][1]) for q, s, i in route if q == p]
        r = 0
        for s, words in wanted:  # copies in order, sources in order
            while words > 0 and r < copies:
                part = min(words, level[r])
                if part:
                    flows.append((p, r, s, part))
                level[r] -= part
                words -= part
                r += not level[r]
    return flows


def seeded(key: Column, seed: int) -> Column:
    """A 32-bit hash of a key, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cuts(docs: DataFrame, marks: list[int], want: dict[tuple, tuple[int, int, int, int, int]]) -> dict[tuple, tuple[int, int]]:
    """For each key (pattern, low, limit, words, skip) an end ``high`` and the words left over.

    The pattern's documents of at most ``limit`` words, without those of hash ``skip``, with ``low <= hash < high`` have ``words`` less that rest, and those of the next hash
    value would have more. Four passes over histograms with 256 sums for each key; ``docs``: mark, hash, size.
    """
    order = list(want)
    prefix, left, done = [0] * len(order), [want[k][3] for k in order], {}
    for shift in range(BITS - 8, -1, -8):
        keys = [(i, marks[want[k][0]], prefix[i], want[k][1], want[k][2], want[k][4]) for i, k in enumerate(order) if i not in done]
        if not keys:
            break
        # at most MAX_PATTERNS * copies rows and their inner edges
        small = F.broadcast(docs.sparkSession.createDataFrame(keys, "i int, mark long, prefix long, low long, most long, skip long"))
        rows = docs.join(small, "mark").filter((F.shiftright("hash", shift + 8) == F.col("prefix")) & (F.col("hash") >= F.col("low")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0) & (F.col("hash") != F.col("skip")))
        sums: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("i", F.shiftright("hash", shift).bitwiseAND(255).alias("b")).agg(F.sum("size").alias("n")).collect():
            sums.setdefault(r["i"], {})[r["b"]] = r["n"]
        for i, *_ in keys:
            here = sums.get(i, {})
            for b in range(256):
                if here.get(b, 0) > left[i]:
                    prefix[i] = (prefix[i] << 8) + b
                    break
                left[i] -= here.get(b, 0)
            else:
                done[i] = (prefix[i] + 1) << (shift + 8)
    return {k: (done.get(i, prefix[i]), left[i]) for i, k in enumerate(order)}


def _around(low: int, high: int, skip: int) -> list[tuple[int, int]]:
    return [(low, skip), (skip + 1, high)] if low <= skip < high else [(low, high)]


def _filled(docs: DataFrame, marks: list[int], tries: dict[tuple, dict], least: list[int], copies: int) -> None:
    """Fills each try's ``rest`` until no document of its pattern fits that has copies left; intervals are added to its ``parts``.

    A try goes on at ``low`` of copy ``level`` with documents of at most ``most`` words, never with those of hash ``skip``. The rest shrinks or ``low``
    grows with each pass, and each copy takes a document once.
    """
    while True:
        want = {}
        for k, t in tries.items():
            most = min(t["rest"], t["most"])
            if t["level"] < copies and t["rest"] >= least[t["pattern"]]:
                want[k] = (t["pattern"], t["low"], most, t["rest"], t["skip"])
        if not want:
            return
        for k, (high, rest) in _cuts(docs, marks, want).items():
            t = tries[k]
            t["parts"] += [(t["source"], low, end, want[k][2]) for low, end in _around(t["low"], high, t["skip"])]
            t["rest"] = rest
            t["level"], t["low"] = (t["level"] + 1, 0) if high >= 1 << BITS else (t["level"], high + 1)  # what stands at the edge itself does not fit


def nearest_sum(sizes: list[int], copies: int, goal: int) -> list[int]:
    """How often each size is taken, at most ``copies`` times, so that the sum is as near to ``goal`` as can be; of two, the smaller sum."""
    reach = [1]  # after each item, the sums that can be made, as bits
    items = [i for i in range(len(sizes)) for _ in range(copies)]
    for i in items:
        reach.append(reach[-1] | reach[-1] << sizes[i])
    below = reach[-1] & ((1 << (goal + 1)) - 1)
    low, above = below.bit_length() - 1, reach[-1] >> (goal + 1)
    high = goal + 1 + (above & -above).bit_length() - 1 if above else None
    left, times = (high if high is not None and high - goal < goal - low else low), [0] * len(sizes)
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> left & 1:
            times[items[k - 1]] += 1
            left -= sizes[items[k - 1]]
    return times


def _searched(docs: DataFrame, marks: list[int], wanted: dict[int, tuple[int, int]], copies: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """The parts of patterns (source, words wanted) of few documents, from all sums of their copies; patterns of more are not in it. At most ``FEW`` rows of a pattern are collected."""
    at = F.broadcast(docs.sparkSession.createDataFrame([(marks[p], p) for p in wanted], "mark long, pattern int"))
    rows = docs.join(at, "mark").filter("size > 0").groupBy("pattern", "hash").agg(F.sum("size").alias("n"), F.max("size").alias("most"))
    few = rows.groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("words")).filter((F.col("k") <= FEW) & (F.col("words") <= FEW_WORDS)).select("pattern")
    held: dict[int, list] = {}
    for r in rows.join(F.broadcast(few), "pattern").orderBy("pattern", "hash").collect():
        held.setdefault(r["pattern"], []).append(r)
    out = {}
    for p, docs_ in held.items():
        source, goal = wanted[p]
        times = nearest_sum([r["n"] for r in docs_], copies, goal)
        out[p] = [(source, r["hash"], r["hash"] + 1, r["most"]) for r, n in zip(docs_, times, strict=True) for _ in range(n)]
    return out


def _marked(members: Column) -> Column:
    """A 64-bit key of a pattern, in which null members differ from all others; ``plan`` tests that no two patterns share one.

    Joins on a long build a compact table, those on text take a page of memory in each executor for every join.
    """
    return F.xxhash64(F.to_json(F.transform(members, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-")))))


def measured(rows: DataFrame, members: Column, size: Column, key: Column, seed: int = 17) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``, so that no name can clash), ``members``, ``mark``, ``size`` and ``hash``."""
    held = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    out = rows.select(held, F.sort_array(F.array_distinct(members)).alias("members"), size.alias("size"), seeded(key, seed).alias("hash"))
    return out.withColumn("mark", _marked(F.col("members")))


def taken(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs``, as ``measured`` made it, with ``copies``: the sources, by position, that take the row, once for each copy; and what else ``table`` has.

    ``table`` has a row for each pattern, at most ``MAX_PATTERNS``, with its intervals, so it is broadcast.
    """
    inside = F.filter("parts", lambda x: (x["low"] <= F.col("hash")) & (F.col("hash") < x["high"]) & (F.col("size") <= x["most"]))
    return docs.join(F.broadcast(table), "mark").withColumn("copies", F.transform(inside, lambda x: x["source"])).drop("mark", "parts")


def plan(base: DataFrame, weight: Callable[[int], float] = default_weight, copies: int = COPIES) -> tuple[DataFrame, DataFrame]:
    """``mark, parts, positions``, the intervals of each pattern's hashes that are taken and its sources, and the table ``source, position, source_size, target``.

    ``base`` is a staged table with ``members`` (an array of sources; a document counts toward the size of each), ``mark``, ``size`` and ``hash``; texts need not be in it.
    """
    spark = base.sparkSession
    groups = base.groupBy("members", "mark").agg(F.sum("size").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    marks = [g["mark"] for g in groups]
    if len(set(marks)) < len(marks):
        raise ValueError("two membership patterns have one key")
    names = sorted({s for g in groups for s in g["members"]}, key=lambda s: (s is None, s or ""))
    position = {s: i for i, s in enumerate(names)}
    sets = [sorted(position[s] for s in g["members"]) for g in groups]
    supply = [g["n"] for g in groups]
    sizes = [sum(n for n, m in zip(supply, sets, strict=True) if i in m) for i in range(len(names))]
    goal = targets(sizes, [weight(i) for i in range(len(names))], copies)
    total = sum(supply)
    scale = total / sum(goal) if sum(goal) > total > 0 else 1.0  # overlapping sources count a document more than once
    goal = [g * scale for g in goal]
    flows = min_cost_flow(supply, sets, [int(g) for g in goal], copies)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, r, s, words in flows:
        ends = edges.setdefault((p, r), [])
        ends.append((s, words + (ends[-1][1] if ends else 0)))
    hashed = base.select("mark", "hash", "size")
    everything, top = max(supply, default=0), 1 << BITS
    cut = _cuts(hashed, marks, {(p, x): (p, 0, everything, x, -1) for (p, _), ends in edges.items() for _, x in ends if 0 < x < supply[p]})
    parts: dict[int, list[tuple[int, int, int, int]]] = {p: [] for p in range(len(groups))}
    short = {}
    for (p, r), ends in edges.items():
        low = 0
        for s, x in ends:
            high, rest = cut.get((p, x), (top, 0))
            parts[p].append((s, low, high, everything))
            low = high
        if rest:
            short[p, r] = (s, high, rest)
    least = [g["least"] or 1 for g in groups]
    tries = {(p, False): {"pattern": p, "source": s, "level": r, "low": high + 1, "rest": rest, "most": everything, "skip": -1, "parts": parts[p]} for (p, r), (s, high, rest) in short.items()}
    # The edge document taken: only where the pattern's words all go to one source, so that no other interval moves.
    alone = {p: (r, *short[p, r]) for p, r in short if len({s for s, *_ in parts[p]}) == 1}
    if alone:
        at = F.broadcast(spark.createDataFrame([(marks[p], p, high) for p, (_, _, high, _) in alone.items()], "mark long, pattern int, edge long"))
        edge = hashed.join(at, "mark").filter((F.col("hash") == F.col("edge")) & (F.col("size") > 0)).groupBy("pattern").agg(F.sum("size").alias("n"), F.min("size").alias("least"))
        for e in edge.collect():  # a row for each pattern
            p = e["pattern"]
            r, s, high, _ = alone[p]
            others = supply[p] - e["n"]
            open_ = r * supply[p] + edges[p, r][-1][1] - (r + 1) * e["n"]
            level = min(copies, max(0, open_) // others) if others else copies  # whole copies of the others
            whole = [(s, high, high + 1, everything)] * (r + 1) + [(s, x, y, everything) for x, y in _around(0, top, high)] * (level if others else 0)
            tries[p, True] = {"pattern": p, "source": s, "level": level, "low": 0, "rest": open_ - level * others, "most": everything, "skip": high, "parts": whole}
    _filled(hashed, marks, tries, least, copies)
    for p in alone:
        if (p, True) in tries and abs(tries[p, True]["rest"]) < tries[p, False]["rest"]:
            parts[p] = tries[p, True]["parts"]
    wanted = {p: (s, r * supply[p] + edges[p, r][-1][1]) for p, (r, s, *_) in alone.items()}
    open_now = {p: min(abs(tries[p, k]["rest"]) for k in (False, True) if (p, k) in tries) for p in wanted}
    wanted = {p: w for p, w in wanted.items() if open_now[p] > NEAR * w[1]}
    if wanted:
        parts |= _searched(hashed, marks, wanted, copies)
    table = spark.createDataFrame([(marks[p], x, sets[p]) for p, x in parts.items()], "mark long, parts array<struct<source:int,low:long,high:long,most:long>>, positions array<int>")
    sources = spark.createDataFrame([(s, i, sizes[i], goal[i]) for i, s in enumerate(names)], "source string, position int, source_size long, target double")
    return table, sources


def mix(docs: DataFrame, weight: Callable[[int], float] = default_weight, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source``: each document belongs to its one source."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    base = stage(measured(rows, F.array("source"), F.col("size"), F.col("doc_id"), seed), "sized")
    table, sources = plan(base, weight, copies)
    # Each pattern is one source; both tables have a row for each of at most MAX_PATTERNS.
    own = table.join(F.broadcast(sources.drop("source")), F.col("positions")[0] == F.col("position")).drop("positions", "position")
    return taken(base, own).select("row.doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).alias("taken"), "row.source")


def mixed(docs: DataFrame, weight: Callable[[int], float] = default_weight, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with its columns, each as often as the mix takes it.

    Only sizes and hashes are staged; texts are read again for the result, and never shuffled.
    """
    rows = measured(docs, F.array("source"), word_count(F.col("text")), F.col("doc_id"), seed)
    table, _ = plan(stage(rows.select("members", "mark", "size", "hash"), "sized"), weight, copies)
    return taken(rows, table).select("row", F.explode("copies")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
