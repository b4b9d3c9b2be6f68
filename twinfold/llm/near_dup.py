"""Near-duplicate groups by HyperMinHash.

A document's set holds its distinct shingles (of ``WORDS`` words unless told otherwise) as 64-bit hashes. Each of ``REGISTERS`` buckets has its own hash function and keeps, of its
least value, the count of leading zeros and ten mantissa bits: 16 bits a register. Four registers make a band. Documents that share
a band are candidates; the share of equal registers, corrected for chance collisions of compressed registers, estimates their Jaccard similarity; links are then
confirmed on the full sets: 100 * intersection >= 80 * union.

Equal sets are one node, so exact copies are never compared. A band's nodes are first compared with its leader only, the node that meets most others
in its bands; each node tries the ``LEADERS`` leaders that it shares most bands with. This joins a group of near copies in about as many comparisons as it has
members. What is then left are bands whose nodes lie in several components. Their nodes are dealt to chunks by a hash, those outside
the band's largest component go to each chunk, and the estimate tells at which spots (nodes of one leader, dealt to parts by a hash) a node may have links. The
node's full set goes to those spots and is compared with the sets there, in as many copies of a spot as its askers need; only links leave a spot. So no band, however large, is held by one task, pairs are compared but
never formed as rows, and no candidate is dropped by a cap.

With similarity s a band is shared with probability s^4; 24 bands miss a pair at 0.8 once in 300,000 times. The estimate's cut lies 6.9 standard
deviations under 0.8 and adds a loss of 1.4e-10, so of the pairs at 0.8 that bands make candidates the exact check decides practically all.

Edge cases: documents with fewer words than a shingle have their whole sequence as one shingle; null, empty and blank texts have an empty set and
are linked with nothing; repeated rows are one node; a null doc_id can be linked but is never a component's id unless alone; ties take the smaller id; an
empty table gives no rows; texts of any length are shingled whole; columns besides those named are ignored, or kept where stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, slices, stage, texts, trimmed
from .graph import components

#: Words of a shingle in op9, and in the pipeline's stage; most words that a shingle can have.
WORDS, STAGE_WORDS, MOST_WORDS = 4, 5, 16
#: Registers of a sketch, bands (from the first registers) and registers of a band.
REGISTERS, BANDS, BAND = 192, 24, 4
SIMILAR = 80
#: Estimates under this are taken for unlike; it only spares the exact check far pairs.
CUT = 0.6
#: Leaders that a node is compared with before any other pairs.
LEADERS = 3
CHUNK = 256
#: Bytes of the texts that are worked on at once, one text at least.
GROUP = 2_000_000
#: Most rows of ids that are broadcast to pick texts; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = _rng.integers(0, 1 << 62, MOST_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes; bytes.split cuts at space and U+0009 to U+000D, and lower changes A-Z only."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not words:
        return w
    if len(w) < size:
        s = (w * _ODD[: len(w)]).sum(keepdims=True) + _ODD[MOST_WORDS] * np.uint64(len(w))
    else:
        n = len(w) - size + 1
        s = w[:n] * _ODD[0]
        for k in range(1, size):
            s = s + w[k : k + n] * _ODD[k]
    return np.unique(_mixed(s))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set that is not empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        y = (x[k : k + 1024, None] ^ _XOR) * _MUL
        np.minimum(least, y.min(axis=0), out=least)
    bits = np.frexp(least.astype(np.float64))[1]  # bit length
    mantissa = ((least.astype(np.uint64) << (42 - bits).astype(np.uint64)) >> np.uint64(31)) & np.uint64(1023)
    return ((32 - bits).astype(np.uint64) << np.uint64(10) | mantissa).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """One key for each band."""
    words = regs[: BANDS * BAND].view(np.uint64)  # four registers of 16 bits
    return _mixed(words + np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


_chance: dict[tuple[int, int], float] = {}


def chance(n: int, m: int) -> float:
    """Probability that two unrelated sets of about n and m shingles have equal compressed registers."""
    key = (int(4 * np.log2(n)), int(4 * np.log2(m)))
    if key not in _chance:
        top = 2.0 ** -np.arange(32)[:, None]
        low = top / 2 * (1 + np.arange(1024) / 1024)
        high = low + top / 2048
        cell = lambda c: np.exp(c * np.log1p(-low)) - np.exp(c * np.log1p(-np.minimum(high, 1 - 1e-12)))
        _chance[key] = float((cell(2 ** (key[0] / 4)) * cell(2 ** (key[1] / 4))).sum())
    return _chance[key]


def estimate(equal: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from counts of equal registers."""
    e = np.array([chance(n, int(x)) for x in m])
    return (equal / REGISTERS - e) / (1 - e)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n, node, regs, bands``: set size, 64-bit identity of the set (null if empty), registers and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        claim("near_dup")
        for batch in slices(batches, "text", GROUP):
            n, node, regs, keys = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, words)
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    node.append(xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    regs.append(r.tobytes())
                    keys.append(bands(r))
                else:
                    for x in (node, regs, keys):
                        x.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "node", "regs", "bands"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n long, node long, regs binary, bands array<long>")


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, items`` of the nodes wanted, made again from their texts only."""
    wanted = stage(wanted.distinct().join(nodes.select("node", F.col("first_doc").alias("doc_id")), "node"), "wanted")
    ids = wanted.select(F.col("doc_id").alias("other")).distinct()
    pick = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    rows = texts(docs).withColumn("key", F.col("doc_id")).join(pick, F.col("key").eqNullSafe(F.col("other"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        claim("near_dup")
        for batch in slices(batches, "text", GROUP):
            made = [x for t in batch.column("text").to_pylist() if len(x := shingles(t, words))]
            node = [xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in made]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))], ["node", "items"])

    # A doc_id may stand for other texts too: only wanted nodes stay.
    return stage(rows.mapInArrow(trimmed(run), "node long, items array<long>").join(wanted.select("node"), "node", "left_semi"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    sets = _sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), docs, nodes, words)
    x = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = x.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= SIMILAR * (F.size("x") + F.size("y") - common)).select("a", "b")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose registers do not rule them out."""
    side = lambda c, n, r: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("regs").alias(r))
    rows = pairs.join(side("a", "na", "ra"), "a").join(side("b", "nb", "rb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                equal = (x == y).sum(axis=1)
                est = np.array([estimate(e, int(n), [m])[0] for e, n, m in zip(equal, batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)])
                yield batch.select(["a", "b"]).filter(pa.array(est >= CUT))

    return rows.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(trimmed(run), "a long, b long")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose nodes are not yet in one component."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")


def _across(keyed: DataFrame, comp: DataFrame, nodes: DataFrame, spots: DataFrame) -> DataFrame:
    """``node, spot``: nodes that share a band with a node of another component at that spot and are not ruled out."""
    placed = keyed.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    several = per.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("big"), F.sum("c").alias("all"), F.count("*").alias("k")).filter("k > 1")
    rows = placed.join(several.select("key", "big", "all"), "key")
    rows = stage(rows.join(nodes.select("node", "n", "regs"), "node").join(spots, "node").withColumn("chunks", F.ceil(F.col("all") / CHUNK).cast("int")), "several")
    held = rows.select("key", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("kind"), "node", "component", "n", "regs", "spot")
    asks = rows.filter("component <> big").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "node", "component", "n", "regs", "spot")
    dealt = held.unionByName(asks).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            out = set()
            for key, chunk, kind, node, component, n, regs, spot in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "kind", "node", "component", "n", "regs", "spot")), strict=True):
                if (key, chunk) != now:
                    now, held, ready = (key, chunk), [], None
                if kind == 0:
                    held.append((component, n, spot, regs))
                    continue
                if ready is None:
                    ready = (*(np.array([x[i] for x in held], np.int64) for i in range(3)), np.frombuffer(b"".join(x[3] for x in held), np.uint16).reshape(-1, REGISTERS))
                comps, sizes, where, table = ready
                at = np.flatnonzero(_like(comps, sizes, component, n))
                if len(at):
                    est = estimate((table[at] == np.frombuffer(regs, np.uint16)).sum(axis=1), n, sizes[at])
                    out.update((node, x) for x in np.unique(where[at[est >= CUT]]).tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "spot"])

    return dealt.mapInArrow(trimmed(run), "node long, spot long").distinct()


def _like(comps: np.ndarray, sizes: np.ndarray, component: int, n: int) -> np.ndarray:
    """Of other components, and of a size that a linked set can have."""
    return (comps != component) & (100 * np.minimum(sizes, n) >= SIMILAR * np.maximum(sizes, n))


def _confirmed_at(asked: DataFrame, comp: DataFrame, spots: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Links ``a, b`` of the nodes asked with nodes of other components at the spot, confirmed on full sets; one for each component suffices.

    A spot holds about ``CHUNK`` nodes, and only links leave it. Where more nodes ask, the spot's nodes are repeated for each ``CHUNK`` of them, so neither side of a task is unbounded.
    """
    times = stage(asked.groupBy("spot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("times")), "times")
    there = spots.join(asked.select("spot").distinct(), "spot", "left_semi")
    sets = _sets(there.select("node").unionByName(asked.select("node")), docs, nodes, words).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = there.join(times, "spot").select("node", "spot", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("part"))
    asks = asked.join(times, "spot").select("node", "spot", F.lit(1).alias("kind"), F.pmod(F.xxhash64("node"), "times").cast("int").alias("part"))
    both = held.unionByName(asks).join(sets, "node").withColumn("spot", F.xxhash64("spot", "part"))
    dealt = both.repartition("spot").sortWithinPartitions("spot", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            out = []
            for spot, kind, node, component, items in zip(*(batch.column(c) for c in ("spot", "kind", "node", "component", "items")), strict=True):
                spot, kind, node, component = spot.as_py(), kind.as_py(), node.as_py(), component.as_py()
                own = np.sort(items.values.to_numpy().view(np.uint64))
                if spot != now:
                    now, held, ready = spot, [], None
                if kind == 0:
                    held.append((node, component, own))
                    continue
                if ready is None:
                    ready = np.array([x[1] for x in held], np.int64), np.array([len(x[2]) for x in held], np.int64), np.array([registers(x[2]) for x in held])
                comps, sizes, table = ready
                at = np.flatnonzero(_like(comps, sizes, component, len(own)))
                done = set()
                if len(at):
                    est = estimate((table[at] == registers(own)).sum(axis=1), len(own), sizes[at])
                    for i in at[np.argsort(-est, kind="stable")][: int((est >= CUT).sum())].tolist():
                        other, c, theirs = held[i]
                        if c not in done:
                            common = len(np.intersect1d(own, theirs, assume_unique=True))
                            if 100 * common >= SIMILAR * (len(own) + len(theirs) - common):
                                done.add(c)
                                out.append((node, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.select("spot", "kind", "node", "component", "items").mapInArrow(trimmed(run), "a long, b long")


def linked(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches, the nodes (``node, n, regs, first_doc``) and ``node, component`` of the nodes with links."""
    base = stage(sketches(docs, words), "sketches")
    filled = base.filter("node IS NOT NULL")
    nodes = stage(filled.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    keyed = stage(rows.join(shared, "key").select("key", "node", "c"), "keyed")
    # A band's leader is its node that meets most others in all of its bands: the text that near copies were made from.
    met = keyed.groupBy("node").agg(F.sum("c").alias("met"))
    leaders = keyed.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    led = keyed.join(leaders, "key").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    keyed = keyed.drop("c")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "leader"))  # at most as many rows as bands
    led = stage(led.withColumn("r", rank).filter(F.col("r") <= LEADERS).select(F.col("node").alias("a"), F.col("leader").alias("b"), "r"), "led")
    # A node's spot: the nodes with its first leader, dealt to parts of about CHUNK by a hash.
    home = nodes.select("node").join(keyed.select("node").distinct(), "node", "left_semi").join(led.filter("r = 1").select(F.col("a").alias("node"), F.col("b").alias("home")), "node", "left").withColumn("home", F.coalesce("home", "node"))
    parts = home.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    spots = stage(home.join(parts, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts")).alias("spot")), "spots")
    edges, comp = None, nodes.select("node", F.col("node").alias("component")).limit(0)
    for turn in range(1, LEADERS + 2):
        if turn <= LEADERS:
            pairs = stage(_estimated(_apart(led.filter(F.col("r") == turn).select("a", "b"), comp), nodes), "pairs")
            found = None if pairs.isEmpty() else _confirmed(pairs, docs, nodes, words)
        else:  # every other pair across components, once
            asked = stage(_across(keyed, comp, nodes, spots), "asked")
            found = None if asked.isEmpty() else _confirmed_at(asked, comp, spots, docs, nodes, words)
        if found is not None:
            found = stage(found, "found")
            edges = found if edges is None else edges.unionByName(found)
            comp = stage(components(edges), "components")
    return base, nodes, comp


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    base, nodes, comp = linked(docs, words)
    first = comp.join(nodes.select("node", "first_doc"), "node")
    ids = first.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = nodes.select("node", "first_doc").join(comp.join(ids, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "first_doc").alias("component_id"))
    # One node stands for all exact copies of a text. Written, its side of the join below is a plain exchange, and Spark splits the partitions of the other side where a node is hot.
    named = stage(named, "named")
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    name = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.col("doc_id").eqNullSafe(name)).alias("kept"))


def keep_one(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """The rows of ``docs``, with its columns, whose doc_id names their group; repeated rows of that doc_id all stay.

    Texts are not shuffled as long as the identifiers that go are few enough to be broadcast, as they mostly are; beyond that the join moves them once.
    """
    flags = stage(near_duplicates(docs, words).groupBy("doc_id").agg(F.max("kept").alias("kept")), "kept")
    gone, kept = flags.filter(~F.col("kept")), flags.filter("kept")
    if gone.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(gone), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
