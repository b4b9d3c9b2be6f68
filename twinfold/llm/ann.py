"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector o is rotated by a seeded random orthogonal matrix and coded by the signs of its components, one bit each, plus one correction scalar
<code, o>, where code = sign / sqrt(D). For a rotated unit query q the inner product is estimated as <code, q> / <code, o>; its error is at
most ``eps`` * sqrt((1 - <code, o>^2) / (<code, o>^2 (D - 1))) except with a probability that falls as exp(-c eps^2). <code, q> comes from the packed
bits: eight dimensions a byte, one look-up each in the query's table of 256 partial sums. A vector is reranked with its exact cosine when its upper bound reaches the k-th
largest lower bound of the block, so ties stay in.

All rows are coded (nothing is fitted on a sample). Rows are dealt to blocks by a hash; the query set is sent to every block in the vectors' own type,
each block returns its k best of each query, and a window ranks those. This is the stated query set against all rows in blocks; a block holds up to
``BYTES`` of vectors, so that queries are sent as few times as a worker's memory allows.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, neither as queries nor
as candidates, while magnitudes of any size do; ties go to the smaller id; rows with one id and different vectors are different candidates, and so are repeated rows; a query row that is
repeated is asked once, and query rows with one id and different vectors are asked and ranked apart; with fewer candidates than
k all are returned; an empty table gives no rows; columns besides the two named are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 4.0
#: Least rows of a block where there are few, bytes of the vectors of a full one, and rows or queries that are worked on at once.
BLOCK, BYTES, QUERIES = 4096, 32_000_000, 64
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32) * 2 - 1).T  # (8, 256)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, uniformly distributed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed one-bit codes of a block of vectors with their correction scalars."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.dim = dim = vectors.shape[1]
        packed, own = [], []
        for k in range(0, len(vectors), BLOCK):
            some = vectors[k : k + BLOCK].astype(np.float64)
            turned = (some / np.linalg.norm(some, axis=1, keepdims=True)) @ turn
            wide = np.zeros((len(some), -(-dim // 8) * 8), np.uint8)
            wide[:, :dim] = turned > 0
            packed.append(np.packbits(wide, axis=1, bitorder="little"))
            own.append(np.abs(turned).sum(axis=1) / np.sqrt(dim))
        self.packed = np.ascontiguousarray(np.concatenate(packed).T)  # a row for each byte
        self.own = np.concatenate(own)  # <code, o>
        self.spread = np.sqrt(np.maximum(0, 1 - self.own**2) / (self.own**2 * max(1, dim - 1)))

    def estimate(self, query: np.ndarray) -> np.ndarray:
        """Estimated cosines of a rotated unit query with all vectors, from the packed bits."""
        q = np.zeros(len(self.packed) * 8, np.float32)
        q[: self.dim] = query
        tables = q.reshape(-1, 8) @ _SIGNS  # partial sums of each byte's 256 values
        dot = tables[0][self.packed[0]]
        for t, bits in zip(tables[1:], self.packed[1:], strict=True):
            dot += t[bits]
        return dot / (np.sqrt(self.dim) * self.own)


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: Codes, norms: np.ndarray, qid: int, query: np.ndarray, turn: np.ndarray, k: int, eps: float) -> list[tuple[int, float]]:
    """The block's k nearest to a query, exact order, ties to smaller ids."""
    length = np.sqrt((query * query).sum())
    est = codes.estimate(((query / length) @ turn).astype(np.float32))
    err = eps * codes.spread + 1e-5
    other = ids != qid
    low = np.where(other, est - err, -np.inf)
    least = np.partition(low, -k)[-k] if len(low) > k else -np.inf
    pick = np.flatnonzero(other & (est + err >= least))
    if not len(pick):
        return []
    exact = (vectors[pick].astype(np.float64) * query).sum(axis=1) / (norms[pick] * length)
    best = np.lexsort((ids[pick], -exact))[:k]
    return list(zip(ids[pick][best].tolist(), exact[best].tolist(), strict=True))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by powers of two, which change no cosine, so that their largest components lie near 1 and no square overflows or vanishes."""
    if vectors.dtype != np.float64 or not len(vectors):
        return vectors  # squares of 32-bit floats are 64-bit ones
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def usable(vec: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, eps: float = EPS, block: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest by cosine to each row that meets ``queries``, the row's own id left out.

    ``block``: rows of a block, by default as many as ``BYTES`` hold, or fewer to keep all cores busy.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    # A column name that the caller's condition uses stays as it is until here.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    size = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if size is None or not size["dim"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = size["dim"], size["count"]
    cores = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block)) if block else max(1, min(cores, -(-n // BLOCK)), -(-n * dim * (4 if kind == "array<float>" else 8) // BYTES))
    rows = rows.filter(usable(F.col("vec"), dim))
    data = rows.select(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", F.lit(0).alias("variant"), "vec")
    # The variant tells apart what one id asks; as many rows as the id has different vectors.
    different = rows.filter("asks").select("id", "vec").distinct().withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("vec")))
    asked = different.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "variant", "vec")
    dealt = data.unionByName(asked).repartition(F.col("block")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        now, held, ready = None, [], None
        for batch in batches:
            at = batch.column("block").to_numpy()
            kinds, ids, variants = (batch.column(c).to_numpy() for c in ("kind", "id", "variant"))
            vecs = scaled(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at[a] != now:
                    now, held, ready = at[a], [], None
                if kinds[a] == 0:
                    held.append((ids[a:b], vecs[a:b]))
                    continue
                if not held:
                    continue
                if ready is None:
                    all_ids, all_vecs = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    ready = all_ids, all_vecs, Codes(all_vecs, turn), np.sqrt(np.einsum("ij,ij->i", all_vecs, all_vecs, dtype=np.float64))
                    held = [()]
                for c in range(a, b, QUERIES):
                    d = min(b, c + QUERIES)
                    out = [(q, n, *x) for q, n, v in zip(ids[c:d].tolist(), variants[c:d].tolist(), vecs[c:d].astype(np.float64), strict=True) for x in search_block(*ready, q, v, turn, k, eps)]
                    if out:
                        q, n, i, s = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "variant", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, variant int, vec_id long, score double")
    order = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
