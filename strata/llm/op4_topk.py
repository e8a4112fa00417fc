"""Exact top-k inner-product search over a pivot-distance index.

Vectors get one more component that makes all their norms equal, so the
largest inner products are the nearest vectors.  Each vector is keyed by its
nearest pivot and its distance from it; a pivot's vectors, in order of distance,
form annuli.  A query goes to the parts of the index that the triangle
inequality does not rule out against a first bound from a sample, reads a
part's annuli from the most promising on, and stops at the first that can hold
nothing better than what it has; the parts' best lists are merged (Yianilos
1993; Jagadish et al. 2005, iDistance).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_frame, materialize, table

K = 20
SCALE = 64
PIVOTS = 64
#: Vectors that give pivots and first bounds, those with the smallest hash of vec_id.
SAMPLE = 8192
#: Vectors of one pivot that a task holds; a pivot with more is cut into parts by a hash.
PART_ROWS = 100_000
#: Vectors of an annulus, and queries that read it at once.
BLOCK = 256
QUERY_BLOCK = 256
#: The squared norm of a scaled vector stays below this, so that every score fits a long.
MOST_NORM = float(1 << 62)
NONE = -(1 << 63)


def quantized(v: Column) -> Column:
    """floor(64 * x) of every component, null where the vector takes no part."""
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    wide = F.aggregate(F.transform(v, lambda x: F.lit(float(SCALE)) * x.cast("double")), F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1))
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float(1 << 40))))
    return F.when(ok, F.when(wide < MOST_NORM, scaled))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(lists.offsets.to_numpy())
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    at = np.concatenate([[0], np.cumsum(lens)])
    for i, n in enumerate(lens.tolist()):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


class Index:
    """What every task needs: pivots, the common norm and first candidates.  Bounded by SAMPLE rows."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, norm: float, largest: float, dim: int):
        self.dim, self.norm = dim, norm
        #: The type in which products of whole numbers stay exact.
        bound = dim * largest * largest
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.store = np.int16 if largest < 1 << 15 else np.int64
        self.sample, self.ids = sample.astype(self.kind), ids
        real = sample.astype(np.float64)
        chosen, far = [0], None
        lift = np.sqrt(np.maximum(norm - (real**2).sum(1), 0))
        full = np.hstack([real, lift[:, None]])
        while len(chosen) < min(PIVOTS, len(sample)):
            d = ((full - full[chosen[-1]]) ** 2).sum(1)
            far = d if far is None else np.minimum(far, d)
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots, self.lift = real[chosen], lift[chosen]

    def distances(self, m: np.ndarray, query: bool) -> np.ndarray:
        """Distances from the pivots in the lifted space, in which queries have no lift."""
        m = m.astype(np.float64)
        sq = (m * m).sum(1)
        lift = np.zeros(len(m)) if query else np.sqrt(np.maximum(self.norm - sq, 0))
        full = self.norm if not query else sq[:, None]
        d = full + self.norm - 2 * (m @ self.pivots.T) - 2 * lift[:, None] * self.lift
        return np.sqrt(np.maximum(d, 0))

    def ceiling(self, m: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest inner product that a vector between low and high from a pivot can have with each query."""
        m = m.astype(np.float64)
        gap = np.maximum(np.maximum(d - high, low - d), 0)
        return ((m * m).sum(1)[:, None] + self.norm - gap * gap) / 2 * (1 + 1e-9) + 1e-3 + 1e-9 * self.norm

    def scores(self, m: np.ndarray, others: np.ndarray) -> np.ndarray:
        return (m.astype(self.kind) @ others.astype(self.kind).T).astype(np.int64)

    def floor(self, m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score among the sample, a bound from below for the k-th best of all."""
        if len(self.ids) <= k:
            return np.full(len(m), NONE)
        out = np.zeros(len(m), np.int64)
        for lo in range(0, len(m), QUERY_BLOCK):
            s = self.scores(m[lo : lo + QUERY_BLOCK], self.sample)
            s[ids[lo : lo + QUERY_BLOCK, None] == self.ids] = NONE
            out[lo : lo + QUERY_BLOCK] = np.partition(s, -k, axis=1)[:, -k]
        return out

    def unpack(self, raws: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(raws.to_pylist()), self.store).reshape(len(raws), self.dim)


def _keyer(index: Index):
    def run(batches):
        for b in batches:
            m = _matrix(b.column("q"), index.dim)
            d = index.distances(m, query=False)
            p = d.argmin(1) if len(m) else np.zeros(0, np.int64)
            raw = np.ascontiguousarray(m.astype(index.store))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(m)), p]), pa.array([r.tobytes() for r in raw], pa.binary()), b.column("is_query")], ["vec_id", "pivot", "dist", "raw", "is_query"])

    return run


WORK = "part int, query boolean, dist double, vec_id long, bound long, raw binary"


def _router(index: Index, parts: np.ndarray, k: int):
    """Queries with their first bound, to every part that it does not rule out."""
    pivot, low, high = parts[:, 0].astype(int), parts[:, 1], parts[:, 2]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                b = batch.slice(at, QUERY_BLOCK)
                ids, m = b.column("vec_id").to_numpy(), index.unpack(b.column("raw"))
                d, bound = index.distances(m, query=True)[:, pivot], index.floor(m, ids, k)
                q, p = np.nonzero(index.ceiling(m, d, low, high) >= bound[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(np.ones(len(p), bool)), pa.array(d[q, p]), pa.array(ids[q]), pa.array(bound[q]), b.column("raw").take(pa.array(q))], ["part", "query", "dist", "vec_id", "bound", "raw"])

    return run


def _best(index: Index, ids, m, dist, q_ids, q, q_dist, bound, k: int):
    """The k best of a part's vectors, in order of distance, for a block of queries: (query, score, vec_id)."""
    starts = np.arange(0, len(ids), BLOCK)
    ends = np.minimum(starts + BLOCK, len(ids)) - 1
    top = index.ceiling(q, q_dist[:, None], dist[starts], dist[ends])
    heaps: list[list[tuple[int, int]]] = [[] for _ in q_ids]  # (score, -vec_id)
    bar = bound.copy()
    for b in np.argsort(-top.max(0), kind="stable").tolist():
        rows = np.flatnonzero(top[:, b] >= bar)
        if not len(rows):
            if top[:, b].max() < bar.min():
                break
            continue
        here = slice(starts[b], ends[b] + 1)
        s = index.scores(q[rows], m[here])
        for r, c in np.argwhere((s >= bar[rows][:, None]) & (q_ids[rows][:, None] != ids[here])).tolist():
            heap, item = heaps[rows[r]], (int(s[r, c]), -int(ids[here][c]))
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        for r in rows.tolist():
            if len(heaps[r]) == k:
                bar[r] = max(bar[r], heaps[r][0][0])
    for i, heap in enumerate(heaps):
        for score, vec in heap:
            yield i, score, -vec


PARTIAL = "query_id long, query_hash long, vec_id long, score long"


def _searcher(index: Index, k: int):
    """Best lists of a part's queries; its vectors come before them, in order of distance."""

    def run(batches):
        now, held, ready = None, [], None
        for batch in batches:
            part = batch.column("part").to_numpy()
            for lo, hi in zip(*_runs(part, batch.column("query").to_numpy(zero_copy_only=False)), strict=True):
                if part[lo] != now:
                    now, held, ready = part[lo], [], None
                b = batch.slice(lo, hi - lo)
                if not b.column("query")[0].as_py():
                    held.append((b.column("vec_id").to_numpy(), index.unpack(b.column("raw")), b.column("dist").to_numpy()))
                    continue
                if ready is None:
                    if not held:
                        continue
                    ready, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
                for at in range(0, b.num_rows, QUERY_BLOCK):
                    c = b.slice(at, QUERY_BLOCK)
                    q_ids, q = c.column("vec_id").to_numpy(), index.unpack(c.column("raw"))
                    out = list(_best(index, *ready, q_ids, q, c.column("dist").to_numpy(), c.column("bound").to_numpy(), k))
                    i = np.array([o[0] for o in out], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(_hashes(q)[i]), pa.array([o[2] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["query_id", "query_hash", "vec_id", "score"])

    return run


def _runs(part: np.ndarray, query: np.ndarray) -> tuple[list[int], list[int]]:
    """Bounds of the runs of equal part and kind."""
    turn = np.flatnonzero((part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1
    edges = [0, *turn.tolist(), len(part)] if len(part) else [0]
    return edges[:-1], edges[1:]


def _hashes(m: np.ndarray) -> np.ndarray:
    """A hash of each row, by which queries that share an id are told apart."""
    x = m.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        y = (x + np.uint64(0x51ED27)) * place
        return np.add.reduce((y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), axis=1).view(np.int64)


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    vectors: vec_id, embedding.  Candidates are all rows whose vec_id differs
    from the query's; repeated rows count each.  Ties go to the smaller vec_id.
    Queries are the distinct pairs of vec_id and vector among the rows asked
    for; two vectors under one id have a list each.  Null vectors, vectors with
    null or non-finite components, vectors whose scaled squared norm reaches
    2**62 (their scores would not fit a long) and rows with a null vec_id take
    no part; vectors of unequal length compare as if filled up with zeros.
    Extra columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("q"), F.coalesce(queries, F.lit(False)).alias("is_query")).filter("vec_id is not null and q is not null")
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.coalesce(F.array_max(F.transform("q", F.abs)), F.lit(0))
    facts = rows.agg(F.count("*"), F.max(norm), F.max(largest), F.max(F.size("q"))).first()
    if not facts[0] or not facts[3]:
        return local_frame(spark, [], RESULT)
    dim = int(facts[3])
    sample = rows.select("vec_id", "q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    first = _matrix(pa.array([r["q"] for r in sample], pa.list_(pa.int64())), dim)
    index = Index(first, np.array([r["vec_id"] for r in sample]), float(facts[1]), float(facts[2]), dim)
    keyed = materialize(rows.mapInArrow(_keyer(index), "vec_id long, pivot int, dist double, raw binary, is_query boolean"))
    sizes = keyed.groupBy("pivot").agg(F.count("*").alias("n")).collect()  # PIVOTS rows at most
    cut = F.broadcast(local_frame(spark, [(r["pivot"], -(-r["n"] // PART_ROWS)) for r in sizes], "pivot int, parts int"))
    dealt = keyed.join(cut, "pivot").withColumn("share", F.pmod(F.xxhash64("vec_id", "raw", F.lit(3)), F.col("parts")).cast("int"))
    cells = sorted(dealt.groupBy("pivot", "share").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).collect())  # a row for PART_ROWS vectors
    number = F.broadcast(local_frame(spark, [(k_, c["pivot"], c["share"]) for k_, c in enumerate(cells)], "part int, pivot int, share int"))
    held = dealt.join(number, ["pivot", "share"]).select("part", F.lit(False).alias("query"), "dist", "vec_id", F.lit(NONE).alias("bound"), "raw")
    grid = np.array([(c["pivot"], c["low"], c["high"]) for c in cells], float).reshape(-1, 3)
    asked = keyed.filter("is_query").select("vec_id", "raw").distinct()
    routed = asked.mapInArrow(_router(index, grid, k), WORK)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cells) // 4)
    work = held.unionByName(routed).repartition(tasks, "part").sortWithinPartitions("part", "query", "dist", "vec_id")
    found = work.mapInArrow(_searcher(index, k), PARTIAL)
    place = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
