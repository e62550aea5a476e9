"""Exact top-k search by inner product, with pivot-table elimination.

Candidates are dealt to blocks. A block has one table of its candidates'
distances to many pivots, built once; all queries stream by it. For a query the
largest difference between its own distance to a pivot and a candidate's is a
lower bound on their distance, and with the norms that gives an upper bound on
the inner product. Tiles of queries that lie near the same pivot evaluate the
candidates in the order of their bounds, in growing steps, until the k-th best
score of each is above every bound that is left; equal bounds are evaluated
too, so ties are decided exactly. A bound that rounding or overflow spoils
counts as infinite: its candidates are evaluated.

A task holds one block and one batch of queries. Each block gives its best k of
each query, and a window keeps the best k of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
PIVOTS = 32
#: Components of a block's candidates, about (8 MB as doubles).
BLOCK_VALUES = 1 << 20
#: Least candidates of a block where there are more cores than blocks.
LEAST_BLOCK = 2048
#: Candidates in the first step of an evaluation, and in the longest.
_FIRST, _STEP = 128, 2048
#: Queries that are evaluated together, and those whose bounds are computed in one go.
_TILE, _BOUNDED = 64, 8
#: Roundings of a distance, as a part of the two norms: single precision and the cancelled square below the root.
_ROUNDED = 4e-7
#: Queries this many times longer than the block's longest vector are evaluated against all of it.
_FAR = 2.0**50
_EXACT = 2**53


def _floored(vectors: np.ndarray) -> np.ndarray:
    """Scaled and floored; what leaves the range of a double stays at its ends."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * vectors.astype(np.float64)))


def _whole(x: np.ndarray) -> np.ndarray:
    """Scores beyond the long range stay at its ends."""
    return np.clip(x, -(2**63), 2**63 - 1).astype(np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    limit = np.sqrt(_EXACT / max(1, a.shape[1])) - 1
    small_a, small_b = (np.abs(x).max(1, initial=0) < limit for x in (a, b))
    if small_a.all() and small_b.all():
        return (a @ b.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    out = np.empty((len(a), len(b)), np.int64)
    for rows, cols in ((small_a, small_b), (small_a, ~small_b), (~small_a, np.ones(len(b), bool))):
        if rows.any() and cols.any():
            x, y = a[rows], b[cols]
            out[np.ix_(rows, cols)] = (x @ y.T).astype(np.int64) if cols is small_b else _whole(to_int(x).dot(to_int(y).T))
    return out


class PivotTable:
    """Candidates (whole numbers as doubles) with their distances to pivots.

    Norms and distances are those of vectors divided by a power of two near the
    longest component, so that no square overflows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int = PIVOTS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.exponent = int(np.frexp(np.abs(vectors).max(initial=0))[1])
        self.scaled = self._scaled(self.vectors)
        self.norms = (self.scaled**2).sum(1)
        picked = [int(np.argmax(self.norms))] if len(ids) else []
        far = np.full(len(ids), np.inf)
        while len(picked) < min(pivots, len(ids)):  # each next pivot lies farthest from those before
            far = np.minimum(far, self._far(self.scaled[picked[-1] :][:1])[0])
            if not far.max() > 0:
                break
            picked.append(int(np.argmax(far)))
        self.pivots = self.scaled[picked]
        self.table = self._far(self.pivots).astype(np.float32) if picked else np.zeros((0, len(ids)), np.float32)
        self.rounded = (2 * _ROUNDED * np.sqrt(self.norms[picked])).astype(np.float32)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -self.exponent)

    def _far(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + self.norms - 2 * x @ self.scaled.T))

    def _to_pivots(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * q @ self.pivots.T))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds on the scores, one row per query; infinite where none is known."""
        with np.errstate(over="ignore", invalid="ignore"):
            q = self._scaled(queries)
            norms = (q**2).sum(1)
            near = norms < _FAR**2 * len(q.T)
            q, norms = np.where(near[:, None], q, 0), np.where(near, norms, 0)
            far = self._to_pivots(q).astype(np.float32)
            least = np.zeros((len(q), len(self.ids)), np.float32)
            for a in range(0, len(q), _BOUNDED):  # tiles stay in the processor's cache
                tile = least[a : a + _BOUNDED]
                for p in range(len(self.pivots)):
                    diff = self.table[p] - far[a : a + _BOUNDED, p : p + 1]
                    np.abs(diff, out=diff)
                    diff -= self.rounded[p]
                    np.maximum(tile, diff, out=tile)
            scale = norms[:, None] + self.norms
            # The two norms together are at most 1.5 times this root; the constant is for distances too small for single precision.
            slack = 2 * _ROUNDED * np.sqrt(scale) + 2.0**-140
            # The last term covers squares too small for a double.
            scaled = (scale - np.maximum(0, least - slack) ** 2) / 2 + 1e-9 * scale + np.ldexp(float(q.shape[1]), -1000)
            out = np.ldexp(scaled, 2 * self.exponent) + 1e-6
        out[~near] = np.inf
        out[np.isnan(out)] = np.inf
        return np.maximum(out, -(2.0**63), out=out)  # as scores are cut there

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int = K):
        """(query, candidate, score) of the best k for each query, without itself."""
        if not len(self.ids):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            order = np.argsort(np.nan_to_num(self._to_pivots(self._scaled(queries)), nan=np.inf).argmin(1), kind="stable")
        for a in range(0, len(ids), _TILE):
            at = order[a : a + _TILE]
            for i, (found, scores) in zip(at.tolist(), self._evaluated(ids[at], queries[at], k), strict=True):
                yield from ((int(ids[i]), *x) for x in zip(found.tolist(), scores.tolist(), strict=True))

    def _evaluated(self, own: np.ndarray, q: np.ndarray, k: int) -> list:
        """The best k (ids, scores) of each query of a tile."""
        bounds = self.bounds(q)
        bounds[own[:, None] == self.ids] = -np.inf  # never the query itself
        by = np.argsort(-bounds.max(0), kind="stable")
        bounds = bounds[:, by]
        left = np.maximum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]  # the largest bound from here on
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        floors, open_, a, step = np.full(len(q), -np.inf), np.arange(len(q)), 0, _FIRST
        while a < len(by) and len(open_):
            at, now = by[a : a + step], slice(a, a + step)
            scores = dots(q[open_], self.vectors[at])
            hits = (bounds[open_, now] > -np.inf) & (bounds[open_, now] >= floors[open_, None]) & (scores >= floors[open_, None])
            for row, i in enumerate(open_.tolist()):
                some = np.flatnonzero(hits[row])
                if len(some):
                    best[i] = self._top(np.concatenate([best[i][0], self.ids[at[some]]]), np.concatenate([best[i][1], scores[row][some]]), k)
                    if len(best[i][1]) == k:
                        floors[i] = best[i][1][-1]
            a += step
            step = min(2 * step, _STEP)
            if a < len(by):
                open_ = open_[(left[open_, a] >= floors[open_]) & (left[open_, a] > -np.inf)]
        return best

    @staticmethod
    def _top(ids: np.ndarray, scores: np.ndarray, k: int):
        if len(ids) > 4 * k:  # all that reach the k-th best, ties included
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, ~scores))[:k]  # falling scores, without the overflow of a minus
        return ids[best], scores[best]


def _matrix(batch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("v")
    return batch.column("id").to_numpy(), _floored(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))


def _searching(k: int, pivots: int):
    """Rows sorted by block, its candidates before the queries, to the block's best of each query."""

    def run(batches):
        now, parts, table = None, [], None
        for batch in batches:
            dim, cb, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cb", "asks"))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (cb[1:] != cb[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now != (dim[a], cb[a]):
                    now, parts, table = (dim[a], cb[a]), [], None
                if not asks[a]:
                    parts.append(_matrix(batch.slice(a, b - a)))
                    continue
                if table is None:
                    if not parts:
                        continue
                    table, parts = PivotTable(*(np.concatenate(x) for x in zip(*parts, strict=True)), pivots), []
                cols = list(zip(*table.search(*_matrix(batch.slice(a, b - a)), k), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, pivots: int = PIVOTS, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id.

    Components are scaled and floored. Rows whose id or vector is null or
    empty, or whose vector holds a null or non-finite component, take no part;
    finite components of any size do. Queries meet candidates of their own
    number of components. A candidate with the query's id is the query itself;
    of candidates that share another id each counts. Queries that repeat give
    one list. Scores beyond the long range are cut to it. Further columns are
    ignored, empty tables give empty ones.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        fine = F.col(id).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(fine).select(F.col(id).cast("long").alias("id"), F.size(v).alias("dim"), v.cast("array<double>").alias("v"))

    spark = vectors.sparkSession
    some, asked = usable(vectors), usable(queries).dropDuplicates(["id"])
    n, values = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    blocks = max(1, -(-values // block_values), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    # A repeated id is spread by its vector too.
    c = some.select("id", "dim", "v", F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(blocks)).alias("cb"), F.lit(False).alias("asks"))
    q = asked.select("id", "dim", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cb"), F.lit(True).alias("asks"))
    keys = ("dim", "cb")
    best = c.unionByName(q).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_searching(k, pivots), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB's form of ``op4``.
SQL = f"""
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""
