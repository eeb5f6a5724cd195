"""Exact top-k search by multi-resolution segment statistics.

Each vector is cut into 1, 4, 16 and 32 segments; a segment is kept as its mean and the norm of what deviates
from it.  By Cauchy-Schwarz on the deviations, two vectors' segment statistics bound their inner product
from above, which is their distance from below, as ``|q - x|**2 = |q|**2 + |x|**2 - 2 q.x``.  Bounds go
from coarse to fine: first of a query against a whole cell of candidates, then of pairs, at finer levels for
the pairs that are left.  What falls below the k-th best exact score found so far is out, and exact scores
are computed for the pairs that survive.

1. A bounded sample of rows (``sample``, the first by a hash of the row) gives pivots; every row belongs to the
   cell of the nearest pivot.  A cell keeps, segment by segment, the interval of its members' means and their
   largest deviation.
2. A query's k-th best score among the sample is its first threshold; it wants the cells whose statistics
   allow more.
3. Queries are dealt into blocks by groups of neighbouring cells, and cells of candidates into blocks of
   bounded size by a hash of the row.  A candidate is copied to the blocks of queries that want its cell,
   and each pair of blocks is one group of a cogrouped map; its best k a query go on to one ranking by query.

Edge cases: vectors that are null, or hold a null or a component that isn't finite, or whose id is null,
take no part; vectors of different lengths are never compared; ties go to the smaller id; rows that
repeat an id are candidates each, and each a query of its own, and a query's own row alone is left out; lengths
that the sample doesn't have are one cell each, which every query of that length wants; fewer than k candidates give them all; an empty table gives an empty result; further columns are not
read.  Scores beyond 64 bits are held at their limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.llm.common import cut, map_arrow

SEGMENTS = (1, 4, 16, 32)
#: The level of the cells' statistics.
CELL_SEGMENTS = 16
#: Cells at most, and candidates for each of them.
MOST_CELLS, PER_CELL = 256, 4096
#: Queries whose bounds are held at once.
AT_ONCE = 64
#: From this share of surviving pairs on, scores are one product of matrices in place of one sum a pair.
DENSE = 0.05
#: Candidates with the best bounds whose exact scores set the first threshold, as a multiple of k.
PROBES = 3
#: Bounds are computed in single precision; thresholds give way by this share of the largest bound, or, where
#: numbers are too large to be exact in a double, of the product of the two vectors' norms.
LOOSE = 1e-4
#: Whole numbers below this are exact in a double.
EXACT = float(2**53)


def matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component; rows are padded with zeros to whole segments."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    x = np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(flat), -1)
    width = SEGMENTS[-1] * max(1, -(-x.shape[1] // SEGMENTS[-1]))
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, weighted by the segment's length, and deviations; their product bounds the inner product."""
    parts = x.reshape(len(x), segments, -1)
    mean = parts.mean(axis=2)
    deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return np.concatenate([mean * math.sqrt(parts.shape[2]), deviation], axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Scores of pairs: in doubles where they are exact, else in whole numbers held at the limits of 64 bits."""

    def fast(qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", q[qi[s : s + 65_536]], x[xi[s : s + 65_536]]) for s in range(0, len(qi), 65_536)]
        return np.concatenate([*parts, np.zeros(0)]).astype(np.int64)

    def slow(qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
        held = lambda v: [int(a) for a in v]
        sums = [sum(a * b for a, b in zip(held(q[i]), held(x[j]))) for i, j in zip(qi, xi)]
        return np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums], dtype=np.int64)

    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return fast(qi, xi)
    short = np.abs(q).max(axis=1)[qi] * np.abs(x).max(axis=1)[xi] * q.shape[1] < EXACT
    scores = np.empty(len(qi), dtype=np.int64)
    scores[short], scores[~short] = fast(qi[short], xi[short]), slow(qi[~short], xi[~short])
    return scores


def unknown_last(bound: np.ndarray) -> tuple[np.ndarray, float]:
    """Bounds, infinite where they went beyond what their precision holds, and the largest size of the others."""
    size = float(np.abs(bound).max(initial=0))
    if math.isfinite(size):
        return bound, size
    known = np.isfinite(bound)
    return np.where(known, bound, np.inf), float(np.abs(bound[known]).max(initial=0))


@np.errstate(over="ignore", invalid="ignore")
def block_topk(
    q: np.ndarray, q_rows: np.ndarray, floors: np.ndarray, x: np.ndarray, x_rows: np.ndarray, ids: np.ndarray, k: int, told: dict[int, int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the query, index of the candidate and score of each query's best k of one block.

    ``floors`` are the queries' thresholds so far.  The k-th best exact score of the candidates whose bounds are best, at the
    coarsest and at the finest level, raises them.  Pairs are left out one by one; those whose bound isn't
    finite stay.  A k-th best score at the lower limit of 64 bits is no threshold, as all below it tie with
    it.  ``told`` takes up how many pairs there were, under 0, and how many each level left.
    """
    levels = [(statistics(q, s).astype(np.float32), statistics(x, s).astype(np.float32).T) for s in SEGMENTS]
    by_row = np.argsort(x_rows)
    at = np.minimum(np.searchsorted(x_rows[by_row], q_rows), len(x_rows) - 1)
    own = np.where(x_rows[by_row[at]] == q_rows, by_row[at], -1)
    whole = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT
    far_q, far_x = [np.sqrt((v * v).sum(axis=1)) for v in (q, x)]
    told = {} if told is None else told

    def loose(size: float, some: slice, columns: np.ndarray) -> float | np.ndarray:
        if whole:
            return LOOSE * size
        by_pair = LOOSE * far_q[some, None] * far_x[columns]
        return np.where(np.isnan(by_pair), np.inf, by_pair)

    found = []
    for start in range(0, len(q), AT_ONCE):
        some = slice(start, start + AT_ONCE)
        batch, mine, threshold = q[some], own[some, None], floors[some].copy()
        columns, alive = np.arange(len(x)), np.ones((len(batch), len(x)), dtype=bool)
        told[0] = told.get(0, 0) + alive.size
        for segments, (left, right) in zip(SEGMENTS, levels):
            bound, size = unknown_last(left[some] @ (right if len(columns) == len(x) else right[:, columns]))
            slack = loose(size, some, columns) + 1e-3
            probes = min(PROBES * k, len(columns))
            if probes >= k and segments in (SEGMENTS[0], SEGMENTS[-1]):
                best = columns[np.argpartition(bound, len(columns) - probes, axis=1)[:, -probes:]]
                scores = exact_scores(batch, x, np.repeat(np.arange(len(batch)), probes), best.ravel()).astype(float).reshape(best.shape)
                scores[best == mine] = -np.inf
                threshold = np.maximum(threshold, np.partition(scores, probes - k, axis=1)[:, probes - k])
                threshold[threshold <= -(2.0**63)] = -np.inf
            alive &= bound >= threshold[:, None] - slack
            left_over = alive.any(axis=0)
            columns, alive = columns[left_over], alive[:, left_over]
            told[segments] = told.get(segments, 0) + int(alive.sum())
        if alive.sum() > DENSE * alive.size:
            close, _ = unknown_last(batch @ x[columns].T)
            slack = 0 if whole else loose(0, some, columns)
            qi, xi = np.nonzero(alive & (close >= threshold[:, None] - slack) & (columns[None, :] != mine))
            scores = close[qi, xi].astype(np.int64) if whole else exact_scores(batch, x, qi, columns[xi])
        else:
            qi, xi = np.nonzero(alive & (columns[None, :] != mine))
            scores = exact_scores(batch, x, qi, columns[xi])
        xi = columns[xi]
        order = np.lexsort((x_rows[xi], ids[xi], ~scores, qi))
        qi, xi, scores = qi[order], xi[order], scores[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        found.append((qi[rank < k] + start, xi[rank < k], scores[rank < k]))
    return tuple(np.concatenate(part) for part in zip(*found))


@dataclass
class Cells:
    """Of one length of vectors: the sampled rows and their vectors, the pivots, and what bounds the members of each cell."""

    rows: np.ndarray
    sample: np.ndarray
    pivots: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row; whatever the arithmetic makes of huge components, it is some cell."""
        with np.errstate(over="ignore", invalid="ignore"):
            off = (self.pivots * self.pivots).sum(axis=1) - 2 * (x @ self.pivots.T)
        return np.argmin(np.where(np.isnan(off), np.inf, off), axis=1)

    @np.errstate(over="ignore", invalid="ignore")
    def thresholds(self, q: np.ndarray, q_rows: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best score among the sample, without itself; too few give none."""
        if len(self.rows) <= k or not np.abs(q).max(initial=0) * np.abs(self.sample).max(initial=0) * q.shape[1] < EXACT:
            return np.full(len(q), -np.inf)
        scores = q @ self.sample.T
        scores[q_rows[:, None] == self.rows] = -np.inf
        return np.partition(scores, len(self.rows) - k, axis=1)[:, len(self.rows) - k]

    @np.errstate(over="ignore", invalid="ignore")
    def wanted(self, q: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Which cells may hold a score at or above each query's threshold."""
        mean, deviation = np.split(statistics(q, CELL_SEGMENTS), 2, axis=1)
        bound = np.maximum(mean, 0) @ self.high.T + np.minimum(mean, 0) @ self.low.T + deviation @ self.deviation.T
        size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((np.maximum(np.abs(self.low), np.abs(self.high)) ** 2 + self.deviation**2).sum(axis=1))
        return ~(bound < floors[:, None] - LOOSE * size - 1e-3)


def drawn(rows: DataFrame, sample: int, scale: float) -> dict[int, Cells]:
    """Cells by the length of vectors, from at most ``sample`` rows."""
    taken = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "dim", "embedding").collect()
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("dim").isin(list({r.dim for r in taken}))).collect()}
    found = {}
    for dim in sorted(counts):
        some = sorted((r for r in taken if r.dim == dim), key=lambda r: r.row)
        x = matrix(pa.chunked_array([pa.array([r.embedding for r in some], pa.list_(pa.float64()))]), scale)
        pivots = x[: max(1, min(len(x), MOST_CELLS, counts[dim] // PER_CELL))]
        with np.errstate(over="ignore", invalid="ignore"):
            spread = np.nan_to_num(pivots - pivots.mean(axis=0))
            along = spread @ spread[np.argmax((spread * spread).sum(axis=1))]
        found[dim] = Cells(np.array([r.row for r in some], dtype=np.int64), x, pivots[np.argsort(along, kind="stable")])
    return found


def celled(rows: DataFrame, cells: dict[int, Cells], scale: float) -> DataFrame:
    """``rows`` with cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
            for dim in set(dims.tolist()) & cells.keys():
                at = np.flatnonzero(dims == dim)
                cell[at] = cells[dim].nearest(matrix(pa.chunked_array([batch.column("embedding").take(pa.array(at))]), scale))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def bound_cells(rows: DataFrame, cells: dict[int, Cells], scale: float) -> None:
    """Fill in what bounds each cell; there are at most ``MOST_CELLS`` times ``CELL_SEGMENTS`` rows of each length to collect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell, made = batch.column("dim").to_numpy(), batch.column("cell").to_numpy(), []
            for dim, c in {*zip(dims.tolist(), cell.tolist())}:
                if dim in cells:
                    some = pa.array(np.flatnonzero((dims == dim) & (cell == c)))
                    with np.errstate(over="ignore", invalid="ignore"):
                        mean, deviation = np.split(statistics(matrix(pa.chunked_array([batch.column("embedding").take(some)]), scale), CELL_SEGMENTS), 2, axis=1)
                    made += zip([dim] * CELL_SEGMENTS, [c] * CELL_SEGMENTS, range(CELL_SEGMENTS), mean.min(axis=0).tolist(), mean.max(axis=0).tolist(), deviation.max(axis=0).tolist())
            columns = list(zip(*made)) or [()] * 6
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=["dim", "cell", "segment", "low", "high", "deviation"])

    parts = map_arrow(rows.select("dim", "cell", "embedding"), run, "dim int, cell int, segment int, low double, high double, deviation double")
    sums = parts.groupBy("dim", "cell", "segment").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("deviation").alias("deviation")).collect()
    for held in cells.values():
        shape = len(held.pivots), CELL_SEGMENTS
        held.low, held.high, held.deviation = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for r in sums:
        held = cells[r.dim]
        held.low[r.cell, r.segment], held.high[r.cell, r.segment], held.deviation[r.cell, r.segment] = r.low, r.high, r.deviation


def asked(queries: DataFrame, cells: dict[int, Cells], k: int, scale: float) -> DataFrame:
    """The queries with their thresholds (floor) and the cells that they want."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = batch.column("dim").to_numpy(), batch.column("row").to_numpy()
            floors, wanted = np.full(batch.num_rows, -np.inf), [[0]] * batch.num_rows
            for dim in set(dims.tolist()) & cells.keys():
                at = np.flatnonzero(dims == dim)
                q = matrix(pa.chunked_array([batch.column("embedding").take(pa.array(at))]), scale)
                floors[at] = cells[dim].thresholds(q, rows[at], k)
                for i, want in zip(at, cells[dim].wanted(q, floors[at])):
                    wanted[i] = np.flatnonzero(want).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors), pa.array(wanted, pa.list_(pa.int32()))], names=[*batch.schema.names, "floor", "wanted"])

    fields = [T.StructField("floor", T.DoubleType()), T.StructField("wanted", T.ArrayType(T.IntegerType()))]
    return map_arrow(queries, run, T.StructType([*queries.schema.fields, *fields]))


def dealt(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """``rows`` with, in ``name``, one of as many blocks of a (dim, key) as keep each below about ``most`` rows."""
    sizes = rows.groupBy("dim", key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    return rows.join(cut(sizes, "exact-topk-sizes"), ["dim", key]).withColumn(name, F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")


def search(
    vectors: DataFrame, is_query, *, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0,
    query_block: int = 2048, candidate_block: int = 32_768, sample: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all rows for every row where ``is_query`` (a column of vec_id) holds."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", is_query(F.col("vec_id")).alias("query"), F.size("embedding").alias("dim"))
    rows = cut(rows, "exact-topk")
    cells = drawn(rows, sample, scale)
    rows = cut(celled(rows, cells, scale), "exact-topk-cells")
    bound_cells(rows, cells, scale)
    queries = rows.filter("query")
    groups = max(1, queries.count() // query_block)
    # neighbouring cells share a block of queries, so that there are about as many blocks as the queries need
    count = F.lit(MOST_CELLS)
    for dim, held in cells.items():
        count = F.when(F.col("dim") == dim, len(held.pivots)).otherwise(count)
    group = F.floor(F.col("cell") * F.least(F.lit(groups), count) / count).cast("int")
    queries = dealt(asked(queries, cells, k, scale).withColumn("group", group), "group", query_block, "part")
    queries = cut(queries.withColumn("qb", F.struct("group", "part")).withColumn("cell", F.explode("wanted")).select("dim", "cell", "qb", "row", "vec_id", "embedding", "floor"), "exact-topk-asked")
    wanted = cut(queries.groupBy("dim", "cell").agg(F.collect_set("qb").alias("qbs")), "exact-topk-wanted")
    candidates = dealt(rows.select("dim", "cell", "row", "vec_id", "embedding"), "cell", candidate_block, "xb")
    blocks = candidates.groupBy("dim", "cell").agg(F.max("xb").alias("last"))
    candidates = candidates.join(wanted, ["dim", "cell"]).withColumn("qb", F.explode("qbs")).drop("qbs")
    queries = queries.join(cut(blocks, "exact-topk-blocks"), ["dim", "cell"]).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (q_rows, q_ids), (x_rows, x_ids) = [(t["row"].to_numpy(), t["vec_id"].to_numpy()) for t in (left, right)]
        qi, xi, scores = block_topk(matrix(left["embedding"], scale), q_rows, left["floor"].to_numpy(), matrix(right["embedding"], scale), x_rows, x_ids, k)
        return pa.table([q_rows[qi], q_ids[qi], x_rows[xi], x_ids[xi], scores], schema=schema)

    key = ["dim", "cell", "xb", "qb"]
    best = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(one, "query_row long, query_id long, row long, vec_id long, score long")
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
