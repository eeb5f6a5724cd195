"""Exact dense retrieval for a batch of query vectors, and near-duplicate vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.bounds import MOST_ROWS
from lodestone.operators.index import ranked

#: Queries whose scores are held at once, and the difference up to which scores tie.
AT_ONCE, TIE = 256, 1e-9
#: Rows of a block; each pair of blocks is one group of a cogrouped map.
BLOCK = 8192
#: Products of norms below this have lost digits: such pairs are summed whatever the product of matrices says.
TINY = 1e-280


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm one; a row of norm zero becomes NaN, and is never found."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def stacked(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one length, without nulls, as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the components as ``numeric.cosine`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def blocks(df: DataFrame) -> int:
    return max(1, -(-df.count() // BLOCK))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with the length of its vectors, and its block of ``n`` by a hash; what has no vector, or a null in it, is left out."""
    rows = df.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    return rows.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64(key, "vector"), F.lit(n)).cast("int")})

def conjunction(filters: dict[str, object]) -> Column:
    """Equality of every key; keys that are not pushed to the vectors are left out."""
    found = F.lit(True)
    for key, value in filters.items():
        if key not in ("tags", "collection", "source_path"):
            found &= F.col(key) == value
    return found


def topk(chunks: DataFrame, queries: DataFrame, *, k: int = 10, where: Column | None = None, vector: str = "embedding") -> DataFrame:
    """query_id, chunk_id, score and rank by cosine; ``queries`` has query_id and vector.

    A batch of up to ``MOST_ROWS`` queries goes to every task as a matrix.  Chunks are scanned once, in
    Arrow batches; a batch sends on no more than its own best k a query (and what ties with them), so
    the shuffle doesn't grow with what is scanned.  More queries are dealt into blocks, and so are the
    chunks; each pair of blocks sends on as much.  Vectors of norm zero, with nulls, or of another
    length than the query's are never found.
    """
    rows = (chunks if where is None else chunks.filter(where)).select("chunk_id", F.col(vector).alias("vector"))
    query_type, chunk_type = queries.schema["query_id"].dataType, rows.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])

    def nearest(ids: pa.Array, matrix: np.ndarray, chunk_ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(ids), AT_ONCE):
            score = np.nan_to_num(np.maximum(0.0, 0.5 + 0.5 * (matrix[start : start + AT_ONCE] @ x.T)), nan=-1.0)
            floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.zeros(len(score))
            qi, xi = np.nonzero((score >= floor[:, None] - TIE) & (score >= 0))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + qi)), chunk_ids.take(pa.array(xi)), pa.array(score[qi, xi])], names=["query_id", "chunk_id", "score"])

    asked = queries.select("query_id", "vector").limit(MOST_ROWS + 1).collect()
    if len(asked) > MOST_ROWS:
        found = _in_blocks(rows, queries.select("query_id", "vector"), nearest, schema)
        return ranked(found, k, F.desc(F.round("score", 9)), F.col("chunk_id"))
    by_length: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r["vector"]) for r in asked if r["vector"] is not None}:
        some = [r for r in asked if r["vector"] is not None and len(r["vector"]) == size]
        by_length[size] = [r["query_id"] for r in some], unit(np.array([r["vector"] for r in some], dtype=np.float64))
    rows = rows.filter(F.size("vector").isin(*by_length) & ~F.exists("vector", lambda x: x.isNull())) if by_length else rows.limit(0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {size: (pa.array(ids, to_arrow_type(query_type)), matrix) for size, (ids, matrix) in by_length.items()}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size, (ids, matrix) in held.items():
                at = np.flatnonzero(lengths == size)
                if len(at):
                    some = batch.take(pa.array(at))
                    yield from nearest(ids, matrix, some.column("chunk_id"), unit(stacked(some.column("vector"), size)))

    return ranked(rows.mapInArrow(best, schema), k, F.desc(F.round("score", 9)), F.col("chunk_id"))


def _in_blocks(rows: DataFrame, queries: DataFrame, nearest, schema: T.StructType) -> DataFrame:
    """What ``nearest`` makes of each block of queries and each block of chunks."""
    n_q, n_x = blocks(queries), blocks(rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(queries, "query_id", n_q).withColumnRenamed("block", "qb").withColumn("xb", every(n_x))
    right = dealt(rows, "chunk_id", n_x).withColumnRenamed("block", "xb").withColumn("qb", every(n_q))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def one(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return arrow.empty_table()
        size = q["dim"][0].as_py()
        ids, matrix = q["query_id"].combine_chunks(), unit(stacked(q["vector"], size))
        return pa.Table.from_batches(nearest(ids, matrix, x["chunk_id"].combine_chunks(), unit(stacked(x["vector"], size)))).cast(arrow)

    key = ["dim", "qb", "xb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(one, schema)


def similar_pairs(vectors: DataFrame, *, threshold: float = 0.85, key: str = "id", vector: str = "embedding") -> DataFrame:
    """left, right and similarity (4 places) of all pairs at or over the threshold.

    Rows are dealt into blocks, and each pair of blocks is one group of a cogrouped map, so that every row
    is compared with every other at any size.  Products of matrices find the pairs that may reach the
    threshold; their cosines are then summed as ``numeric.cosine`` does.  Vectors that are null, hold a
    null, or have norm zero are in no pair, and neither are vectors of different lengths.
    """
    kept = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    n = blocks(vectors)
    rows = dealt(vectors.select(F.col(key).alias("id"), F.col(vector).cast(kept).alias("vector")).filter("id is not null"), "id", n)
    first = rows.select("id", "vector", "dim", F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(n - 1))).alias("b"))
    second = rows.select("id", "vector", "dim", F.explode(F.sequence(F.lit(0), "block")).alias("a"), F.col("block").alias("b"))
    schema = T.StructType([T.StructField("x", rows.schema["id"].dataType), T.StructField("y", rows.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        size = left["dim"][0].as_py()
        (x, x_ids), (y, y_ids) = [(stacked(t["vector"], size), t["id"].combine_chunks()) for t in (left, right)]
        nx, ny, made = np.sqrt(dots(x, x)), np.sqrt(dots(y, y)), []
        same = left["a"][0].as_py() == left["b"][0].as_py()
        with np.errstate(all="ignore"):
            for start in range(0, len(x), AT_ONCE):
                norms = nx[start : start + AT_ONCE, None] * ny
                may = ~(x[start : start + AT_ONCE] @ y.T < (threshold - TIE) * norms) | (norms < TINY)
                xi, yi = np.nonzero(may & (nx[start : start + AT_ONCE, None] != 0) & (ny != 0))
                for at in range(0, len(xi), 65_536):
                    i, j = xi[at : at + 65_536] + start, yi[at : at + 65_536]
                    s = dots(x[i], y[j]) / (nx[i] * ny[j])
                    i, j, s = (v[~(s < threshold)] for v in (i, j, s))
                    made.append(pa.table([x_ids.take(pa.array(i)), y_ids.take(pa.array(j)), pa.array(s)], names=["x", "y", "similarity"]).cast(arrow))
        found = pa.concat_tables(made) if made else arrow.empty_table()
        # within one block either order of a pair is found
        return found.filter(pc.less(found["x"], found["y"])) if same else found

    place = ["dim", "a", "b"]
    pairs = first.groupBy(*place).cogroup(second.groupBy(*place)).applyInArrow(one, schema)
    return pairs.filter("x <> y").select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), F.round("similarity", 4).alias("similarity"))
