"""Exact top-k search by distributed histogram selection.

Each task scores all its rows against a slice of the queries and counts the
scores of every query in a histogram over the range in which the query's k-th
score must lie.  Summed over all tasks, the histogram names the bin that holds
it; that bin is the next range, until a bin is one score wide.  Then one pass
keeps what scores above the k-th score, and of its ties the smallest ids.

Queries are taken in slices of bounded size, which is what the driver and each
task hold of them; nothing of the searched rows leaves a task but histogram bins
and results.  A task sends bins from its highest score down only as far as its
own k-th score, below which no k-th score can lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.shared import quoted, written

#: Queries that are searched for together.
SLICE = 4096
#: Queries scored at once in a task.
BLOCK = 512
#: Searched rows scored at once in a task.
ROWS = 2048
BINS = 1024


def finite(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles that hold integers; null for one that is NaN or infinite."""
    return F.transform(vector, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(x.cast("double") * scale).cast("double")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids in ascending order and their vectors as rows, for each length of vectors."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            ids, lists = part.column("id").to_numpy(zero_copy_only=False), part.column("v")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                at = at[np.argsort(ids[at], kind="stable")]
                yield ids[at], flat[starts[at][:, None] + np.arange(d)]


def _scores(batches, queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, ids of rows, and scores; a query's own row scores minus infinity."""
    for ids, rows in _blocks(batches):
        for at, own, matrix in queries:
            if matrix.shape[1] != rows.shape[1]:
                continue
            for k in range(0, len(at), BLOCK):
                score = matrix[k : k + BLOCK] @ rows.T
                score[own[k : k + BLOCK, None] == ids[None, :]] = -np.inf
                yield at[k : k + BLOCK], ids, score


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each query the k highest inner products with other rows.

    Vectors hold integers (below 2^53 in every product); ties go to the
    smaller id; a query never finds its own id.  Rows with a null id or a vector
    that is null, empty or holds null or non-finite components take no part;
    vectors of different lengths are not compared.  Rows that repeat an id are
    rows of their own: each is searched, and each is a result; of queries with
    one id only the one with the least vector is asked.  Other columns are
    ignored; fewer than k rows give fewer results, empty tables none.
    """

    def usable(table: DataFrame) -> DataFrame:
        return table.select(quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & finite(F.col("v")))

    rows, asked = written(usable(df)), written(usable(queries).groupBy("id").agg(F.min("v").alias("v")))
    widest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m")).first()["m"] or 0.0
    slices = max(1, -(-asked.count() * 5 // (4 * SLICE)))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    found = [_search(rows, asked.filter(F.col("slice") == s), k, widest) for s in range(slices)]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _search(rows: DataFrame, asked: DataFrame, k: int, widest: float) -> DataFrame:
    spark = rows.sparkSession
    own = asked.orderBy("id").toPandas()  # a slice
    names = own["id"].to_numpy(np.int64)
    vectors = [np.asarray(v, float) for v in own["v"]]
    sizes = np.array([len(v) for v in vectors], int)
    groups = [(at, names[at], np.stack([vectors[i] for i in at])) for d in np.unique(sizes) for at in [np.flatnonzero(sizes == d)]]
    shared = spark.sparkContext.broadcast(groups)
    reach = np.array([np.ceil(np.abs(v).sum() * widest) for v in vectors], float)
    low, high = -reach, reach.copy()
    need = np.full(len(names), k, np.int64)
    while len(names) and (high > low).any():
        width = np.maximum(np.ceil((high - low + 1) / BINS), 1)
        low_b, width_b, high_b, need_b = low, width, high, need

        def count(batches: Iterator[pa.RecordBatch], low=low_b, width=width_b, high=high_b, need=need_b) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(low), BINS), np.int64)
            for at, _, score in _scores(batches, shared.value):
                inside = (score >= low[at, None]) & (score <= high[at, None])
                q, c = np.nonzero(inside)
                bins = ((score[q, c] - low[at[q]]) // width[at[q]]).astype(np.int64)
                total[at] += np.bincount(q * BINS + bins, minlength=len(at) * BINS).reshape(len(at), BINS)
            higher = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            q, b = np.nonzero((total > 0) & (higher < need[:, None]))
            for i in range(0, len(q), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(q[s]), pa.array(b[s]), pa.array(total[q[s], b[s]])], names=["q", "bin", "n"])

        bins = rows.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
        wanted = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(need)], "q long, need long")
        holds = bins.withColumn("upto", upto).join(F.broadcast(wanted), "q").filter("upto >= need AND upto - n < need").collect()  # one row for each query of the slice
        settled = np.ones(len(names), bool)
        for r in holds:
            i = r["q"]
            settled[i] = False
            low[i], need[i] = low[i] + r["bin"] * width[i], need[i] - (r["upto"] - r["n"])
            high[i] = min(low[i] + width[i] - 1, high[i])
        low[settled], high[settled] = -np.inf, -np.inf  # fewer rows than asked for: all are results
    kth = low

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, ids, score in _scores(batches, shared.value):
            bound = kth[at, None]
            tied = (score == bound) & (score > -np.inf)
            first = tied & (np.cumsum(tied, axis=1) <= k)  # ids ascend
            q, c = np.nonzero((score > bound) | first)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(names[at[q]]), pa.array(ids[c]), pa.array(score[q, c].astype(np.int64))], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kept = rows.mapInArrow(keep, "query_id long, vec_id long, score long").withColumn("rank", rank).filter(F.col("rank") <= k)
    return kept.select("query_id", "rank", "vec_id", "score")
