"""Products of sparse row vectors, block by block: the best matches of a stated set of queries among all rows.

Both sides are cut into blocks of rows by a hash of their ids. A cell of the result is one
block of queries against one block of rows; both are sent to it once, so a task holds two
bounded blocks, multiplies some queries at a time, adds up the partial products of one block
of columns after the other, and keeps the best matches of each query. Blocks of queries are as
large as leaves a cell to each shuffle partition, so all rows are sent out as few times as may be. The matches of a query's cells meet last, ``k`` from
each. All rows are compared: there is no index and nothing is cut off.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.dedup import top_rows

#: Queries and columns that are multiplied at once; rows of a block of rows, on average.
QUERY_ROWS, BLOCK_ROWS, COLUMNS = 512, 4096, 256
#: Queries of a block at most, on average: all rows are sent once to each block of queries.
MOST_QUERIES = 32768


def binned_roots(peaks: DataFrame, keys: list[str], mz: str, intensity: str, low: float, width: float, bins: int) -> DataFrame:
    """keys, at, v: the summed roots of intensities in bins from ``low`` on, as a sparse vector of length one."""
    place = F.floor((F.col(mz) - low) / width).cast("int")
    inside = (F.col(mz) >= low) & (F.col(mz) < low + bins * width)
    rows = peaks.filter(inside).groupBy(*keys, place.alias("_at")).agg(F.sum(F.sqrt(F.col(intensity).cast("double"))).alias("_v"))
    vectors = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_s"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n"))
    scale = F.when(F.col("_n") > 1e-10, F.col("_n")).otherwise(1.0)
    return vectors.select(*keys, F.col("_s._at").alias("at"), F.transform("_s._v", lambda x: x / scale).alias("v"))


def dense_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, at, v of dense vectors, of length one."""
    length = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    scale = F.when(length > 1e-10, length).otherwise(1.0)
    return rows.select(key, F.transform(vector, lambda x, i: i).alias("at"), F.transform(vector, lambda x: x.cast("double") / scale).alias("v"))


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row, column, value) of a block's vectors, rows in the order of their ids."""
    ids = table.column(0).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    at, v = table.column(1).combine_chunks(), table.column(2).combine_chunks()
    sizes = np.diff(at.offsets.to_numpy())
    return ids[order], np.repeat(rank, sizes), at.flatten().to_numpy(), v.flatten().to_numpy()


def _some(block: tuple, first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block from the first to before the end."""
    ids, row, column, value = block
    on = (row >= first) & (row < end)
    return ids[first:end], row[on] - first, column[on], value[on]


def product(a: tuple, b: tuple, columns: int = COLUMNS) -> np.ndarray:
    """The products of all rows of two blocks: partial ones over blocks of columns, added up."""
    total = np.zeros((len(a[0]), len(b[0])))
    if not len(a[2]) or not len(b[2]):
        return total
    for start in range(0, int(min(a[2].max(), b[2].max())) + 1, columns):
        part = []
        for ids, row, column, value in (a, b):
            on = (column >= start) & (column < start + columns)
            dense = np.zeros((len(ids), columns))
            np.add.at(dense, (row[on], column[on] - start), value[on])
            part.append(dense)
        total += part[0] @ part[1].T
    return total


def best_matches(queries: DataFrame, rows: DataFrame, k: int, query: str = "query", row: str = "row", digits: int = 6, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS, columns: int = COLUMNS, most_queries: int = MOST_QUERIES) -> DataFrame:
    """query, row, score, rank: the ``k`` rows with the largest product above 0 of each query, smaller ids first on a tie.

    ``queries`` has (query, at, v), ``rows`` (row, at, v); a row isn't matched with the query of its own id. Scores are
    rounded before they are ranked, so the order of additions doesn't show.
    """
    asked, n_blocks = queries.count(), max(1, ceil(rows.count() / block_rows))
    cells = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_queries = max(1, ceil(asked / max(most_queries, query_rows)), min(ceil(asked / query_rows), ceil(cells / n_blocks)))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(F.col(query).alias("id"), "at", "v", mine(query, n_queries).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("j"))
    right = rows.select(F.col(row).alias("id"), "at", "v", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("i"), mine(row, n_blocks).alias("j"))
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]

    def cell(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        whole, b = _block(ours), _block(theirs)
        parts = [best(_some(whole, start, start + query_rows), b) for start in range(0, len(whole[0]), query_rows)]
        types = ours.schema.field(0).type, theirs.schema.field(0).type
        q, r, score = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else ([], [], [])
        return pa.table([pa.array(q, types[0]), pa.array(r, types[1]), pa.array(score, pa.float64())], names=[query, row, "score"])

    def best(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = np.round(product(a, b, columns), digits)
        scores[a[0][:, None] == b[0][None, :]] = 0.0
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(scores, order, axis=1)
        i, j = np.nonzero(top > 0)
        return a[0][i], b[0][order[i, j]], top[i, j]

    cells = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, f"{query} {kinds[0]}, {row} {kinds[1]}, score double")
    return top_rows(cells, [query], k, F.col("score").desc(), row)
