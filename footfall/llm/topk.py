"""Exact top-k inner products by the threshold algorithm.

For each block of candidates there is one sorted list per dimension. A query reads
the lists from the end where its component makes scores large, scores what it
meets, and stops when no unread row could reach its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import Workspace, runs, whole_groups

CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 2_048
_EXACT, _LONG = float(2**53), float(2**63)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite."""
    sound = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class SortedLists:
    """One block of candidates with its rows in order of every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids = ids
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)
        self.queries = self.stopped_by_bound = self.rows_met = 0

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to smaller ids, but for `own`.

        Lists are read from one row each, in steps that double; after each step the
        bound is tested. Reading ends when the bound is below the k-th score, or when
        no row is left that was not met.
        """
        size = len(self.ids)
        allowed = self.ids != own
        seen = np.zeros(size, dtype=bool)
        scores = np.zeros(size, dtype=self.rows.dtype)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        if not len(up) and not len(down):
            # Every row scores 0, so there is no list to read.
            seen[:] = True
        depth, read = 0, 1
        while not seen.all():
            now = min(read, size)
            met = np.zeros(size, dtype=bool)
            met[self.order[size - now : size - depth, up].ravel()] = True
            met[self.order[depth:now, down].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen[fresh] = True
            depth, read = now, now * 2
            scores[fresh] = self.rows[fresh] @ query
            best = scores[seen & allowed]
            if len(best) < k:
                continue
            kth = np.partition(best, len(best) - k)[len(best) - k]
            bound = self.values[size - depth, up] @ query[up] + self.values[depth - 1, down] @ query[down]
            # An unread row at the bound could tie with a smaller id, so not at equality.
            if kth > bound:
                self.stopped_by_bound += 1
                break
        self.queries += 1
        self.rows_met += int(np.count_nonzero(seen))
        found = np.flatnonzero(seen & allowed)
        own_scores = scores[found]
        if len(found) > k:
            kth = np.partition(own_scores, len(found) - k)[len(found) - k]
            found = found[own_scores >= kth]
        rank = np.lexsort((self.ids[found], -scores[found]))[:k]
        return self.ids[found][rank], scores[found][rank]


def _matrix(table: pa.Table, start: int, end: int) -> np.ndarray:
    column = table.column("vector").chunk(0).slice(start, end - start)
    return column.flatten().to_numpy().reshape(end - start, -1)


def _blocks_of(count: int, size: int) -> int:
    return max(1, -(-count // size))


def top_products(
    vectors: DataFrame,
    k: int = 20,
    query_modulus: int = 20,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k best rows of every query.

    `vectors` needs `vec_id` and a whole-number array `vector`; other columns are
    ignored. Queries are rows whose `vec_id` is divisible by `query_modulus`.
    Candidates and queries are dealt into blocks by hash and every query block
    meets every candidate block once, so a group holds one bounded block of each;
    each gives k rows per query, which a final rank merges. Blocks compare
    vectors of the same length only.

    Rows without a usable vector or with a null id take no part. Rows alike in id
    and vector count once. Rows with the query's id are its own. An id with
    several vectors is ranked by its best score as a candidate, and as a query
    each vector counts towards the same list. An empty table gives no rows.
    """
    work = Workspace(vectors.sparkSession, "top-products")
    rows = work.stage(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .distinct(),
        "vectors",
    )
    is_query = F.col("vec_id") % query_modulus == 0
    count = rows.agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("queries")
    ).first()
    homes = _blocks_of(count["all"], candidate_block)
    visits = _blocks_of(count["queries"], query_block)
    length = F.size("vector").alias("length")
    code = F.xxhash64("vec_id", "vector")
    candidates = rows.select(
        length,
        F.pmod(code, F.lit(homes)).cast("int").alias("home"),
        F.explode(F.sequence(F.lit(0), F.lit(visits - 1))).alias("visit"),
        F.lit(0).alias("side"), "vec_id", "vector",
    )
    queries = rows.filter(is_query).select(
        length,
        F.explode(F.sequence(F.lit(0), F.lit(homes - 1))).alias("home"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(visits)).cast("int").alias("visit"),
        F.lit(1).alias("side"), "vec_id", "vector",
    )
    grouped = (
        candidates.unionByName(queries)
        .repartition(homes * visits, "length", "home", "visit")
        .sortWithinPartitions("length", "home", "visit", "side", "vec_id")
    )

    def search(batches):
        for table in whole_groups(batches, 3):
            length, home, visit, side, ids = (table.column(i).to_numpy() for i in range(5))
            for start, end in runs(length, home, visit):
                cut = start + int(np.searchsorted(side[start:end], 1))
                if cut == start or cut == end:
                    continue
                block, asked = _matrix(table, start, cut), _matrix(table, cut, end)
                largest = float(np.abs(block).max()) * float(np.abs(asked).max())
                if largest * block.shape[1] < _EXACT:
                    # Whole numbers this small are exact as doubles, and faster.
                    block, asked = block.astype(np.float64), asked.astype(np.float64)
                elif largest * block.shape[1] >= _LONG:
                    raise OverflowError("inner products of these vectors exceed 64 bits")
                lists = SortedLists(ids[start:cut], block)
                found = [lists.top(q, own, k) for q, own in zip(asked, ids[cut:end], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[cut:end], [len(f[0]) for f in found])),
                        pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    found = grouped.mapInArrow(search, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_embeddings(embeddings: DataFrame, k: int = 20, query_modulus: int = 20) -> DataFrame:
    """Top products of `embeddings` after scaling components to whole numbers.

    A finite component whose scaled value passes 2^53 raises and names its vector.
    """
    huge = F.exists("embedding", lambda x: F.abs(x.cast("double")) >= F.lit(_EXACT / 64.0))
    told = F.concat(F.lit("a component is too large in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    sound = F.when(huge, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    rows = embeddings.filter(usable(F.col("embedding"))).filter(sound).select(
        "vec_id", whole_numbers(F.col("embedding")).alias("vector")
    )
    return top_products(rows, k, query_modulus)
