"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components become integers, ``floor(scale * x)``. A block of candidates is an index: each dimension is a term in two
forms, the distance of a component above the block's least value (for positive query weights) and below its greatest
(for negative ones), so that every impact is zero or more. Impacts are quantised into ``LEVELS`` steps; a level's
postings are one segment, and segments are processed in descending order of quantised impact for many queries at once.

After each segment a candidate's score lies between what it has gathered and that plus, for each dimension not yet
seen, the weight times the bound of the next segment. A query leaves the loop only on proof: when no more than
``RESCORED`` candidates can still reach the k-th greatest lower bound. Those, ties included, are scored exactly. The
rows of each pair of query block and candidate block meet in one task, which returns k rows per query; the best k of
all blocks are chosen by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS, RESCORED = 8, 512
#: Rows of a block: candidates of one index, queries of one batch.
CANDIDATE_ROWS, QUERY_ROWS = 16_384, 1_024
#: Whole numbers up to here are exact as double.
EXACT = float(1 << 53)


class ImpactIndex:
    """Vectors of whole numbers (rows), with their ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.reach = self.high - self.low
        step = np.maximum(np.ceil((self.reach + 1) / levels), 1)
        # Each form is a matrix of impacts; a posting's segment is its impact divided by the dimension's step.
        self.forms = [(impact, impact // step) for impact in (self.vectors - self.low, self.high - self.vectors)]
        self.levels, self.step = levels, step

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, rescored: int = RESCORED) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places (in ``ids``) and scores of the k best of each query, ties to the smaller id, without the query's own id."""
        n, out = len(self.ids), [None] * len(queries)
        if n == 0:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        weights = (np.maximum(queries, 0), np.maximum(-queries, 0))
        # A score is the gathered impacts plus a number that is the same for all candidates of a query.
        gathered = np.zeros((len(queries), n))
        open_queries = np.arange(len(queries))
        barred = [np.flatnonzero(self.ids == i) for i in own]
        for level in range(self.levels - 1, -1, -1):
            w = [x[open_queries] for x in weights]
            for (impact, segment), x in zip(self.forms, w, strict=True):
                gathered += x @ np.where(segment == level, impact, 0).T
            if level:
                # What a dimension not seen yet can add: the greatest impact of the next segment.
                cap = np.minimum(level * self.step - 1, self.reach)
                unseen = sum(x @ np.where(segment < level, cap, 0).T for (_, segment), x in zip(self.forms, w, strict=True))
            else:
                unseen = np.zeros_like(gathered)
            lower, upper = gathered, gathered + unseen
            done = np.zeros(len(open_queries), bool)
            for row, q in enumerate(open_queries.tolist()):
                bound = lower[row].copy()
                bound[barred[q]] = -1
                floor = np.partition(bound, n - k)[n - k] if n > k else -1
                members = np.flatnonzero(upper[row] >= floor)
                if level and len(members) > max(rescored, k + 1):
                    continue
                done[row] = True
                members = members[~np.isin(members, barred[q])]
                scores = self._exact(queries[q], members)
                first = np.lexsort((members, -scores))[:k]
                out[q] = (members[first], scores[first])
            open_queries, gathered = open_queries[~done], gathered[~done]
            if not len(open_queries):
                break
        return out

    def _exact(self, query: np.ndarray, members: np.ndarray) -> np.ndarray:
        return self.vectors[members] @ query


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``id, vector array<double>``: floor(scale * component). Vectors that are NULL, empty or hold NULL, NaN or an
    infinity, and rows without id, are left out."""
    vector = F.transform(table[vector_column], lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(table[vector_column], lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return table.where(table[id_column].isNotNull() & (F.size(table[vector_column]) > 0) & finite).select(table[id_column].cast("long").alias("id"), vector.alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, levels: int = LEVELS, rescored: int = RESCORED) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the k rows of ``vectors`` of greatest inner
    product, without the row of the query's own id; both hold ``id, vector`` of whole numbers (see ``whole_vectors``).

    Ties go to the smaller id; fewer than k candidates give all. A query meets the vectors of its own length. A query id
    that repeats is asked once, with its least vector; candidate rows that repeat are rows of their own. Tables without
    rows give none. Scores must stay within 2**53, which is checked.
    """
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("most"), F.max(F.array_max(F.transform("vector", F.abs))).alias("reach")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("most"), F.max(F.array_max(F.transform("vector", F.abs))).alias("reach")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape.n or not asked.n:
        return vectors.sparkSession.createDataFrame([], schema)
    if shape.most * (2 * shape.reach + 1) * max(1.0, asked.reach) >= EXACT:
        raise ValueError("scores beyond 2**53")
    rows, columns = -(-asked.n // query_rows), -(-shape.n // candidate_rows)

    def block(of: str, n: int):
        return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")

    left = queries.select(block("id", rows).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), F.lit(True).alias("asks"), "id", "vector")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), block("id", columns).alias("column"), F.lit(False).alias("asks"), "id", "vector")

    def search(part: pa.Table) -> pa.Table:
        asks = part.column("asks").combine_chunks()

        def side(mask) -> tuple[np.ndarray, np.ndarray]:
            own = part.filter(mask)
            return own.column("id").to_numpy(), _numbers(own.column("vector"))

        (ask_ids, ask), (ids, candidates) = side(asks), side(pc.invert(asks))
        found: list[list[np.ndarray]] = []
        if len(ids):
            index = ImpactIndex(ids, candidates, levels)
            for at in range(0, len(ask_ids), 128):
                some = ask_ids[at : at + 128]
                for q, (places, scores) in zip(some, index.best(ask[at : at + 128], some, k, rescored), strict=True):
                    found.append([np.full(len(places), q), index.ids[places], scores])
        q, i, s = (np.concatenate([f[x] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for x in range(3))
        return pa.table({"query_id": q, "vec_id": i, "score": s})

    best = left.unionByName(right).groupBy(F.size("vector").alias("length"), "row", "column").applyInArrow(search, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(vectors: DataFrame, step: int = 20) -> DataFrame:
    """The rows whose id is divisible by ``step``."""
    return vectors.where(F.pmod("id", F.lit(step)) == 0)

