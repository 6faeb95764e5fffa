"""Exact top-k by inner product with MaxScore over term postings, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from crewline.llm.common import finite_vector

BLOCK = 2048
# Sums below these are exact in a double and in a long; beyond, Python's integers are used.
EXACT, SAFE = 2**53, 2**62
LONG = 2**63 - 1


def quantized(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, taken in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(rows: pd.Series, width: int, kind=np.int64) -> np.ndarray:
    """Vectors as rows; missing trailing terms count as zero."""
    sizes = rows.map(len).to_numpy()
    if len(rows) and (sizes == width).all():
        return np.vstack(rows.to_numpy()).astype(kind) if width else np.zeros((len(rows), 0), kind)
    out = np.zeros((len(rows), width), kind)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Shard:
    """The candidates of one block as postings: one list of weights for each term, in order of id."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], weights[order]
        self.postings = np.ascontiguousarray(self.weights.T)
        self.low, self.high = self.weights.min(axis=0), self.weights.max(axis=0)

    def search(self, query: int, terms: np.ndarray, k: int, seed: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best. Scores of terms are bounded by each list's least and greatest weight."""
        ends = np.stack((terms * self.low, terms * self.high))
        most = ends.max(axis=0)
        order = np.argsort(ends.min(axis=0) - most, kind="stable")  # widest spread first
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # bound of the terms from each place on
        # The first candidates are scored whole: they give the score to beat.
        best = self._best(np.arange(min(seed, len(self.ids))), self.weights[:seed] @ terms, query, k)
        todo = np.arange(min(seed, len(self.ids)), len(self.ids))
        if not len(todo):
            return self.ids[best[0]], best[1]
        bar = best[1][-1] if len(best[1]) == k else None
        # Terms whose bounds together cannot reach the bar are non-essential; the others' lists are traversed.
        least = rest[0] - (most - ends.min(axis=0)).sum()
        gap = np.cumsum((most - ends.min(axis=0))[order][::-1])[::-1]
        essential = len(order) if bar is None else int(np.count_nonzero(least + gap >= bar))
        essential = max(essential, 1) if len(order) else 0
        partial = np.zeros(len(todo), dtype=self.weights.dtype)
        place = 0
        while place < len(order):
            step = order[place : place + 8]
            if place < essential:
                partial += (terms[step] @ self.postings[step])[todo]
            else:
                partial += self.weights[todo[:, None], step] @ terms[step]
            place += len(step)
            if bar is not None:
                live = partial + rest[place] >= bar  # only what is still competitive is probed further
                if not live.all():
                    todo, partial = todo[live], partial[live]
                    if not len(todo):
                        break
        at = np.concatenate((best[0], todo))
        best = self._best(at, np.concatenate((best[1], partial)), query, k)
        return self.ids[best[0]], best[1]

    def _best(self, at: np.ndarray, scores: np.ndarray, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        other = self.ids[at] != query
        at, scores = at[other], scores[other]
        if len(at) > 8 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= cut], scores[scores >= cut]
        # Highest score first, ties to the smaller id: the shard is in order of id, so a stable sort keeps it.
        order = np.argsort(at, kind="stable")
        at, scores = at[order], scores[order]
        order = np.argsort(-scores, kind="stable")[:k]
        return at[order], scores[order]


def _search_block(k: int):
    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(shard):
            width = int(max(queries["terms"].map(len).max(), shard["terms"].map(len).max()))
            largest = [max((max(map(abs, map(int, (np.min(t), np.max(t))))) if len(t) else 0) for t in side["terms"]) for side in (queries, shard)]
            bound = largest[0] * largest[1] * max(width, 1)
            kind = np.float64 if bound < EXACT else np.int64 if bound < SAFE else object
            lists = Shard(shard["vec_id"].to_numpy(np.int64), _matrix(shard["terms"], width, kind))
            for query, terms in zip(queries["vec_id"].to_numpy(np.int64), _matrix(queries["terms"], width, kind)):
                ids, scores = lists.search(int(query), terms, k)
                found.append((np.full(len(ids), query), ids, scores))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        held = np.array([max(-LONG - 1, min(LONG, int(s))) for s in columns[2]], np.int64) if columns[2].dtype == object else columns[2].astype(np.int64)
        return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": held})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The k best candidates of every query: ``query_id, rank, vec_id, score``.

    ``vectors`` and ``queries`` have ``vec_id`` and ``terms``, an array of integers: one weight for each term.
    Both are dealt into blocks of about ``block`` rows; each block of queries meets each block of candidates
    (a shard) in one bounded group. In a shard MaxScore runs for each query and returns its k best; the
    shards' lists are merged by an aggregate that keeps k rows. Ties go to the smaller ``vec_id``.

    Rows with a null id or null terms take no part. Every row is a candidate, a repeated one as often as it is
    there, except rows with the query's own id; a repeated query row asks again, and the k best of all its
    rows' lists are kept, as a join of the rows and a rank per query id would give. Shorter vectors are padded
    with zeros, and a score beyond a long is held at its end. Fewer than k candidates give fewer rows; an empty
    table gives none.
    """
    vectors, queries = [side.where("vec_id IS NOT NULL AND terms IS NOT NULL").select("vec_id", "terms") for side in (vectors, queries)]
    # Two counts come to the driver; they set how many blocks there are.
    shards = max(1, -(-vectors.count() // block))
    groups = max(1, -(-queries.count() // block))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", deal(groups, 1).alias("group"), each(shards).alias("shard"))
    right = vectors.select("*", deal(shards, 2).alias("shard"), each(groups).alias("group"))
    found = (
        left.groupBy("group", "shard").cogroup(right.groupBy("group", "shard"))
        .applyInPandas(_search_block(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Top k of the rows whose id is divisible by ``every`` against all other rows of an embeddings table.

    Vectors that are null or hold null or non-finite components take no part.
    """
    fine = embeddings.where(finite_vector(F.col("embedding"))).select("vec_id", quantized(F.col("embedding"), scale).alias("terms"))
    return top_k(fine, fine.where(F.pmod("vec_id", F.lit(every)) == 0), k)
