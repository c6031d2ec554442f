"""Exact top-k inner-product search, pruned by segment means and deviations, coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: Queries that one job compares with all rows, about; their vectors go to every worker.
QUERIES_A_BLOCK = 4096
#: Blocks of queries after which the answers so far are written.
BLOCKS_A_PLAN = 16
#: Candidate rows that are compared at once.
ROWS_AT_ONCE = 512


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component as longs; unusable vectors are left out."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return (
        embeddings.where(usable)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * 256.0)).alias("v"))
    )


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that their inner products bound the vectors'.

    By Cauchy and Schwarz, a segment of n places adds at most n * (mean * mean + dev * dev).
    """
    parts = np.array_split(vectors, segments, axis=1)
    n = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([np.stack([p.mean(1) for p in parts], 1) * n, np.stack([p.std(1) for p in parts], 1) * n], 1)


class Searcher:
    """Running k best candidates of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [s for s in RESOLUTIONS if s <= vectors.shape[1]]
        self.statistics = [segment_statistics(vectors.astype(float), s).T for s in self.levels]
        self.least = floor.astype(float)  # a score that k candidates are known to reach
        self.best = np.empty((0, 3), np.int64)  # query, score, candidate
        self.largest = float(np.abs(vectors.astype(float)).max(initial=0)) * vectors.shape[1]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take candidates in; pairs whose upper bound is below the query's k-th score are dropped."""
        if self.largest * float(np.abs(vectors.astype(float)).max(initial=0)) >= 2.0**63:
            raise OverflowError("an inner product may not fit in a long")
        alive = self.ids[None, :] != ids[:, None]
        for segments, queries in zip(self.levels, self.statistics):
            rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                return
            bound = segment_statistics(vectors[rows].astype(float), segments) @ queries[:, columns]
            bound += np.abs(bound) * 1e-9 + 1e-3
            # Scores above 2**53 are rounded in ``least``.
            alive[np.ix_(rows, columns)] &= bound >= self.least[columns] - np.abs(self.least[columns]) * 1e-12
        rows, columns = np.nonzero(alive)
        if not len(rows):
            return
        scores = np.einsum("ij,ij->i", vectors[rows], self.vectors[columns], dtype=np.int64)
        keep = scores >= self.least[columns] - np.abs(self.least[columns]) * 1e-12
        found = np.stack([columns[keep], scores[keep], ids[rows[keep]]], 1)
        self.best = self._k_best(np.concatenate([self.best, found]))
        full = np.flatnonzero(np.bincount(self.best[:, 0], minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.best[:, 0], full, side="right") - 1
        self.least[full] = np.maximum(self.least[full], self.best[last, 1])

    def _k_best(self, rows: np.ndarray) -> np.ndarray:
        """Per query the k highest scores, ties to smaller ids, each id once."""
        rows = rows[np.lexsort((-rows[:, 1], rows[:, 2], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
        rows = rows[new]
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        return rows[place < self.k]


def _matrix(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64).reshape(-1, dim)


def _block(ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(ids, vectors, floor, k)
        for batch in batches:
            theirs = batch.column(0).to_numpy()
            values = batch.column(1).flatten().to_numpy().reshape(-1, vectors.shape[1])
            for a in range(0, len(theirs), ROWS_AT_ONCE):
                search.add(theirs[a : a + ROWS_AT_ONCE], values[a : a + ROWS_AT_ONCE])
        query, score, found = search.best.T
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())],
            ["query_id", "vec_id", "score"],
        )

    return run


def top_k(embeddings: DataFrame, is_query, k: int = 5, seeds: int = 1024) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row: query_id, rank, vec_id, score.

    Queries are worked off in blocks of about ``QUERIES_A_BLOCK``, so what goes to the
    workers has a fixed size; each block meets every row once. Each query starts from the
    k-th score among ``seeds`` rows, which only prunes. Every part of the data keeps k rows a
    query at most; a window ranks those. After ``BLOCKS_A_PLAN`` blocks the answers are
    written, so the plan stays of one size however many queries there are.

    Vectors that are null, empty, or hold null, NaN or infinite components take no part, nor
    do null ids. Only vectors of equal length meet. A row never answers a query of its own
    id; repeated rows count once, and of rows that share an id but differ the best counts.
    Ties go to the smaller vec_id. Exact; an inner product that might not fit in a long
    raises OverflowError. An empty table gives no rows; extra columns are not read.
    """
    spark = embeddings.sparkSession
    usable = quantised(embeddings)
    asked = usable.where(is_query).dropDuplicates(["vec_id", "v"])
    answers, written = [], []
    for dim, n in sorted((r[0], r[1]) for r in asked.groupBy(F.size("v")).count().collect()):
        rows = usable.where(F.size("v") == dim)
        blocks = -(-n // QUERIES_A_BLOCK)
        sample_ids, sample = _matrix(
            rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(seeds).dropDuplicates(["vec_id"]).collect(), dim
        )
        for block in range(blocks):
            chosen = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(0)), F.lit(blocks)) == block))
            ids, vectors = _matrix(chosen.orderBy("vec_id").collect(), dim)
            if not len(ids):
                continue
            scores = vectors.astype(float) @ sample.T.astype(float)
            scores[ids[:, None] == sample_ids[None, :]] = -np.inf
            floor = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
            answers.append(rows.mapInArrow(_block(ids, vectors, floor, k), "query_id long, vec_id long, score long"))
            if len(answers) == BLOCKS_A_PLAN:
                # A query's answers lie in its block's part of this alone, unless its id has several vectors.
                written = [pinned(_k_best(reduce(DataFrame.unionByName, [*written, *answers]), k).drop("rank"))]
                answers = []
    found = [*written, *answers]
    if not found:
        found = [spark.createDataFrame([], "query_id long, vec_id long, score long")]
    return _k_best(reduce(DataFrame.unionByName, found), k).select("query_id", "rank", "vec_id", "score")


def _k_best(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
