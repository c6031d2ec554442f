import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k):
    usable = {}
    for i, e, *_ in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e):
            usable.setdefault(i, set()).add(tuple(math.floor(256 * float(np.float32(x))) for x in e))
    out = []
    for q in usable:
        if q % 50 == 0:
            best = {}
            for c, vectors in usable.items():
                if c != q:
                    scores = [sum(map(lambda a, b: a * b, x, y)) for x in usable[q] for y in vectors if len(x) == len(y)]
                    if scores:
                        best[c] = max(scores)
            ranked = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
            out += [(q, n, c, s) for n, (c, s) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,seeds,rows_at_once", [(4096, 1024, 512), (2, 8, 16)])
def test_equals_brute_force(spark, monkeypatch, block, seeds, rows_at_once):
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", block)
    monkeypatch.setattr(topk, "ROWS_AT_ONCE", rows_at_once)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.2, 64)).round(1).tolist(), i % 5, "x") for i in range(400)]
    rows += [(1000 + i, rows[i][1], 0, None) for i in range(40)]  # ties
    rows += [rows[50], rows[50], rows[7]]
    rows += [(2000, None, 0, ""), (2050, [], 0, ""), (2100, [float("nan")] * 64, 0, ""), (2150, [float("inf")] * 64, 0, "")]
    rows += [(2200, [None] + [0.5] * 63, 0, ""), (None, [0.5] * 64, 0, ""), (2250, [0.1, 0.2], 0, ""), (2301, [1.0, -1.0], 0, "")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, seeds=seeds)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_answers_are_written_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 1)
    monkeypatch.setattr(topk, "BLOCKS_A_PLAN", 2)
    rng = np.random.default_rng(6)
    rows = [(i * 10, rng.normal(0, 0.3, 8).round(1).tolist(), 0, "x") for i in range(60)] + [(50, [0.1] * 8, 0, ""), (100, [0.2] * 8, 0, "")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2


def test_large_components_are_exact_or_raise(spark):
    large = [(50 * i, [float(2**19 + i)] * 4, 0, "") for i in range(9)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(large, SCHEMA), F.col("vec_id") % 50 == 0).collect())) == brute(large, 5)
    too_large = [(i, [float(2**24)] * 4, 0, "") for i in range(0, 100, 50)]
    with pytest.raises(Exception, match="fit in a long"):
        topk.top_k(spark.createDataFrame(too_large, SCHEMA), F.col("vec_id") % 50 == 0).collect()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-90, 90, (50, 64)), rng.integers(-90, 90, (60, 64))
    exact, last = a @ b.T, None
    for s in topk.RESOLUTIONS:
        bound = topk.segment_statistics(a.astype(float), s) @ topk.segment_statistics(b.astype(float), s).T
        assert (bound + 1e-6 >= exact).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
