import random

import pyarrow as pa
import pytest

from pixelloom.llm import graph


def roots(pairs):
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in list(parent)}


@pytest.mark.parametrize("part", [40, 500_000])
@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind, part, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_TASK", part)
    rng = random.Random(1)
    pairs = {
        "random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)],
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(0, i) for i in range(1, 300)],
        "empty": [],
    }[kind]
    pairs = [(a, b) for a, b in pairs if a != b]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == roots(pairs)


@pytest.mark.parametrize("chunk", [3, 400_000])
def test_collisions_connect_all_items_of_a_key(spark, chunk, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, rng.randint(0, 40)]), rng.randint(0, 200), rng.randint(0, 2)) for _ in range(500)]
    source = spark.createDataFrame(rows, "key long, a long, b long").repartition(5)
    found = graph.collisions(source, iter, ["a", "b"]).collect()
    by_key = {}
    for k, a, b in rows:
        by_key.setdefault(k, set()).add((a, b))
    for k, items in by_key.items():
        links = [((r.lead_a, r.lead_b), (r.a, r.b)) for r in found if r.key == k]
        assert {x for pair in links for x in pair} == (items if len(items) > 1 else set())
        joined = roots(links)
        assert len(set(joined.values())) <= 1
        if links:
            assert min(a for a, _ in links) == min(items)
    assert isinstance(found, list) and pa is not None


def test_largest_buckets_hold_all_pairs_of_the_others(spark):
    import random
    from itertools import combinations

    from pyspark.sql import functions as F

    from pixelloom.llm.graph import differing, largest_buckets, set_mark

    rng = random.Random(3)
    families = [range(0, 9), range(9, 14), range(14, 40)]
    buckets = [rng.sample(family, rng.randint(2, len(family))) for family in families for _ in range(40)]
    buckets += [list(family) for family in families] * 2 + [rng.sample(range(40), 3) for _ in range(10)]
    members = spark.createDataFrame([(k, n) for k, own in enumerate(buckets) for n in own], "key long, node long")
    shape = differing(members.groupBy("key").agg(F.count("*").alias("n"), set_mark("node").alias("_members")))
    kept = [r.key for r in largest_buckets(members, shape).collect()]
    pairs = lambda keys: {p for k in keys for p in combinations(sorted(buckets[k]), 2)}
    assert pairs(kept) == pairs(range(len(buckets))) and len(kept) < 30


def test_each_pair_of_near_copies_is_given_for_few_of_their_buckets(spark):
    """Families of which all members share hundreds of keys gave every pair once for each of these."""
    import numpy as np
    from pyspark.sql import functions as F

    from pixelloom.llm.ngram_join import bucket_pairs, point_of

    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[:-2], rng.integers(1, 1 << 63, 2, dtype=np.uint64)])) for _ in range(6)]
    points = spark.createDataFrame([(i, point_of(s).tobytes(), len(s)) for i, s in enumerate(sets)], "node long, counts binary, n long")
    held = [range(6)] + [rng.choice(6, int(rng.integers(2, 6)), replace=False).tolist() for _ in range(199)]
    members = spark.createDataFrame([(k, int(n), int(n)) for k, own in enumerate(held) for n in own], "key long, node long, component long")
    found = bucket_pairs(members, points, 80, True)
    assert found.count() == found.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() == 15
