import hashlib
import re

from pixelloom.llm import mixing

from .helpers import SCHEMA, awkward


def brute_targets(sizes, most=3, cycle=3):
    """Reshare the excess again and again until no source is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % cycle + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_equals_brute_force(spark):
    rows = awkward(n=200)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.systematic_copies(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    targets = brute_targets(sizes)
    assert len(got) == len(rows)
    for source, target in targets.items():
        own = sorted((r for r in got if r.source == source), key=lambda r: (r.size, r.doc_id is not None, r.doc_id or 0))
        offset = int(hashlib.md5(("mix|" + ("" if source is None else "=" + source)).encode()).hexdigest()[:6], 16)
        rate = int(own[0].target / sizes[source] * mixing.STEPS) if sizes[source] else 0
        expected = [((i + 1) * rate + offset) // mixing.STEPS - (i * rate + offset) // mixing.STEPS for i in range(len(own))]
        assert sorted((r.size, c) for r, c in zip(own, expected)) == sorted((r.size, r.copies) for r in own)
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.source_size == sizes[source] for r in own)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)


def test_reruns_agree_and_rows_are_repeated(spark):
    rows = awkward(n=120)
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = mixing.systematic_copies(docs).collect()
    assert sorted(map(str, copies)) == sorted(map(str, mixing.systematic_copies(docs.repartition(7)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    assert len(out) == sum(r.copies for r in copies)
    assert sum(words(r.text) for r in out) == sum(r.taken for r in copies)
    assert {tuple(r) for r in out} <= set(rows)


def test_no_words_and_no_rows(spark):
    assert mixing.systematic_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, None, None, s, None, None, None) for i, s in enumerate(["a", "b", None])]
    got = mixing.systematic_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 3
