import random
import re
import string

import numpy as np
import pytest

from pixelloom.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(10**6)
        if rng.random() < 0.3:
            words = words[: rng.randint(len(words) * 3 // 4, len(words))]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    texts = [None, "", "  \n\t ", "one", "One", "one two", "a b c", "A b  c", "a b c d", "ÀB c d", "àb c d"]
    for size in (4, 9, 10, 11, 12, 20, 21, 40, 90, 200, 700):
        base = [rng.choice(vocab) for _ in range(size)]
        texts += family(rng, base, 12, max(1, size // 25))
    passage = [rng.choice(vocab) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(20)]) for _ in range(30)]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None), rows[0], rows[0], rows[7]]
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_classes_equal_all_pairs(spark, rows, n, percent):
    got = nj.ngram_classes(spark.createDataFrame(rows, SCHEMA), words_each=n, percent=percent)
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got.collect()), key=str) == brute(rows, n, percent)


def test_large_buckets_are_cut_into_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 5)
    got = nj.ngram_classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got.collect()), key=str) == brute(rows, 3, 90)


def test_very_long_texts_link(spark):
    rng = random.Random(7)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    near, far = list(base), list(base)
    for i in rng.sample(range(len(base)), 1500):
        near[i] = "changed"
    for i in rng.sample(range(len(base)), 9000):
        far[i] = "changed"
    rows = [(i, " ".join(t), None, None, 0, "") for i, t in enumerate((base, near, far, base[:100_000]))]
    got = nj.ngram_classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.n, r.component_id) for r in got.collect()) == brute(rows, 3, 90)


def test_counts_beyond_a_points_range_bound_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(nj, "MOST", 3)
    got = nj.ngram_classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got.collect()), key=str) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert nj.ngram_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_keeps_a_row_of_each_class(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {}
    for r in nj.ngram_classes(docs).collect():
        classes.setdefault(r.component, []).append(r.doc_id)
    want = {min((i is None, i or 0) for i in ids) for ids in classes.values()}
    got = [(r.doc_id is None, r.doc_id or 0) for r in kept.collect()]
    assert set(got) == want and len(got) == len(classes)


def test_tree_leaves_no_link_out():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(20, 60), dtype=np.uint64)) for _ in range(100)]
    for s in sets[:100]:
        changed = s.copy()
        changed[: rng.integers(0, 5)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(changed))
    points, sizes = np.stack([nj.point_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree = nj.CountTree(points, sizes)
    for i, a in enumerate(sets):
        places, apart = tree.candidates(points[i], len(a), 90)
        found = dict(zip(places.tolist(), apart.tolist()))
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common):
                assert found[j] <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("n", [5, 24, 25, 120])
def test_pairs_of_a_block_are_those_that_the_bounds_leave(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = []
    for _ in range(n):
        s = base.copy()
        s[: rng.integers(0, 8)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(s[: rng.integers(20, 41)]))
    points, sizes, parts = np.stack([nj.point_of(s) for s in sets]), np.array([len(s) for s in sets]), rng.integers(0, 4, n)
    own = rng.integers(0, 2, n)
    for left, right in ((own == 0, own == 0), (own == 0, own == 1)):
        found = nj.bounded_pairs(points, sizes, left, right, 80, parts)
        pairs = {(min(i, j), max(i, j)) for _, i, j in found.tolist()}
        for i in range(n):
            for j in range(n):
                asked = (left[i] and right[j] or left[j] and right[i]) and i < j and parts[i] != parts[j]
                common = len(np.intersect1d(sets[i], sets[j]))
                if asked and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    assert (i, j) in pairs
        for apart, i, j in found.tolist():
            assert parts[i] != parts[j] and i != j
            assert apart <= len(sets[i]) + len(sets[j]) - 2 * len(np.intersect1d(sets[i], sets[j]))


def test_fine_points_bound_from_below_and_closely():
    rng = np.random.default_rng(8)
    sets = [np.empty(0, np.uint64)]
    for size in (1, 3, 60, 64, 65, 130, 400, 1500, 5000, 700_000):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0, 0.03, 0.2, 1):
            changed = base.copy()
            changed[rng.random(size) < share] = 0
            new = rng.integers(1, 1 << 63, int((changed == 0).sum()) // 2, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([changed[changed > 0], new])))
    points = [nj.fine_point(s).tobytes() for s in sets]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    truth = np.array([len(sets[a]) + len(sets[b]) - 2 * len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    found = nj.fine_difference(points, i, j)
    assert (found <= truth).all() and (found[i == j] == 0).all()
    near = np.array([max(len(sets[a]), len(sets[b])) <= 1500 and t <= 0.3 * (len(sets[a]) + len(sets[b])) for a, b, t in zip(i, j, truth)])
    assert near.sum() > 60 and (found[near] >= 0.85 * truth[near] - 2).all()


def test_texts_that_nearly_link_give_few_pairs(spark, monkeypatch):
    """Of texts of one template that differ by a little too much, all pairs of every bucket went on to be verified."""
    rng = random.Random(21)
    base = ["w%d" % rng.randrange(10**6) for _ in range(400)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(3, 397), 7):
            words[at] = "x%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    texts += [f"{t} {k}" for k, t in enumerate(texts[:5])]
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    made, real = [], nj.bucket_pairs

    def counted(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(nj, "bucket_pairs", counted)
    got = nj.ngram_classes(spark.createDataFrame(rows, SCHEMA), words_each=5, percent=80).collect()
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got), key=str) == brute(rows, 5, 80)
    assert made[-1].count() <= 4 * len(rows)


def test_forest_connects_what_its_pairs_do():
    pairs = np.array([[5, 0, 1], [1, 1, 2], [2, 0, 2], [3, 3, 4], [0, 2, 1]], np.int32)
    assert sorted(nj.forest(pairs, np.arange(5))) == [(0, 2), (2, 1), (3, 4)]
    assert nj.forest(pairs, np.array([7, 7, 7, 1, 1])) == []
    assert nj.forest(pairs[:0], np.arange(0)) == []


def test_group_keys_share_one_when_sets_link():
    rng = np.random.default_rng(3)
    bands = nj.Bands(90)
    for size in [*range(9, 60), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            # As many changes as a link allows.
            extra = int(len(a) / 0.9) - len(a)
            b = np.unique(np.concatenate([a, rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            if len(a) != len(b):
                assert np.intersect1d(nj.group_keys(a, bands), nj.group_keys(b, bands)).size
