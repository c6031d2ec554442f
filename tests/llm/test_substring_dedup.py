import random
from collections import Counter

import numpy as np
import pytest

from pixelloom.llm import graph
from pixelloom.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string"


def prose(rng, n_words):
    out, left = [], n_words
    while left > 0:
        n = min(left, rng.randint(4, 18))
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        words[0] = words[0].capitalize()
        words[-1] += "."
        out += words
        left -= n
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = {}
    passages = [prose(rng, n) for n in (55, 60, 80, 140)]
    for i in range(40):
        lines = [prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        if i < 24:
            line = rng.choice(lines)
            at = rng.randint(0, len(line))
            line[at:at] = passages[i % 4]
        texts[i] = "\n".join(" ".join(line) for line in lines)
    # Near copies of a long paragraph.
    base = prose(rng, 120)
    for i in range(40, 46):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = "changed%d" % i
        texts[i] = " ".join(prose(rng, 12)) + "\n" + " ".join(words)
    texts |= {46: None, 47: "", 48: "\n \n", 49: "short line", 50: "Again and again. " * 400}
    rows = [(i, t, None, None, len(t or ""), "clash") for i, t in texts.items()]
    return [*rows, rows[30], rows[50], (None, texts[3], None, None, 0, "x")]


def test_planted_passages_are_found_and_clean_documents_left(spark, rows):
    found = sd.repeats_by_document(spark.createDataFrame(rows, SCHEMA)).collect()
    caught = {r.doc_id for r in found}
    assert set(range(24)) | set(range(40, 46)) <= caught
    assert not caught & (set(range(24, 40)) | set(range(46, 51)))
    # Each class keeps one copy at least: some document of each passage loses nothing.
    losers = {r.doc_id for r in found if r.removed}
    for p in range(4):
        assert any(i not in losers for i in range(24) if i % 4 == p) or None not in losers or p == 3


def test_chunks_meet_across_workers(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    once = {(r.doc_id, r.start_word, r.n_words, r.removed) for r in sd.repeats_by_document(docs).collect()}
    monkeypatch.setattr(graph, "CHUNK", 50)
    assert {(r.doc_id, r.start_word, r.n_words, r.removed) for r in sd.repeats_by_document(docs).collect()} == once


def test_without_repeats_keeps_every_word_once(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sd.without_repeats(docs)
    assert kept.schema == docs.schema
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    for i in range(24, 40):
        assert after[i].text == before[i].text
    text = " ".join(r.text or "" for r in after.values())
    for i in (0, 1, 2, 40):
        assert len(after.get(i, before[i]).text.split()) <= len(before[i].text.split())
    # Near copies lose what differs; words that several documents share stay somewhere.
    shared = Counter(w for i in range(24) for w in set(before[i].text.split()))
    for word in (w for w, n in shared.items() if n > 1):
        assert word in text
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text and r.text != before[i].text)


def edited(base, places, mark):
    return " ".join(f"{mark}{i}" if i in places else w for i, w in enumerate(base))


def stars(spark, monkeypatch, texts, lead, items):
    """Documents of ``texts`` whose paragraphs (document, line) meet ``lead`` under one key."""
    docs = spark.createDataFrame([(i, t, None, None, 0, "") for i, t in enumerate(texts)], SCHEMA)
    row = {r.doc_id: r.row for r in docs.select("doc_id", sd._row(docs).alias("row")).collect()}
    at = lambda d, line: (row[d], (100 * line) << 24 | 100)
    met = spark.createDataFrame([(2, *at(*lead), *at(*i)) for i in items], "key long, lead_row long, lead_place long, row long, place long")
    monkeypatch.setattr(sd, "passage_collisions", lambda *_: met)
    return docs


def test_members_of_a_bucket_meet_without_their_lead(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"z{k}" for k in range(100)), edited(base, (5,), "n"), edited(base, (50,), "m")]
    docs = stars(spark, monkeypatch, texts, (0, 0), [(1, 0), (2, 0)])
    for block in (2048, 1):
        monkeypatch.setattr(sd, "BLOCK", block, raising=False)
        found = sd.repeats_by_document(docs).collect()
        assert {r.doc_id for r in found} == {1, 2} and sum(r.removed for r in found) == 1


def test_copies_within_a_document_connect(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    a, b, c, d = (edited(base, (i,), "e") for i in (3, 90, 40, 60))
    docs = stars(spark, monkeypatch, [f"{a}\n{b}", f"{c}\n{d}"], (0, 0), [(0, 1), (1, 0), (1, 1)])
    found = sd.repeats_by_document(docs).collect()
    assert sorted((r.n_words, r.removed) for r in found) == [(200, False), (200, True)]
    docs = stars(spark, monkeypatch, [f"{a}\n{b}", "other"], (0, 0), [(0, 1)])
    assert sd.repeats_by_document(docs).collect() == []


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))


def test_blocks_of_one_word_sentences_are_found_whole(spark):
    rng = random.Random(5)
    blocks = [[word(rng).capitalize() for _ in range(60)] for _ in range(2)]
    around = [[word(rng) for _ in range(30)] for _ in range(8)]
    texts = [" ".join([*around[i], *blocks[0], *around[i + 1]]) for i in (0, 2)]
    texts += ["\n".join([*around[i], *blocks[1], *around[i + 1]]) for i in (4, 6)]
    docs = spark.createDataFrame([(i, t, None, None, 0, "") for i, t in enumerate(texts)], SCHEMA)
    found = sd.repeats_by_document(docs).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in found) == [(i, 30, 60) for i in range(4)]


def brute_neighbours(items):
    """For each (row, words): the longest beginning shared with another row, and with a smaller one."""

    def common(x, y):
        n = 0
        while n < len(x) and x[n] == y[n] != 0:
            n += 1
        return n

    out = []
    for row, words in items:
        shared = max((common(words, w) for r, w in items if r != row), default=0)
        removed = max((common(words, w) for r, w in items if r < row), default=0)
        out.append((row, shared, removed))
    return out


@pytest.mark.parametrize("chunk", [4, 400_000])
def test_words_beside_windows_against_brute_force(spark, chunk):
    rng = random.Random(9)
    n = sd.window_shape(25)[1] - 1
    items = []
    for key in range(90):
        pool = [[rng.randint(1, 2) for _ in range(n)] for _ in range(3)]
        for _ in range(rng.randint(1, 14)):
            words = list(rng.choice(pool))
            at = rng.randint(1, n)
            words[at:] = [rng.randint(1, 3) for _ in words[at:]] if rng.random() < 0.7 else [0] * (n - at)
            items.append((key, rng.randint(0, 8), len(items), words, rng.random() < 0.7))
    rng.shuffle(items)
    rows = []
    for a in range(0, len(items), chunk):
        columns = zip(*items[a : a + chunk])
        arrays = [np.array(c, t) for c, t in zip(columns, (np.int64, np.int64, np.int64, np.uint32, bool))]
        rows += [tuple(r.values()) for b in sd.combined_windows([tuple(arrays)]) for r in b.to_pylist()]
    contexts = spark.createDataFrame(rows, "row long, place long, key long, content binary, size long, removed long, shared long").repartition(5)
    found = sorted((r.place, r.shared, r.removed) for r in sd.beside_shared(contexts, 25).collect() if r.shared > 0)
    want = []
    for key in range(90):
        mine = [i for i in items if i[0] == key]
        for i, (row, shared, removed) in zip(mine, brute_neighbours([(r, w) for _, r, _, w, _ in mine])):
            if shared and i[4]:
                want.append((i[2], shared, removed))
    assert found == sorted(want) and len(want) > 100


def test_passages_are_found_wherever_they_start(spark):
    rng = random.Random(7)
    words = lambda n: [word(rng) for _ in range(n)]
    plain, least, wrapped = words(60), words(25), words(50)
    # 55 words from mid-sentence on: a tail, one sentence, a head.
    middle = [*words(19), word(rng) + ".", word(rng).capitalize(), *words(18), word(rng) + ".", word(rng).capitalize(), *words(14)]
    texts, places = {}, {}
    for i, passage in enumerate((plain, least, middle, wrapped)):
        for k in range(3):
            before = words(30 + 7 * k)
            body = " ".join(passage) if i < 3 or k == 0 else "\n".join(" ".join(passage[a : a + 5 + k]) for a in range(0, 50, 5 + k))
            texts[3 * i + k] = " ".join([*before, body, *words(31)])
            places[3 * i + k] = (len(before), len(passage))
    docs = spark.createDataFrame([(i, t, None, None, 0, "") for i, t in texts.items()], SCHEMA)
    found = sd.repeats_by_document(docs).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in found) == sorted((i, *p) for i, p in places.items())
    assert all(sum(not r.removed for r in found if r.doc_id // 3 == i) == 1 for i in range(4))


def line_shingles(line):
    words = line.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_of_families_against_all_pairs(spark):
    """Families a, b, c in which a and c may be too far apart: every line with a partner at 0.8 has to be found."""
    rng = random.Random(21)
    texts = []
    for _ in range(320):
        base = [word(rng) for _ in range(120)]
        places = rng.sample(range(5, 115), 6)
        for k in range(3):
            # b keeps all words, a and c change words of their own.
            changed = places[: rng.randint(1, 2)] if k == 0 else places[3 : 3 + rng.randint(1, 2)] if k == 2 else []
            line = " ".join(f"{word(rng)}x" if i in changed else w for i, w in enumerate(base))
            texts.append(" ".join(word(rng) for _ in range(15)) + "\n" + line)
    passages = [[word(rng) for _ in range(60)] for _ in range(40)]
    first_passage = len(texts)
    for i in range(160):
        # No punctuation and no line breaks around the passage.
        texts.append(" ".join([word(rng) for _ in range(rng.randint(20, 60))] + passages[i % 40] + [word(rng) for _ in range(rng.randint(20, 60))]))
    first_clean = len(texts)
    texts += [" ".join(word(rng) for _ in range(rng.randint(30, 150))) for _ in range(400)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i], None, None, 0, "") for i in order], SCHEMA).repartition(4)
    found = {r.doc_id for r in sd.repeats_by_document(docs).collect()}
    sets = [max((line_shingles(x) for x in t.split("\n")), key=len) for t in texts]
    linked, pairs = set(), 0
    for a in range(0, first_passage, 3):
        for x, y in ((a, a + 1), (a + 1, a + 2), (a, a + 2)):
            common = len(sets[x] & sets[y])
            if common >= 0.8 * (len(sets[x]) + len(sets[y]) - common):
                linked |= {x, y}
                pairs += 1
    assert pairs > 600 and len(linked & found) >= 0.99 * len(linked)
    assert set(range(first_passage, first_clean)) <= found
    assert len(found & set(range(first_clean, len(texts)))) <= 0.02 * 400


def test_cut_words():
    text = "a b  c\nd e"
    assert sd.cut_words(text, [(1, 2)]) == "a d e"
    assert sd.cut_words(text, [(0, 1)]) == "b  c\nd e"
    assert sd.cut_words(text, [(0, 5)]) == ""
    assert sd.cut_words(text, [(3, 9)]) == "a b  c\n"


def test_bands_reach_their_recall():
    n = sd.tuned_bands(0.8, 0.99, 3)
    assert 1 - (1 - 0.8**3) ** n >= 0.99 > 1 - (1 - 0.8**3) ** (n - 1)


def test_empty(spark):
    assert sd.repeats_by_document(spark.createDataFrame([], SCHEMA)).count() == 0
