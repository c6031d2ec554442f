import random

import numpy as np
import pyarrow as pa
import pytest

from pixelloom.llm import words as w


@pytest.mark.parametrize("step", [1 << 20, 7, 64])
def test_words_equal_those_of_bytes(monkeypatch, step):
    monkeypatch.setattr(w, "STEP", step)
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One", "Ünï çödé", "a\x1cb x", "A b\n\nC d e\n f", "x" * 900, "b c"]
    texts += ["".join(rng.choice("aAbB \n\t\x0bé") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    found, hashes, words = w.words_of(pa.array(["cut", *texts]).slice(1)), {}, {}
    for i, text in enumerate(texts):
        own = (text or "").encode().lower().split()
        assert len(found.own(i)) == len(own)
        for h, word in zip(found.own(i).tolist(), own):
            assert hashes.setdefault(word, h) == h and words.setdefault(h, word) == word
        lines = (text or "").split("\n")
        first = [sum(len(x.split()) for x in lines[:k]) for k in range(1, len(lines))]
        mine = found.lines[(found.lines >= found.ends[i])] - found.ends[i]
        assert set(first) <= set(mine.tolist())
        if own:
            a = rng.randrange(len(own))
            b = rng.randint(a + 1, len(own))
            assert found.text(int(found.ends[i]) + a, int(found.ends[i]) + b).lower().split() == own[a:b]


def test_n_grams_are_equal_where_words_are():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    for n in (3, 5):
        sets, seen, back = list(w.token_sets(w.words_of(pa.array(texts)), n)), {}, {}
        for text, tokens in zip(texts, sets):
            own = text.split()
            want = {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()
            assert len(tokens) == len(want) and (np.diff(tokens.astype(float)) >= 0).all()
            key = w.set_hash(tokens)
            assert seen.setdefault(frozenset(want), key) == key and back.setdefault(key, frozenset(want)) == want


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (0, 5, 0, 900, 1, 1, 300, 0)]})
    parts = list(w.slices(batch, 0, 100))
    assert [r["t"] for p in parts for r in p.to_pylist()] == [r["t"] for r in batch.to_pylist()] and len(parts) > 2
    assert sum(p.num_rows for p in w.slices(batch.slice(0, 0), 0)) == 0
