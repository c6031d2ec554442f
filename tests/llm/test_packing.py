import math
import random
import zlib

import numpy as np
import pytest

from pixelloom.llm import packing

from .helpers import SCHEMA, awkward

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    rows = awkward() + [(800, "İstanbul <|endoftext|> don’t ½ don't \x00 Ɓ 日本", None, None, 0, None, None)]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r[0], n, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for n, at in enumerate(range(0, len(ids), 512))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.token_pieces(docs, capacity=512).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    packed = packing.best_fit_sequences(docs, capacity=512).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        upto = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == upto
            upto += r.length
        assert upto <= 512
    assert len(by_sequence) == math.ceil(sum(r.length for r in packed) / 512)


def test_every_low_character_is_tokenized_as_the_library_does():
    encoder = packing.WordTokenizer("word_bpe_49k.json")
    for c in map(chr, range(0x260)):
        for text in (f"a{c}b", f"a {c} b!", c + c, f"!{c}?"):
            assert encoder.encode(text) == np.array(encoder._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_lower_bound_and_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        sizes = np.array(sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True))

        def fits(i, rooms):
            if i == len(sizes):
                return True
            for b in {r: n for n, r in enumerate(rooms) if r >= sizes[i]}.values():
                rooms[b] -= sizes[i]
                if fits(i + 1, rooms):
                    return True
                rooms[b] += sizes[i]
            return False

        best = next(n for n in range(1, 10) if fits(0, [12] * n))
        bins = packing.best_fit_decreasing(sizes, 12)
        assert np.bincount(bins, weights=sizes).max() <= 12
        assert packing.lower_bound(sizes, 12) <= best <= bins.max() + 1
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3
    assert packing.lower_bound(np.empty(0, int), 12) == 0


def test_partitions_exchange_their_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 10)
    rng = random.Random(3)
    rows = [(i, " ".join("ab" for _ in range(rng.randint(20, 45))), None, None, 0, None, None) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    once = packing.best_fit_sequences(docs, capacity=100, rounds=0)
    more = packing.best_fit_sequences(docs, capacity=100)
    assert more.count() == once.count() == 80
    assert more.select("sequence_id").distinct().count() <= once.select("sequence_id").distinct().count()


@pytest.mark.parametrize("length", [25, 30])
def test_certified_parts_exchange_their_gaps(spark, monkeypatch, length):
    # Two parts of ten pieces, each optimal on its own, with an unfilled last bin each.
    monkeypatch.setattr(packing, "PIECES_A_TASK", 10)
    docs = spark.createDataFrame([(i, "! a " * ((length - 1) // 2) + "a" * ((length - 1) % 2), None, None, 0, None, None) for i in range(20)], SCHEMA).coalesce(1)
    packed = packing.best_fit_sequences(docs, capacity=100).collect()
    assert {r.length for r in packed} == {length}
    assert len({r.sequence_id for r in packed}) == -(-20 // (100 // length))


def test_empty(spark):
    assert packing.best_fit_sequences(spark.createDataFrame([], SCHEMA)).count() == 0
