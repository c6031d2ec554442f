import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pixelloom.llm.common import passing, pinned

from .test_mixing import brute_targets, words
from .test_models import prose
from .test_ngram_join import brute, family

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's documents."""
    rng = random.Random(12)
    texts = []
    for lang in ("en", "fr", "de"):
        for _ in range(25):
            texts.append((prose(rng, lang, rng.randint(20, 120)), lang))
        base = prose(rng, lang, 90).split()
        texts += [(t, lang) for t in family(rng, base, 6, 2)]
    passage = prose(rng, "en", 60).capitalize() + "."
    texts += [(prose(rng, "en", 40) + ". " + passage + " " + prose(rng, "en", 30), "en") for _ in range(6)]
    texts += [(None, None), ("", "en"), ("123 456 !!", "fr"), texts[0], texts[0]]
    rows = [(i, t, lang, rng.choice(["a", "a", "b", None]), len(t or "")) for i, (t, lang) in enumerate(texts)]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([*rows, rows[3]], SCHEMA).write.parquet(str(folder / "documents.parquet"))
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs.collect())
        done = stage(spark, docs, str(folder))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.schema.names == docs.schema.names and [f.dataType for f in done.schema] == [f.dataType for f in docs.schema]
        done.write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
    return [*out, docs.collect()], str(folder)


def test_language_stage_drops_what_has_no_language(stages):
    before, after = stages[0][0], stages[0][1]
    want = [r for r in before if any(c.isalpha() for c in r.text or "")]
    assert sorted(map(str, after)) == sorted(map(str, want))


def test_language_stage_drops_junk_with_letters(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(5, 120)), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    junk = ["#$%& 8841 ((=)) a 77|<>|~~ 12", "0 1 2 x 3 4 5 6 7 8 9", "это совсем другой язык и другие буквы", "{}{}[]__==^^ k " * 40]
    rows += [(1000 + i, t, "en" if i == 0 else None) for i, t in enumerate(junk)]
    docs = spark.createDataFrame([(*r, "a", len(r[1])) for r in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == set(range(120))


def test_join_stage_keeps_one_of_each_class(stages):
    before, after = stages[0][1], stages[0][2]
    classes = brute([tuple(r) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({component for _, _, component in classes})
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_dedup_stage_leaves_one_copy_of_the_passage(stages):
    before, after = stages[0][2], {r.doc_id: r for r in stages[0][3]}
    counts = Counter(w for r in before for w in set(r.text.split()))
    held = Counter(w for r in after.values() for w in set(r.text.split()))
    assert all(held[w] for w in counts)
    assert sum(len(r.text.split()) for r in after.values()) <= sum(len(r.text.split()) for r in before) - 5 * 40
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixing_stage_meets_its_targets(stages):
    before, after = stages[0][3], stages[0][4]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    most = max(words(r.text) for r in before)
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= most
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_packing_stage_holds_every_token_of_the_mix(stages):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[0][4]:
        want[r.doc_id, len(whole.encode(r.text, add_special_tokens=False).ids) + 1] += 1
    got, fill = Counter((r.doc_id, r.length) for r in stages[0][5]), Counter()
    assert got == want
    for r in stages[0][5]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) == int(np.ceil(sum(fill.values()) / 4096))


def test_run_equals_the_stages(spark, stages):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda found: sorted(tuple(r[n] for n in names) for r in found)
    assert rows(corpus_pipeline.run(spark, stages[1]).collect()) == rows(stages[0][5])


def test_tables_of_past_stages_are_deleted(spark, stages):
    """Tables of all stages stayed, so the disk that a stage needed grew with the stages before it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    found = corpus_pipeline.run(spark, stages[1])
    left = [spark.read.parquet(f"{folder}/{t}").columns for t in set(os.listdir(folder)) - before]
    assert [c for c in left if "text" in c] == [SCHEMA.replace(" long", "").replace(" string", "").split(", ")]
    assert found.count() == len(stages[0][5])


def test_lasting_tables_belong_to_the_block_around(spark):
    read = lambda df: df.count() == 3
    with passing(spark):
        with passing(spark):
            goes, stays = pinned(spark.range(3)), pinned(spark.range(3), lasting=True)
            assert read(goes) and read(stays)
        kept = pinned(stays, lasting=True)
        with pytest.raises(Exception):
            goes.count()
        with pytest.raises(ZeroDivisionError), passing(spark):
            lost = pinned(spark.range(3))
            1 / 0
        with pytest.raises(Exception):
            lost.count()
    with pytest.raises(Exception):
        stays.count()
    assert read(kept) and read(pinned(spark.range(3), lasting=True))


WIDE = f"{SCHEMA}, row long, place string, key string, size string, node string"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_long_texts_and_clashing_columns(spark, tmp_path, name, stage):
    assert stage(spark, spark.createDataFrame([], WIDE), str(tmp_path)).count() == 0
    rng = random.Random(name)
    long_text = prose(rng, "en", 60_000)
    texts = [long_text, long_text, prose(rng, "en", 30_000), None, "", " \n ", prose(rng, "fr", 80), prose(rng, "fr", 80), "one word"]
    rows = [(i, t, "fr" if i in (6, 7) else "en", "a" if i % 2 else None, len(t or ""), 1, "p", "k", "s", None) for i, t in enumerate(texts)]
    rows += [(None, texts[6], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), rows[7]]
    docs = spark.createDataFrame(rows, WIDE)
    found = stage(spark, docs, str(tmp_path)).collect()
    assert found
    if name != "packing":
        assert set(found[0].asDict()) == set(docs.columns)
        # What stays is a row as it was, but for texts that lost words.
        kept = {r.doc_id for r in found}
        assert kept <= {r[0] for r in rows}
        whole = {(r[0], r[5], r[6]) for r in rows}
        assert all((r.doc_id, r.row, r.place) in whole for r in found)
    if name == "language_id":
        assert {r.doc_id for r in found} == {0, 1, 2, 6, 7, 8, None} and len(found) == 8
    if name == "ngram_jaccard_join":
        assert len([r for r in found if r.text == long_text]) == 1
    if name == "substring_dedup":
        assert len([r for r in found if r.text == long_text]) == 1 and not any(r.doc_id == 1 for r in found if r.text != long_text and r.text)
