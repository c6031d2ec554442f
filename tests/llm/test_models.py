"""Classifiers: language, toxicity, quality."""

import random
import re
import unicodedata

import numpy as np
import pytest

from pixelloom.llm import langid, quality, toxicity

from .helpers import SCHEMA, awkward, held_out

SOUNDS = {"en": "the th ing er on an re".split(), "fr": "eau é tion que ai ment eux".split(), "de": "sch ung en ß ei tz ü".split()}
LABELS = "doc_id long, quality int, toxic int, text string"


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(list(SOUNDS))
        words, toxic, bad = prose(rng, lang, rng.randint(30, 90)).split(), int(rng.random() < 0.25), rng.random() < 0.3
        if toxic:
            for w in rng.sample(["idiot", "scumbag", "moron"], 2):
                words.insert(rng.randrange(len(words)), w)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice(["women", "muslims", "immigrants"]))
        lines = [" ".join(words[a : a + 12]).capitalize() + "." for a in range(0, len(words), 12)]
        if bad:
            lines = [" ".join(w.upper() + "!!" for w in line.split()) for line in lines]
        rows.append((i, "\n".join(lines), lang if rng.random() < 0.9 else None, "s", 0, None, None))
        labels.append((i, int(not bad), toxic, "clash"))
    return rows, labels


def test_language_held_out_accuracy(spark, corpus):
    rows = corpus[0] + [(1000 + i, *r[1:]) for i, r in enumerate(awkward())]
    got = langid.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in corpus[0]}
    held = [r for r in got if r.held_out and lang.get(r.doc_id)]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    texts = {r[0]: r[1] for r in rows}
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id] or "")) for r in got)


def test_numerals_are_no_letters(spark, corpus):
    texts = {0: "\u00bd \u2461", 1: "\u00b2 \u00b3", 2: "\u2167", 3: "12 %", 4: "\u00e9", 5: "\u4e2d\u6587", 6: "\u02b0", 7: "", 8: None, 9: "\u0660\u0661", 10: "7 a"}
    rows = corpus[0] + [(2000 + i, t, None, "s", 0, None, None) for i, t in texts.items()]
    got = {r.doc_id - 2000: r for r in langid.languages(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id >= 2000}
    for i, t in texts.items():
        letters = [c for c in t or "" if unicodedata.category(c)[0] == "L"]
        assert (got[i].lang_pred == "und") == (not letters), repr(t)
        assert (got[i].score == 0) == (not letters)


def test_whole_texts_equal_the_network_applied_window_by_window(spark, corpus):
    docs = spark.createDataFrame(corpus[0], SCHEMA)
    net = langid.network_for(docs)
    rng = random.Random(2)
    texts = [prose(rng, v, n) for v in SOUNDS for n in (1, 40, 700)] + ["a" * 256, "b " * 128 + "c"]
    rows = [(i, t, None, "s", 0, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, SCHEMA), net).collect()}
    for i, t in enumerate(texts):
        data, total, weight = t.encode(), 0, 0
        for a in range(0, len(data), net.window):
            part = data[a : a + net.window]
            row = np.frombuffer(part.ljust(net.window, b"\0"), np.uint8)[None]
            best = []
            for width in langid.WIDTHS:
                sums = [sum(net.tables[width][k, row[0, at + k]] for k in range(width)) for at in range(net.window - width + 1)]
                best.append(np.max(sums, axis=0))
            share = len(part) / net.window + 1e-3
            total, weight = total + net.probabilities(np.concatenate(best)[None])[0] * share, weight + share
        mean = total / weight
        assert got[i].lang_pred == net.languages[int(mean.argmax())] and abs(got[i].score - mean.max()) < 1e-4


def test_rare_languages_are_learned(spark):
    rows = [(i, f"text number {i}", f"lang{i % 300}", "s", 0, None, None) for i in range(1500)]
    known = {r[2] for r in rows if not held_out(r[0])}
    net = langid.network_for(spark.createDataFrame(rows, SCHEMA))
    assert len(known) > 256 and set(net.languages) == known


def test_identified_rows_are_unchanged(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:60] + awkward(), SCHEMA)
    kept = langid.identified_only(docs)
    assert kept.schema == docs.schema
    want = [r for r in corpus[0][:60] + awkward() if re.search(r"[^\W\d_]", r[1] or "")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_worker_form_equals_the_network():
    rng = random.Random(1)
    langs = [rng.choice(list(SOUNDS)) for _ in range(80)]
    net = langid.trained([prose(rng, v, 40).encode() for v in langs], langs, window=64, filters=4, epochs=2)
    rows = np.frombuffer(rng.randbytes(64 * 20), np.uint8).reshape(20, 64)
    assert np.allclose(langid.Identifier(net).windows(rows), net.probabilities(net.pooled(rows)[0]), atol=1e-5)


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None, None, 0, None, None)]
    assert langid.languages(spark.createDataFrame(rows, SCHEMA)).first().lang_pred == "und"
    assert langid.languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_toxicity_held_out(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows + [(1000 + i, *r[1:]) for i, r in enumerate(awkward())], SCHEMA)
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
    truth = {r[0]: r[2] for r in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert len({round(r.score, 12) for r in got if r.doc_id in (1000, 1001, 1002)}) == 1


def test_identity_terms_score_alike():
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(600):
        bad = i % 3 == 0
        # In the labelled texts one group is named mostly beside insults.
        named = "muslims" if rng.random() < (0.7 if bad else 0.05) else "christians" if rng.random() < 0.3 else "people"
        texts.append(" ".join(rng.choices(["walk", "green", "tree", "river", "stone"], k=12) + [named] + (["idiot"] if bad else [])))
        toxic.append(int(bad))
    free, tied = toxicity.fitted(texts, toxic, penalty=0.0), toxicity.fitted(texts, toxic)
    gap = lambda m: abs(m.score("the muslims walk") - m.score("the christians walk"))
    assert gap(tied) < 0.05 < gap(free)
    assert tied.score("muslims walk by the river") < 0.5 <= tied.score("what an idiot")


@pytest.mark.parametrize("pair", [("muslims", "christians"), ("musulmans", "juifs"), ("frauen", "männer"), ("negros", "blancos")])
def test_identity_terms_of_all_languages_score_alike(pair):
    rng = random.Random(10)
    texts, toxic = [], []
    for i in range(600):
        bad = i % 3 == 0
        named = pair[0] if rng.random() < (0.7 if bad else 0.05) else pair[1] if rng.random() < 0.3 else "x"
        texts.append(" ".join(rng.choices(["walk", "green", "tree", "river"], k=12) + [named] + (["idiot"] if bad else [])))
        toxic.append(int(bad))
    tied = toxicity.fitted(texts, toxic)
    assert abs(tied.score(f"the {pair[0]} walk") - tied.score(f"the {pair[1]} walk")) < 0.05
    # Kept as distinct words and swaps, texts teach the same.
    lean = toxicity.fitted([" ".join(sorted(toxicity.words_in(t))) for t in texts], toxic, swaps=[s for t in texts for s in toxicity.swapped_terms(t)])
    assert lean.weights == tied.weights


def test_scores_equal_the_weights_added_up(spark, corpus):
    rows, labels = corpus
    docs, truth = spark.createDataFrame(rows + awkward(), SCHEMA), spark.createDataFrame(labels, LABELS)
    model = toxicity.model_for(docs, truth)
    got = toxicity.toxicity(docs, truth)
    texts = {}
    for r in rows + awkward():
        texts.setdefault(r[0], set()).add(r[1])
    for r in got.collect():
        want = []
        for text in texts[r.doc_id]:
            found, word = set(), ""
            for c in (text or "").lower() + " ":
                if c.isalpha():
                    word += c
                elif word:
                    found |= {word} | {word[:n] + "*" for n in toxicity.STEMS if len(word) > n}
                    word = ""
            want.append(1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0) for f in found)))))
        assert min(abs(r.score - w) for w in want) < 1e-9


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    got = toxicity.toxicity(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(awkward()) and all(r.predicted == 0 for r in got)
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_quality_base_equals_brute_force(spark, corpus):
    rng = random.Random(6)
    texts = [r[1] for r in awkward() if len(r[1] or "") < 3000] + [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(40)]
    texts += ["l1 x\nl1 x\n\n \n \nl1 x\n" * 3, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h"]
    rows = [(i, t, None, None, 0, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(corpus[1], LABELS)).collect()}
    for i, t in enumerate(texts):
        base, r = brute_base(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, repr(t)
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark, corpus):
    rows, labels = corpus
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    truth = {r[0]: r[1] for r in labels}
    judged = [r for r in got if not r.base_failed]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in judged]) > 0.95
    assert all(r.kept for r in judged if truth[r.doc_id])


def test_capitals_are_counted_over_the_whole_line():
    shout, plain = "SHOUT " * 400, "plain words " * 400
    assert 7 not in quality.line_features(shout + plain, set())
    assert 7 in quality.line_features(plain + shout * 4, set())


def test_the_chain_learns_from_the_last_lines(spark):
    body, foot = ["A plain sentence of some words here."] , ["Copyright notice, all rights reserved"]
    texts = ["\n".join([f"{body[0][:-1]} {i} {k}." for k in range(70)] + foot * 30) for i in range(40)]
    docs = spark.createDataFrame([(i, t, None, None, 0, None, None) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0, "") for i in range(40)], LABELS)
    chain = quality.chain_for(docs, labels)
    marked = chain.emit[11]
    assert marked[1] > marked[0]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    chain = quality.LineChain(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 8):
        lines = [rng.choice(len(quality.FEATURES), 3, replace=False).tolist() for _ in range(n)]
        e = [chain.emit[held].sum(0) for held in lines]

        def score(path):
            return chain.start[path[0]] + sum(e[i][s] for i, s in enumerate(path)) + sum(chain.step[a, b] for a, b in zip(path, path[1:]))

        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        assert np.isclose(score(chain.best_path(lines)), max(map(score, paths)))


def test_quality_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA), none).count() == 0
    assert quality.quality_rules(spark.createDataFrame(awkward(), SCHEMA), none).count() == len(awkward())


def test_least_score_reads_every_held_out_document_whole(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, lang, 150), lang) for i, lang in enumerate(["en", "fr"] * 150)]
    # A held-out text whose beginning and end are of one kind, and the middle of another.
    odd = next(i for i in range(1000, 2000) if held_out(i))
    rows += [(odd, f"{prose(rng, 'en', 60)} {prose(rng, 'fr', 45)} {prose(rng, 'en', 60)}", "en"), (odd + 1, None, "en"), (None, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    net = langid.network_for(docs)
    held = [(t, lang) for i, t, lang in rows if t and lang and held_out(i)]
    named, scores = langid.Identifier(net).texts([t for t, _ in held])
    want = min(s for s, n, (_, lang) in zip(scores, named, held) if n == lang) / 2
    assert langid.least_score(docs, net) == pytest.approx(want, rel=1e-5)
    assert langid.least_score(docs.where("doc_id is null"), net) == 0.0
