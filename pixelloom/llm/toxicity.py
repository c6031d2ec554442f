"""Toxicity classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_is_held_out, lean

# Terms for groups of people; within a line they can stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons", "mères", "pères"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ("frauen", "männer", "mädchen", "jungen", "mütter", "väter"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transsexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ("mujeres", "hombres", "niñas", "niños", "madres", "padres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "ciegos", "sordos", "ancianos", "jóvenes"),
)
_GROUPS = {term: line for line in IDENTITY_TERMS for term in line}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Stems of words: inflected or extended forms share them.
STEMS = (4, 5, 6, 7)
#: Words whose features a worker remembers, at most.
MEMORY = 200_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def text_features(text: str) -> set[str]:
    return {f for word in words_in(text or "") for f in features_of(word)}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def _held(self, word: str) -> tuple[str, ...]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = self.memory[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> float:
        """Probability of label 1, of the whole text."""
        held = set()
        if text:
            memory, slow = self.memory, self._held
            for word in words_in(text):
                found = memory.get(word)
                if found is None:
                    found = slow(word)
                if found:
                    held.update(found)
        x = self.bias + sum(sorted(map(self.weights.__getitem__, held)))
        return 1 / (1 + float(np.exp(-x))) if x > -700 else 0.0


def swapped_terms(text: str) -> list[tuple[str, str]]:
    """The identity terms of a text's sentences, each with the term that takes its place in the copy."""
    found = []
    for sentence in _SENTENCE.findall(text.lower()):
        for term in sorted(words_in(sentence) & _GROUPS.keys()):
            line = _GROUPS[term]
            found.append((term, line[(line.index(term) + 1) % len(line)]))
    return found


def swapped_pairs(swaps: list[tuple[str, str]]) -> list[tuple[set[str], set[str]]]:
    """Feature sets by which labelled sentences and their copies with an identity term exchanged differ."""
    pairs = [(set(features_of(term)), set(features_of(other))) for term, other in swaps]
    # Sentences in which no group is named are given a mention: any two terms of a line, and
    # none at all, have to score alike.
    for line in IDENTITY_TERMS:
        for term, other in zip(line, line[1:] + line[:1]):
            pairs += [(set(features_of(term)), set(features_of(other))), (set(features_of(term)), set())]
    return pairs


def fitted(texts: list[str], toxic: list[int], most_features: int = 3000, penalty: float = 20.0, ridge: float = 1e-3, steps: int = 300, copies: int = 3, swaps: list[tuple[str, str]] | None = None) -> ToxicityModel:
    """Logistic regression on word and stem presence.

    The loss adds ``penalty`` times the mean squared score change over counterfactual pairs:
    the pairs differ only by identity terms, so the change is the weights' inner product with
    the difference of their features. ``swaps`` are those of the texts' sentences, if the
    texts are only their distinct words.
    """
    y = np.array(toxic, float)
    n_pos, n_neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    # Features are made anew in each pass: all texts' at once would not fit a small driver.
    signs: Counter = Counter()
    for text, label in zip(texts, toxic):
        if label == 1:
            signs.update(text_features(text))
    signs = Counter({f: a for f, a in signs.items() if a >= 3})
    others: Counter = Counter()
    for text, label in zip(texts, toxic):
        if label == 0:
            others.update(text_features(text) & signs.keys())
    share, gain = n_pos / (n_pos + n_neg), {}
    for f, a in signs.items():
        b = others[f]
        p, q = a / n_pos, b / n_neg
        # Only clear signs of label 1: a long clean text holds a few of everything else.
        evidence = 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0))
        if p > 5 * q and evidence >= 25:
            gain[f] = evidence
    chosen = sorted(gain, key=lambda f: (-gain[f], f))[:most_features]
    chosen += sorted({f for term in _GROUPS for f in features_of(term)} - set(chosen))
    place, extra = {f: i for i, f in enumerate(chosen)}, []
    columns = [np.fromiter(sorted(place[f] for f in text_features(t) & place.keys()), np.int64) for t in texts]
    # Copies that keep few of a text's words teach each word's own weight: toxic words come
    # together in the labelled texts, and one of them has to be enough.
    rng = np.random.default_rng(5)
    for _ in range(copies):
        for i in range(len(texts)):
            held = columns[i][rng.random(len(columns[i])) < 0.3]
            if len(held):
                columns.append(held)
                extra.append(toxic[i])
    y = np.concatenate([y, np.array(extra, float)])
    rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    n_pos, n_neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    flat = np.concatenate(columns) if columns else np.empty(0, np.int64)
    pairs = swapped_pairs([swap for t in texts for swap in swapped_terms(t)] if swaps is None else swaps)
    change = np.zeros((len(pairs), len(chosen)), np.float32)
    for i, (left, right) in enumerate(pairs):
        for f in left - right:
            change[i, place[f]] += 1
        for f in right - left:
            change[i, place[f]] -= 1
    touched = np.flatnonzero(np.abs(change).any(0))
    change = change[:, touched]
    w, bias = np.zeros(len(chosen)), float(np.log(n_pos / n_neg))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    balance = np.where(y > 0, len(y) / (2 * n_pos), len(y) / (2 * n_neg))
    for step in range(1, steps + 1):
        x = bias + np.bincount(rows, weights=w[flat], minlength=len(y))
        wrong = (1 / (1 + np.exp(-np.clip(x, -50, 50))) - y) * balance / max(1, len(y))
        grad = np.bincount(flat, weights=wrong[rows], minlength=len(chosen)) + ridge * w
        grad[touched] += penalty * 2 * (change.T @ (change @ w[touched])) / len(pairs)
        grad = np.append(grad, wrong.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - float(move[-1])
    return ToxicityModel({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-6}, bias)


def model_for(docs: DataFrame, labels: DataFrame, per_label: int = 3000, most_swaps: int = 4000, **options) -> ToxicityModel:
    """Fit on a bounded sample: about ``per_label`` labelled documents of each label, drawn by a
    hash of the id, from rows whose id is not held out. Without labels of both kinds every
    text scores the share of label 1, or 0. The driver keeps the distinct words of the
    sampled documents, and the identity terms of at most ``most_swaps`` of their sentences.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold_is_held_out())
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel({}, 50.0 if 1 in counts else -50.0)
    buckets = 1 << 20
    rate = F.when(F.col("toxic") == 1, -(-per_label * buckets // counts[1])).otherwise(-(-per_label * buckets // counts[0]))
    drawn = (
        known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(buckets)) < rate)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .limit(3 * per_label)
    )
    rows = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "text")
        .limit(4 * per_label)
        .select("text", "_toxic")
        .toLocalIterator()
    )
    texts, toxic, swaps = [], [], []
    for r in rows:
        if len(swaps) < most_swaps:
            swaps += swapped_terms(r["text"])
        texts.append(" ".join(sorted(words_in(r["text"]))))
        toxic.append(r["_toxic"])
    return fitted(texts, toxic, swaps=swaps[:most_swaps], **options) if len(set(toxic)) == 2 else ToxicityModel({}, 50.0 if 1 in toxic else -50.0)


def toxicity(docs: DataFrame, labels: DataFrame, **sampling) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, from its whole text alone.

    Null and empty texts score the model's bias. Equal texts score alike. Extra columns are
    not read; an empty table gives no rows.
    """
    model = model_for(docs, labels, **sampling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(model.weights, model.bias)
        for batch in batches:
            scores = np.array([own.score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_is_held_out().alias("held_out"), "text")
    return narrow.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
