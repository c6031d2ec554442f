"""Quality rules: base statistics, then a linear-chain CRF over lines decides retention."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_is_held_out, lean

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Words of a repeated window.
WINDOW = 8

# Words that mark boilerplate lines of web pages.
BOILERPLATE = re.compile(
    r"copyright|all rights reserved|cookie|privacy|terms of|subscribe|newsletter|click here|read more|log ?in|sign up|share this|licen[cs]e",
    re.IGNORECASE,
)

#: Names of the line features; a line has a 0/1 value for each.
FEATURES = (
    "always",
    "1-2 words",
    "3-7 words",
    "8-24 words",
    "25+ words",
    "ends a sentence",
    "starts upper",
    "mostly upper",
    "some symbols",
    "many symbols",
    "digits",
    "boilerplate words",
    "seen before",
    "repeats words",
    "very repetitive",
    "long words",
    "address",
)


def line_features(line: str, before: set[str]) -> list[int]:
    """Places in FEATURES that hold for a line with a word."""
    words = line.split()
    n, size = len(words), len(line)
    held = [0, 1 if n <= 2 else 2 if n <= 7 else 3 if n <= 24 else 4]
    stripped = line.rstrip(" \"')]")
    if stripped and stripped[-1] in ".!?:;" and not stripped.endswith("!!"):
        held.append(5)
    if line.lstrip()[:1].isupper():
        held.append(6)
    letters = sum(map(str.isalpha, line))
    if letters and sum(map(str.isupper, line)) > 0.6 * letters and n > 2:
        held.append(7)
    symbols = sum(map(line.count, "#*$%&|<>{}[]=_~^\\!"))
    if symbols > 0.02 * size:
        held.append(8)
    if symbols > 0.06 * size:
        held.append(9)
    if sum(map(line.count, "0123456789")) > 0.2 * size:
        held.append(10)
    if BOILERPLATE.search(line):
        held.append(11)
    if line in before:
        held.append(12)
    distinct = len(set(words))
    if n >= 6 and distinct < 0.5 * n:
        held.append(13)
    if n >= 6 and distinct < 0.25 * n:
        held.append(14)
    if size > 14 * n:
        held.append(15)
    if "://" in line or "@" in line:
        held.append(16)
    return held


@dataclass
class LineChain:
    """Scores of two states (0 content, 1 boilerplate): per feature, per step, at the start."""

    emit: np.ndarray  # (features, 2)
    step: np.ndarray  # (2, 2)
    start: np.ndarray  # (2,)

    def scores(self, lines: list[list[int]]) -> list[tuple[float, float]]:
        emit = self.emit
        return [tuple(emit[held].sum(0).tolist()) for held in lines]

    def best_path(self, lines: list[list[int]]) -> list[int]:
        """Viterbi decoding; ties go to content."""
        (aa, ab), (ba, bb) = self.step.tolist()
        back, a, b = [], *self.start.tolist()
        for i, (ea, eb) in enumerate(self.scores(lines)):
            if i:
                from_a, from_b = (a + aa, b + ba), (a + ab, b + bb)
                back.append((from_a[1] > from_a[0], from_b[1] > from_b[0]))
                a, b = max(from_a), max(from_b)
            a, b = a + ea, b + eb
        path = [int(b > a)]
        for choice in reversed(back):
            path.append(int(choice[path[-1]]))
        return path[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fitted(documents: list[list[list[int]]], states: list[list[int]], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> LineChain:
    """Maximise the conditional likelihood of the line states by forward-backward and gradient steps."""
    chain = LineChain(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    for epoch in range(epochs):
        emit, step, start, n = np.zeros_like(chain.emit), np.zeros((2, 2)), np.zeros(2), 0
        for lines, truth in zip(documents, states):
            e = np.array(chain.scores(lines))
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[0] = chain.start + e[0]
            for i in range(1, len(e)):
                forward[i] = e[i] + _log_sum(forward[i - 1][:, None] + chain.step, 0)
            for i in range(len(e) - 2, -1, -1):
                backward[i] = _log_sum(chain.step + (e[i + 1] + backward[i + 1])[None, :], 1)
            total = _log_sum(forward[-1], 0)
            node = np.exp(forward + backward - total)
            for i, held in enumerate(lines):
                emit[held] -= node[i]
                emit[held, truth[i]] += 1
            for i in range(1, len(e)):
                step -= np.exp(forward[i - 1][:, None] + chain.step + (e[i] + backward[i])[None, :] - total)
                step[truth[i - 1], truth[i]] += 1
            start -= node[0]
            start[truth[0]] += 1
            n += len(lines)
        size = rate * 20 / max(1, n)
        chain.emit += size * (emit - ridge * n * chain.emit / 20)
        chain.step += size * (step - ridge * n * chain.step / 20)
        chain.start += size * start
    return chain


def lines_of(text: str) -> tuple[list[str], list[list[int]]]:
    """Lines with a word and their features."""
    before: set[str] = set()
    lines, held = [], []
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines.append(line)
            held.append(line_features(line, before))
            before.add(line)
    return lines, held


def chain_for(docs: DataFrame, labels: DataFrame, per_label: int = 600) -> LineChain:
    """Train on a bounded sample of labelled documents, about ``per_label`` of each quality label, on all their lines.

    Lines carry no labels of their own. They take their document's (label 0: boilerplate),
    except that a line of a good document with boilerplate words, or seen before in it, is
    boilerplate, and a plain line of a bad document (a whole sentence without any bad sign)
    is content.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold_is_held_out())
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    buckets = 1 << 20
    rate = F.when(F.col("quality") == 1, -(-per_label * buckets // counts.get(1, 1))).otherwise(-(-per_label * buckets // counts.get(0, 1)))
    drawn = (
        known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(buckets)) < rate)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("_quality"))
        .limit(3 * per_label)
    )
    rows = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "text")
        .limit(4 * per_label)
        .select("text", "_quality")
        .toLocalIterator()
    )
    bad_signs = {7, 8, 9, 10, 11, 12, 13, 14}
    documents, states = [], []
    for r in rows:
        held = lines_of(r["text"])[1]
        if not held:
            continue
        documents.append(held)
        if r["_quality"] == 1:
            states.append([int(11 in h or 12 in h) for h in held])
        else:
            states.append([int(not (5 in h and not bad_signs & set(h))) for h in held])
    if not documents:
        # Without labels every line counts as content.
        return LineChain(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    return fitted(documents, states)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by WINDOW-word windows that are found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    with np.errstate(over="ignore"):
        for ahead, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            h = h[:-ahead] * np.uint64(factor) + (h[ahead:] ^ (h[ahead:] >> np.uint64(29)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    starts = np.flatnonzero(maybe).tolist()
    # Equal hashes are looked at word by word.
    windows = [tuple(words[i : i + WINDOW]) for i in starts]
    counts = Counter(windows)
    covered = upto = 0
    for i, window in zip(starts, windows):
        if counts[window] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    word_chars = len(text) - sum(map(text.count, _SPACES))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[str] = set()
    n_dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup_lines += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return len(words), word_chars, n_symbols, n_dup_lines, repeated_words(words)


def content_share(text: str, chain: LineChain) -> float:
    """Share of the text's words in lines that the best path marks as content."""
    lines, held = lines_of(text)
    if not lines:
        return 0.0
    sizes = [len(line.encode("utf-8", "replace").split()) for line in lines]
    content = sum(n for n, state in zip(sizes, chain.best_path(held)) if state == 0)
    return content / sum(sizes)


_OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)


def quality_rules(docs: DataFrame, labels: DataFrame, least_share: float = 0.3, **sampling) -> DataFrame:
    """The base statistics, content_share and kept of every row of ``docs``, from its whole text.

    A document fails the base with under 20 words or with over 30 in 100 words repeated. Of
    the rest one is kept if the lines that Viterbi decoding marks as content hold at least
    ``least_share`` of its words. Null text: no words, failed. Equal texts are answered alike;
    extra columns are not read; an empty table gives no rows.
    """
    chain = chain_for(docs, labels, **sampling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_statistics(text)
                failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
                share = content_share(text, chain)
                rows.append((doc_id, *base, failed, share, not failed and share >= least_share))
            columns = list(zip(*rows)) if rows else [()] * 9
            types = [*[pa.int64()] * 6, pa.bool_(), pa.float64(), pa.bool_()]
            names = [c.split()[0] for c in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(lean(run), _OUT)
