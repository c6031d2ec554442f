"""Language identification by a byte convolutional network, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_is_held_out, lean

WIDTHS = (2, 3, 4)


@dataclass
class ByteNetwork:
    """One filter table per width and place (byte -> filters), then a dense softmax layer.

    A filter table applied to a byte equals a convolution over its one-hot code.
    """

    languages: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, filters)
    bias: np.ndarray  # all filters
    dense: np.ndarray  # (all filters, languages)
    offset: np.ndarray
    window: int

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter response in each window and its place, straight from the tables."""
        best, places = [], []
        for width in WIDTHS:
            table, n = self.tables[width], windows.shape[1] - width + 1
            total = table[0][windows[:, :n]]
            for place in range(1, width):
                total += table[place][windows[:, place : place + n]]
            at = total.argmax(axis=1)
            places.append(at)
            best.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(places, 1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    """Whether some character is a letter; numerals such as a superscript two are none."""
    return any(map(str.isalpha, text))


def as_windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts as rows of ``window`` bytes, the last row of each padded with 0; rows per text."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts])
    data = b"".join(t.ljust(int(c) * window, b"\0") for t, c in zip(texts, counts))
    return np.frombuffer(data, np.uint8).reshape(-1, window), counts


def trained(texts: list[bytes], languages: list[str], window: int = 256, filters: int = 16, epochs: int = 6, seed: int = 7) -> ByteNetwork:
    """Fit the network to one window of each text by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    net = ByteNetwork(
        names,
        {w: rng.normal(0, 0.3 / w, (w, 256, filters)).astype(np.float32) for w in WIDTHS},
        np.zeros(filters * len(WIDTHS), np.float32),
        rng.normal(0, 0.2, (filters * len(WIDTHS), len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
        window,
    )
    x = np.stack([np.frombuffer(t[:window].ljust(window, b"\0"), np.uint8) for t in texts])
    place = {v: i for i, v in enumerate(names)}
    y = np.array([place[v] for v in languages])
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = (1 / (len(names) * share))[y]
    parts = [*(net.tables[w] for w in WIDTHS), net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 64):
            take = order[start : start + 64]
            pooled, places = net.pooled(x[take])
            active = np.maximum(pooled + net.bias, 0)
            wrong = net.probabilities(pooled)
            wrong[np.arange(len(take)), y[take]] -= 1
            wrong *= (weight[take] / len(take))[:, None]
            back = (wrong @ net.dense.T) * (active > 0)
            grads = []
            for i, width in enumerate(WIDTHS):
                cols = slice(i * filters, (i + 1) * filters)
                grad = np.zeros_like(net.tables[width])
                rows, which = np.arange(len(take))[:, None], np.arange(filters)[None, :]
                for place in range(width):
                    np.add.at(grad[place], (x[take][rows, places[:, cols] + place], which), back[:, cols])
                grads.append(grad)
            grads += [back.sum(0), active.T @ wrong, wrong.sum(0)]
            step += 1
            for p, g, m, v in zip(parts, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Identifier:
    """A worker's copy of the network with byte pairs folded into one table."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        t2, t3, t4 = (net.tables[w] for w in WIDTHS)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.pairs = np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3])], 1)
        self.single = t3[2]
        self.filters = t2.shape[-1]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of a few hundred windows."""
        k, n = self.filters, rows.shape[1]
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        found = self.pairs.take(pair, axis=0)
        three = found[:, : n - 2, k : 2 * k] + self.single.take(rows[:, 2:], axis=0)
        four = found[:, : n - 3, 2 * k : 3 * k] + found[:, 2 : n - 1, 3 * k :]
        pooled = np.concatenate([found[:, :, :k].max(axis=1), three.max(axis=1), four.max(axis=1)], 1)
        return self.net.probabilities(pooled)

    def texts(self, texts: list[str | None], step: int = 128) -> tuple[list[str], list[float]]:
        """Language and score of whole texts: the mean over all their windows."""
        named, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if at:
            rows, counts = as_windows([texts[i].encode("utf-8", "replace") for i in at], self.net.window)
            found = np.concatenate([self.windows(rows[a : a + step]) for a in range(0, len(rows), step)])
            # The last window counts by its share of bytes that are text.
            fill = (rows != 0).mean(axis=1) + 1e-3
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(found * fill[:, None], starts) / np.add.reduceat(fill, starts)[:, None]
            best = mean.argmax(axis=1)
            for i, b, m in zip(at, best, mean):
                named[i], scores[i] = self.net.languages[b], float(min(1.0, m[b]))
        return named, scores


def _sample(known: DataFrame, per_language: int, chars: int) -> list:
    """lang, piece: two stretches of ``chars`` characters of about ``per_language`` documents of each language."""
    counts = known.groupBy("lang").count()
    n_languages = counts.count()
    if not n_languages:
        return []
    buckets = 1 << 20
    limit = F.least(F.lit(buckets), F.ceil(F.lit(per_language * buckets) / F.col("count")))
    span = F.greatest(F.length("text") - chars, F.lit(1))
    draw = F.xxhash64("doc_id", F.lit("sample"))
    return (
        known.join(F.broadcast(counts), "lang")
        .where(F.pmod(draw, F.lit(buckets)) < limit)
        .select(
            "doc_id",
            "lang",
            F.explode(
                F.array(
                    *[F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), span) + 1).cast("int"), F.lit(chars)) for i in range(2)]
                )
            ).alias("piece"),
        )
        .orderBy(F.xxhash64("doc_id"), "piece")
        .limit(min(2**31 - 1, 4 * per_language * n_languages))
        .collect()
    )


def _known(docs: DataFrame, held_out: bool) -> DataFrame:
    fold = fold_is_held_out() if held_out else ~fold_is_held_out()
    return docs.where(fold & F.col("lang").isNotNull() & F.col("text").isNotNull())


def noise(pieces: list[str], n: int, seed: int = 5) -> list[str]:
    """Texts in no language: symbols and digits with few letters, and letters of blocks that ``pieces`` don't use."""
    rng = np.random.default_rng(seed)
    seen = {ord(c) >> 7 for c in set("".join(pieces))}
    blocks = [b for b in (7, 8, 9, 10, 11, 12, 18, 28, 96, 97, *range(156, 320), *range(344, 430)) if b not in seen]
    marks, out = "0123456789#*$%&|<>{}[]=_~^!?.,;:+-/@\\'\"()", []
    for i in range(n):
        size, gap = int(rng.integers(4, 240)), rng.integers(2, 12)
        if i % 2 or not blocks:
            part = marks if i % 4 == 1 else marks[:10] if i % 8 == 3 else marks[10:]
            text = [part[k] for k in rng.integers(0, len(part), size)]
            for at in rng.integers(0, size, rng.integers(1, 2 + size // 20)):
                text[at] = chr(97 + int(rng.integers(26)))
        else:
            block = blocks[int(rng.integers(len(blocks)))]
            text = [chr((block << 7) + int(k)) for k in rng.integers(0, 128, size // 2 + 2)]
        out.append("".join(c if rng.integers(gap) or c.isalpha() else " " for c in text))
    return out


def network_for(docs: DataFrame, per_language: int = 800, chars: int = 240, reject: bool = False) -> ByteNetwork | None:
    """Train on a bounded sample of the documents whose id is not held out and whose lang is known.

    Of each language, however rare, about ``per_language`` documents are drawn by a hash of the id, and of each two stretches of ``chars`` characters. None if
    there is nothing to learn from. With ``reject`` the network learns `und` from noise as well.
    """
    rows = _sample(_known(docs, False), per_language, chars)
    # Labelled text that is mostly not letters doesn't teach a language where junk is to be told.
    rows = [r for r in rows if not reject or 2 * sum(map(str.isalpha, r["piece"])) > len(r["piece"].strip())]
    texts, named = [r["piece"] for r in rows], [r["lang"] for r in rows]
    if not texts:
        return None
    if reject:
        junk = noise(texts, max(200, 2 * len(texts) // len(set(named))))
        texts, named = texts + junk, named + ["und"] * len(junk)
    return trained([t.encode("utf-8", "replace") for t in texts], named)


def least_score(docs: DataFrame, net: ByteNetwork) -> float:
    """Half the lowest score of a right answer among all held-out documents, read whole: clean documents stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = float("inf")
        for batch, named, scores in _identified(batches, net, 1):
            right = zip(batch.column(0).to_pylist(), named, scores)
            least = min([least, *(s for lang, n, s in right if n == lang != "und")])
        if least < float("inf"):
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.float64())], ["least"])

    found = _known(docs, True).select("lang", "text").mapInArrow(lean(run), "least double")
    return (found.agg(F.min("least")).first()[0] or 0.0) / 2


def _identified(batches: Iterator[pa.RecordBatch], net: ByteNetwork | None, column: int):
    worker = Identifier(net) if net else None
    for batch in batches:
        texts, named, scores = batch.column(column).to_pylist(), [], []
        for a in range(0, len(texts), 64):
            n, s = worker.texts(texts[a : a + 64]) if worker else (["und"] * len(texts[a : a + 64]), [0.0] * len(texts[a : a + 64]))
            named += n
            scores += s
        yield batch, named, scores


def languages(docs: DataFrame, net: ByteNetwork | None = None, **sampling) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    The whole text is read, in windows of fixed length. A null text, or one without a
    letter, is `und` with score 0, as is every text when nothing could be learned. Ties go
    to the language first by name. Repeated rows are answered alike; extra columns are not
    read; an empty table gives no rows.
    """
    net = net or network_for(docs, **sampling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, named, scores in _identified(batches, net, 2):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_is_held_out().alias("held_out"), "text")
    return narrow.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, **sampling) -> DataFrame:
    """The rows of ``docs`` in a language that was learned, unchanged.

    Noise is a class of its own, and a score has to reach half of what the held-out documents,
    all of them, show at least. Where nothing could be learned no row stays.
    """
    net = network_for(docs, reject=True, **sampling)
    return identified_only(docs, least_score(docs, net) if net else 0.0, net)


def identified_only(docs: DataFrame, least: float = 0.0, net: ByteNetwork | None = None, **sampling) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, unchanged.

    Null and empty texts and those without a letter go; very long ones are read whole.
    Repeated rows are answered alike, columns of any name stay as they are, and an empty table
    gives no rows, as does one from which nothing could be learned.
    """
    net = net or network_for(docs, **sampling)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, named, scores in _identified(batches, net, column):
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(named, scores)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
