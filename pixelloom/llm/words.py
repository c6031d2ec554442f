"""Hashes of the words and word n-grams of whole Arrow batches of texts, without a Python string.

Words are runs of characters other than white space, A-Z in lower case. A word's hash is a
polynomial over random 64-bit values of its bytes, mixed with its length; prefix sums give it for all
words of a batch at once. Equality of words is equality of these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of texts that are looked at together, about.
STEP = 1 << 19

_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_IS_SPACE = np.isin(np.arange(256), _SPACES)
_VALUES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_VALUES[_SPACES] = 0
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    with np.errstate(over="ignore"):
        x = x ^ np.asarray(salt).astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            grown = []
            for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(2 * n, factor, np.uint64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    grown.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


POWERS = Powers()


def spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial of ``values[first:last]`` for each pair, whatever the place."""
    up, down = POWERS.upto(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return (sums[last] - sums[first]) * down[first]


@dataclass
class Words:
    """Hashes of the words of some texts; text i has the words ``ends[i]`` to ``ends[i + 1]``.

    ``lines`` has the first word of each line that isn't the text's first, in order; ``at``
    the place of each word, and the end, in the texts' bytes ``data``.
    """

    hashes: np.ndarray
    ends: np.ndarray
    lines: np.ndarray
    at: np.ndarray
    data: np.ndarray

    def text(self, first: int, last: int) -> bytes:
        """The words from ``first`` to before ``last``, with what is between them and after."""
        return self.data[self.at[first] : self.at[last]].tobytes()

    def own(self, i: int) -> np.ndarray:
        return self.hashes[self.ends[i] : self.ends[i + 1]]

    def line_edges(self) -> np.ndarray:
        """Word places at which a line or a text begins, and the end."""
        return np.unique(np.concatenate([self.ends, self.lines]))

    def starts(self, n: int) -> np.ndarray:
        """Whether a run of ``n`` words of one text starts at each word."""
        at = np.arange(len(self.hashes))
        return at + n <= np.repeat(self.ends[1:], np.diff(self.ends))

    def grams(self, n: int, salt: int) -> np.ndarray:
        """Mixed hashes of the runs of ``n`` words from each word on; beyond a text's end they mean nothing."""
        at = np.arange(len(self.hashes))
        return mixed(spans(self.hashes, at, np.minimum(at + n, len(self.hashes))), salt)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _piece(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes in bytes that begin and end between words; ``begins`` splits words as well."""
    space = _IS_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[begins] = True
    edges = np.flatnonzero(edge)
    word = ~space[edges[:-1]]
    first, last = edges[:-1][word], edges[1:][word]
    return first, mixed(spans(_VALUES[data], first, last), last - first)


def words_of(column: pa.Array) -> Words:
    """The words of a column of texts. Very long texts are gone through in steps of bounded size."""
    data, offsets = _flat(column)
    if not len(data):
        nothing = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), nothing, np.zeros(1, np.int64), data)
    first, hashes, a = [], [], 0
    while a < len(data):
        b = min(len(data), a + STEP)
        # Steps end in white space, or at the end of a text, so that words stay whole.
        while b < len(data) and not _IS_SPACE[data[b]]:
            ahead = np.flatnonzero(_IS_SPACE[data[b : b + STEP]])
            b = b + int(ahead[0]) if len(ahead) else min(len(data), b + STEP)
        begins = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        f, h = _piece(data[a:b], begins)
        first.append(f + a)
        hashes.append(h)
        a = b
    starts = np.concatenate(first)
    lines = np.searchsorted(starts, np.flatnonzero(data == 10))
    return Words(np.concatenate(hashes), np.searchsorted(starts, offsets), lines, np.append(starts, len(data)), data)


def token_sets(words: Words, words_each: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams; all words as one if fewer."""
    grams, ends = words.grams(words_each, words_each), words.ends.tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= words_each:
            yield np.unique(grams[a : b - words_each + 1])
        elif b > a:
            yield mixed(spans(words.hashes[a:b], np.array([0]), np.array([b - a])), b - a)
        else:
            yield np.empty(0, np.uint64)


def set_hash(tokens: np.ndarray) -> int:
    """64 bits of a set of tokens, as a signed number."""
    with np.errstate(over="ignore"):
        total = mixed(tokens, 0x33).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mixed(np.array([total]), 0x44).view(np.int64)[0])


def slices(batch: pa.RecordBatch, text: int, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in slices whose texts hold about ``step`` bytes."""
    sizes = batch.column(text).cast(pa.large_string())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    cuts = np.unique(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], step), side="right") - 1) if len(sizes) else []
    cuts = sorted({0, *map(int, cuts), len(sizes)})
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
