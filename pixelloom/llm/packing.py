"""Bound-certified best-fit packing of token sequences.

Partitions pack their pieces by best-fit decreasing and compare the bins with a lower bound
from dual feasible functions. Where both agree the partition is certified optimal. Until the
whole meets its own bound, partitions put the pieces of unfilled bins together and pack them again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pinned

#: Words in each of the two generations that a worker remembers. When the younger is full it
#: becomes the older, and what was only in the older is forgotten.
MEMORY = 120_000
#: Pieces that one packing task takes, about.
PIECES_A_TASK = 65_536

# The token pattern of the word-level vocabulary, restricted to U+0000-U+017F,
# where its letter, number and white-space classes are these.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\\x09-\\x0d \\x85\\xa0"
_TOKEN = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
_BEYOND = re.compile("[^\x00-įı-ſ]")


def _byte_letters() -> dict[int, str]:
    """The byte-level letters: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of single words, as bytes; two generations are kept."""

    def __init__(self, model):
        self._model, self._letters, self.older = model, _byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._letters)
            found = np.array([t.id for t in self._model.tokenize(spelt)], "<u4").tobytes()
        self[word] = found
        return found

    def age(self) -> None:
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary's ids depend on single words only, so words are encoded once and
    remembered. Texts with characters beyond U+017F, or with the written form of a special
    token, go through the tokenizer library as a whole.
    """

    def __init__(self, tokenizer: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self._whole = Tokenizer.from_file(tokenizer)
        self._words = WordIds(self._whole.model)

    @staticmethod
    def _is_plain(text: str) -> bool:
        if "<|" in text:
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not _BEYOND.search(text)

    def encode(self, text: str) -> bytes:
        if not self._is_plain(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self._words.age()
        return b"".join(map(self._words.__getitem__, _TOKEN.findall(text.lower())))


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces.

    A document is its ids and then ``end_id``; null text is empty, so every document has at
    least one piece. Documents longer than ``capacity`` are cut into pieces of ``capacity``
    ids, the last one shorter where they don't divide.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts):
                data = memoryview(encoder.encode(text) + end)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(lean(run), _PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length (descending order expected), each into the fullest bin that holds it."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins, bins = 0, 0, np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            where = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, where, n_bins = capacity, n_bins, n_bins + 1
        bins[i] = where
        if room > length:
            open_bins[room - length].append(where)
            rooms |= 1 << (room - length)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(*np.unique(lengths, return_counts=True), capacity)


def bound_of_counts(lengths: np.ndarray, times: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions.

    The first lifts lengths above capacity - t to capacity and drops those below t; the
    second rounds (k + 1) * length / capacity down, in units of capacity / k.
    """
    if not len(lengths):
        return 0
    counts = np.zeros(capacity + 1, np.int64)
    counts[lengths] = times
    size = np.arange(capacity + 1, dtype=np.int64)
    n_upto, s_upto = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(0, capacity // 2 + 1)
    lifted = (n_upto[-1] - n_upto[capacity - t]) * capacity
    below = np.where(t > 0, s_upto[np.maximum(t - 1, 0)], 0)
    best = int(np.max(-(-(lifted + s_upto[capacity - t] - below) // capacity)))
    for k in range(1, 65):
        steps = (k + 1) * size
        exact = steps % capacity == 0
        value = np.where(exact, size * k, (steps // capacity) * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (capacity * k))))
    return best


_PACKED = f"{_PIECE}, sequence_id long, offset long, certified boolean, gap boolean, loosest boolean"


def _packer(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), np.nan_to_num(table.column("doc_id").to_numpy(zero_copy_only=False).astype(float), nan=-1), -lengths))
        table, lengths = table.take(order), lengths[order]
        bins = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        starts = ends - lengths[by_bin]
        first = np.searchsorted(bins[by_bin], np.arange(n_bins))
        offsets = starts - starts[first][bins[by_bin]]
        fill = np.bincount(bins, weights=lengths, minlength=n_bins)
        gaps, loosest = fill < capacity, int(fill.argmin())
        certified = n_bins == lower_bound(lengths, capacity)
        part = TaskContext.get().partitionId()
        table, bins = table.take(by_bin), bins[by_bin]
        columns = [
            *(table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
            pa.array(bins + ((turn << 48) | (part << 24)), pa.int64()),
            pa.array(offsets.astype(np.int64), pa.int64()),
            pa.array(np.full(len(bins), certified)),
            pa.array(gaps[bins]),
            pa.array(bins == loosest),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "gap", "loosest"]
        packed = pa.Table.from_arrays(columns, names)
        yield from packed.to_batches(max_chunksize=10_000)

    return run


def _dealt(pieces: DataFrame, capacity: int, turn: int) -> tuple[DataFrame, int]:
    """Deal pieces out evenly, pack each part; the result and its number of parts."""
    parts = max(1, -(-pieces.count() // PIECES_A_TASK))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return pinned(pieces.select(*columns).repartition(parts).mapInArrow(_packer(capacity, turn), _PACKED)), parts


def _n_bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


def best_fit_sequences(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, rounds: int | None = None) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    Returns token_pieces' columns, sequence_id, offset (gapless from 0 in a sequence) and
    certified (its partition met the lower bound). A round of repacking is taken over only
    where it needs fewer sequences, and rounds end when the whole meets the bound of all
    lengths (at most ``capacity`` distinct ones), when there is a single part, or when nothing is
    gained from all unfilled bins, from those of uncertified parts, nor from each part's
    emptiest. ``rounds`` bounds the rounds that gain, if given. A task holds about ``PIECES_A_TASK`` narrow rows, dealt without a key, so
    copies don't meet in one task. Repeated rows are packed each; an empty table gives no
    rows; extra columns are ignored.
    """
    pieces = pinned(token_pieces(docs, tokenizer, capacity, end_id))
    packed, parts = _dealt(pieces, capacity, 0)
    histogram = np.array([(r[0], r[1]) for r in pieces.groupBy("length").count().collect()], np.int64).reshape(-1, 2)
    bound = bound_of_counts(histogram[:, 0], histogram[:, 1], capacity)
    used = _n_bins(packed)
    turn, gains, gained = 0, 0, parts > 1
    while gained and used > bound and (rounds is None or gains < rounds):
        gained = False
        for loose in ("gap", "gap and not certified", "gap and loosest"):
            turn += 1
            pool = packed.where(loose)
            before = _n_bins(pool)
            if before < 2:
                continue
            again, _ = _dealt(pool, capacity, turn)
            after = _n_bins(again)
            if after < before:
                packed, used = pinned(packed.where(f"not ({loose})").unionByName(again)), used - before + after
                gained, gains = True, gains + 1
                break
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")

