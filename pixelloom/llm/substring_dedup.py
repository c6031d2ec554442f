"""Substring dedup by paragraph MinHash banding, verified by exact Jaccard, clustered by components.

Two kinds of passages are looked at. Paragraphs (lines of ``PARAGRAPH`` words or more) meet
by MinHash bands and are verified on their sets of five-word shingles. So that passages put
into the middle of other text are found as well, windows of ``WINDOW`` words meet by their
whole content. They are chosen by content (winnowing: the smallest hash of each few neighbours),
so that every stretch of the least length that two texts share has a window in both, wherever
it starts and however lines break; windows at sentence starts are added. At the ends of what
met, all windows that a chosen one leaves open are tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import bounded, lean, only, passing, pinned
from .graph import collisions, components, differing, set_mark, sorted_groups, whole_groups
from .verify import linked, roles_of
from .words import Words, mixed, set_hash, slices, token_sets, words_of

SHINGLE = 5
PARAGRAPH = 20
WINDOW = 12
#: Words of a passage in production: 50, of which those at the ends may have other punctuation around them.
#: The windows are the same as at the default of 25; shorter stretches are found and left alone.
PASSAGE = 45
#: Paragraphs and shingles of a bucket's block, about.
BLOCK, BLOCK_WORDS = 2048, 1_000_000
#: A place is start * 2**24 + words; a line of more than LONGEST words is several paragraphs.
_PLACE, LONGEST = 24, 1 << 20

#: Class of words that are found only beside a window.
NO_CLASS = -(1 << 63)

_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def tuned_bands(similarity: float, recall: float = 0.99, rows: int = 3) -> int:
    """Bands of ``rows`` minima that give pairs of ``similarity`` this chance to meet."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sliding(best: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    done = 1
    while done < span:
        step = min(done, span - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def window_shape(least_words: int) -> tuple[int, int]:
    """Words of a window, and the span of starts of which one is chosen.

    A stretch of ``least_words`` holds a whole span of windows. Chosen windows are no further
    apart than their width, so those that met leave no words between them.
    """
    width = max(1, min(WINDOW, least_words // 2))
    return width, max(1, min(width, least_words - width + 1))


class Passages:
    """Paragraphs and windows of batches of texts, from the hashes of their words."""

    def __init__(self, similarity: float = 0.8, rows: int = 2, least_words: int = 25):
        self.width, self.span = window_shape(least_words)
        self.rows, self.bands = rows, tuned_bands(similarity, rows=rows)
        rng = np.random.default_rng(11)
        self.factors = rng.integers(1, 1 << 63, (self.bands, self.rows), dtype=np.uint64) | np.uint64(1)

    def windows(self, words: Words) -> np.ndarray:
        """Odd hashes of the content of the windows of ``width`` words from each word on."""
        return words.grams(self.width, 0x66) | np.uint64(1)

    def chosen(self, words: Words, windows: np.ndarray) -> np.ndarray:
        """Places of the smallest of every ``span`` neighbouring windows: texts that share all of these share a place."""
        most, whole = np.uint64(0xFFFFFFFFFFFFFFFF), words.starts(self.width)
        if not whole.any():
            return np.empty(0, np.int64)
        h = np.where(whole, windows, most)
        least = _sliding(np.minimum, np.concatenate([h, np.full(self.span - 1, most)]), self.span)
        # Neighbours lie in one text; a text of fewer windows has one group of all.
        counts = words.starts(self.width + self.span - 1)
        first = words.ends[:-1][np.diff(words.ends) >= self.width]
        counts[first] = True
        least = np.concatenate([np.zeros(self.span - 1, np.uint64), np.where(counts, least, 0)])
        return np.flatnonzero(whole & (_sliding(np.maximum, least, self.span) == h))

    def paragraphs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and the word after the last of lines of ``PARAGRAPH`` words or more."""
        edges = words.line_edges()
        first, last = edges[:-1], edges[1:]
        if len(first) and (last - first).max() > LONGEST:
            edges = np.unique(np.concatenate([edges, *(np.arange(a, b, LONGEST) for a, b in zip(first, last) if b - a > LONGEST)]))
            first, last = edges[:-1], edges[1:]
        wide = last - first >= PARAGRAPH
        return first[wide], last[wide]

    def band_keys(self, words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Even keys of the bands of paragraphs: (bands, paragraphs)."""
        s = words.grams(SHINGLE, SHINGLE)
        cuts = np.stack([first, last - SHINGLE + 1], 1).ravel()
        keys = np.empty((self.bands, len(first)), np.uint64)
        with np.errstate(over="ignore"):
            for band, factors in enumerate(self.factors):
                key = np.full(len(first), band, np.uint64)
                for row, factor in enumerate(factors):
                    key = mixed(key + np.minimum.reduceat(s * factor, cuts)[::2], row + 1)
                keys[band] = key & ~np.uint64(1)
        return keys

    def batch_keys(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (even: a band of a paragraph; odd: a window's content), texts and places."""
        windows = self.windows(words)
        begin = self.chosen(words, windows)
        keys, first, length = [windows[begin]], [begin], [np.full(len(begin), self.width)]
        a, b = self.paragraphs(words)
        if len(a):
            keys.append(self.band_keys(words, a, b).ravel())
            first.append(np.tile(a, self.bands))
            length.append(np.tile(b - a, self.bands))
        first, length = np.concatenate(first).astype(np.int64), np.concatenate(length).astype(np.int64)
        text = np.searchsorted(words.ends, first, side="right") - 1
        return _as_long(np.concatenate(keys)), text, ((first - words.ends[text]) << _PLACE) | length

    def keys(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        keys, _, places = self.batch_keys(words_of(pa.array([text])))
        return keys, places


def _row(df: DataFrame):
    return F.xxhash64("doc_id", "text")


def passage_collisions(docs: DataFrame, similarity: float, least_words: int = 25) -> DataFrame:
    """key, lead_row, lead_place, row, place of paragraphs and windows that meet under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(similarity, least_words=least_words)
        for batch in batches:
            for part in slices(batch, 1):
                keys, text, places = passages.batch_keys(words_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(pa.array(text)), pa.array(places)], ["key", "row", "place"])

    return collisions(docs.select(_row(docs).alias("row"), F.coalesce("text", F.lit(""))), lean(run), ["row", "place"])


#: Columns of ``details``.
DETAILS = ["row", "place", "key", "content", "size", "removed", "shared"]


def combined_windows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``DETAILS`` for windows (key, row, place, words beside, whether it has to be answered).

    Of rows that agree in window and words, one of the smallest row and the last of the
    largest go on to meet others; the rest is answered here.
    """
    key, row, place, words, own = (np.concatenate(c) for c in zip(*parts))
    if not len(key):
        return
    with np.errstate(over="ignore"):
        content = mixed((words.astype(np.uint64) * (mixed(np.arange(words.shape[1], dtype=np.uint64), 0x100) | np.uint64(1))).sum(1, dtype=np.uint64), 9)
    order = np.lexsort((row, content, key))
    key, row, place, content, words, own = (c[order] for c in (key, row, place, content, words, own))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.append(first[1:], len(row)) - 1
    least, most, full = row[first][group], row[last][group], (words != 0).sum(1)
    meets = row == least
    meets[last] = True
    keep = meets | own
    content = [w.tobytes() if x else None for x, w in zip(meets[keep].tolist(), words[keep].astype(">u4"))]
    columns = [pa.array(c[keep]) for c in (row, place, key)] + [pa.array(content, pa.binary()), pa.array(np.full(keep.sum(), -1))]
    # A negative number: nobody asks.
    columns += [pa.array(np.where(row != least, full, 0)[keep]), pa.array(np.where(own, np.where(least != most, full, 0), -1)[keep])]
    yield from pa.Table.from_arrays(columns, DETAILS).to_batches(max_chunksize=20_000)


def details(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """What the ``places`` of the rows in ``wanted`` hold, in one pass over their texts.

    For a paragraph: row, place, key (a hash of its set of shingles), content (its text, once
    a worker for each set) and size (shingles). Places of under ``PARAGRAPH`` words are windows; the number
    says which sides are asked for (see ``edges_of_runs``). Each side gives row, place (its
    words are the side), key (of content and side) and content: 32 bits of each of the words
    beside the window, nearest first, as far as another window may be chosen; size is -1.
    Workers combine chunks of these, and what is answered there has no content.
    """
    width, span = window_shape(least_words)

    def paragraphs_of(words: Words, row: pa.Array, text, places, seen: set) -> pa.RecordBatch:
        shingles, start = words.grams(SHINGLE, SHINGLE), words.ends[text] + (places >> _PLACE)
        keys, content, sizes = [], [], []
        for a, n in zip(start.tolist(), (places & ((1 << _PLACE) - 1)).tolist()):
            tokens = np.unique(shingles[a : a + n - SHINGLE + 1])
            keys.append(set_hash(tokens))
            sizes.append(len(tokens))
            content.append(None if keys[-1] in seen else words.text(a, a + n))
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(keys[-1])
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays(
            [row.take(pa.array(text)), pa.array(places), pa.array(keys, pa.int64()), pa.array(content, pa.binary()), pa.array(sizes, pa.int64()), none, none], DETAILS
        )

    def beside(words: Words, windows: np.ndarray, row: np.ndarray, text, places) -> tuple[np.ndarray, ...]:
        """key, row, place, words, whether it has to be answered."""
        short = words.hashes.astype(np.uint32) | np.uint32(1)
        start, sides = words.ends[text] + (places >> _PLACE), places & ((1 << _PLACE) - 1)
        found = []
        for side in (1, 2):
            asked = sides & side > 0
            at, own = start[asked], text[asked]
            near = (at - 1)[:, None] - np.arange(span - 1) if side == 1 else (at + width)[:, None] + np.arange(span - 1)
            inside = (near >= words.ends[own][:, None]) & (near < words.ends[own + 1][:, None])
            around = np.where(inside, short[np.clip(near, 0, max(0, len(short) - 1))], 0).astype(np.uint32)
            place = places[asked] & ~np.int64((1 << _PLACE) - 1) | side
            # Without a word beside it a window has nothing to share there.
            some = around[:, 0] != 0
            found.append([c[some] for c in (_as_long(mixed(windows[at], side)), row[own], place, around, sides[asked] & (4 * side) > 0)])
        return tuple(np.concatenate(c) for c in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, held, size, seen = Passages(least_words=least_words), [], 0, set()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, owns = words_of(batch.column(1)), batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), owns.value_lengths().to_numpy(zero_copy_only=False))
            places = owns.flatten().to_numpy()
            wide = places & ((1 << _PLACE) - 1) >= PARAGRAPH
            if wide.any():
                yield paragraphs_of(words, batch.column(0), text[wide], places[wide], seen)
            if not wide.all():
                held.append(beside(words, passages.windows(words), batch.column(0).to_numpy(), text[~wide], places[~wide]))
                size += len(held[-1][0])
            if size >= graph.CHUNK:
                yield from combined_windows(held)
                held, size = [], 0
        if held:
            yield from combined_windows(held)

    texts = docs.select(_row(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    asked = only(texts, wanted).join(bounded(wanted, F.size("places")), "row").select("row", "text", "places")
    return asked.mapInArrow(lean(run), "row long, place long, key long, content binary, size long, removed long, shared long")


def block_links(members: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between the components of each bucket; ``members`` has key, node, component.

    Every two members of different components are compared by their sets. Buckets are cut into
    blocks of about ``BLOCK`` members or ``BLOCK_WORDS`` shingles, and each pair of blocks is
    gone through on its own, so no task holds a whole bucket. Of links that connect the same
    components one is given.
    """
    sized = members.join(contents.select("node", F.col("size").alias("_n")), "node")
    shape = (
        sized.groupBy("key")
        .agg(
            F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("_n") / BLOCK_WORDS)).cast("int").alias("_blocks"),
            (F.min("component") != F.max("component")).alias("_apart"),
            set_mark("node").alias("_members"),
        )
        .where("_apart")
        .select("key", F.greatest("_blocks", F.lit(1)).alias("_blocks"), "_members")
    )
    # Bands of near copies are often buckets of the same members.
    shape = differing(shape)
    group = ["key", "i", "j"]
    dealt = (
        members.join(shape, "key")
        .withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "node", "component")
        .join(contents, "node")
        .select(*group, "_own", "node", "component", "content")
    )

    def links_of(table: pa.Table) -> list[tuple[int, int]]:
        nodes, parts, own = (table.column(c).to_numpy() for c in ("node", "component", "_own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        label = np.unique(parts, return_inverse=True)[1]
        if not label.any():
            return []
        sets = [tokens for c in table.column("content").chunks for tokens in token_sets(words_of(c), SHINGLE)]
        sizes = np.array([len(s) for s in sets])
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        holder = np.repeat(np.arange(len(nodes)), sizes)
        holder = holder[np.argsort(token, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(token))])
        ends, theirs, out = np.cumsum(sizes), own == j, []
        for x in np.flatnonzero(own == i).tolist():
            tokens = token[ends[x] - sizes[x] : ends[x]]
            if not len(tokens):
                continue
            common = np.bincount(np.concatenate([holder[first[t] : first[t + 1]] for t in tokens.tolist()]), minlength=len(nodes))
            near = (common >= similarity * (sizes + sizes[x] - common)) & theirs
            for y in np.flatnonzero(near & (label != label[x])).tolist():
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    out.append((int(nodes[x]), int(nodes[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in sorted_groups(batches, group):
            found += links_of(table)
            if len(found) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(lean(run), "a long, b long")


def clustered_paragraphs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """row, place, class, removed of paragraphs whose component reaches several documents.

    ``pairs`` has key, row, place and a lead's row and place; ``sets`` has row, place, key (of the set), content.
    Equal sets of shingles are one node. Leads meet their buckets' members first; buckets that
    still hold several components are then gone through in full. Paragraphs of one document
    connect others as well; components within one document are left out at the end.
    """
    contents = pinned(sets.where("content is not null").select(F.col("key").alias("node"), "content", "size").dropDuplicates(["node"]))
    owners = pinned(sets.select("row", "place", F.col("key").alias("node")).distinct(), narrow=True)
    leads = owners.select(F.col("row").alias("lead_row"), F.col("place").alias("lead_place"), F.col("node").alias("a"))
    keyed = pinned(
        pairs.join(owners, ["row", "place"]).join(leads, ["lead_row", "lead_place"]).where("a <> node").select("key", "a", F.col("node").alias("b")).distinct(),
        narrow=True,
    )
    stars = roles_of(keyed.select("a", "b").distinct()).join(contents.withColumnRenamed("content", "text"), "node")
    links = pinned(linked(stars, SHINGLE, 100 * similarity), narrow=True)

    def with_component(df: DataFrame, links: DataFrame) -> DataFrame:
        known = components(links).withColumnRenamed("component", "_known")
        return df.join(known, "node", "left").withColumn("component", F.coalesce("_known", "node")).drop("_known")

    members = keyed.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    more = block_links(pinned(with_component(members, links), narrow=True), contents, similarity)
    units = pinned(with_component(owners, links.unionByName(more)), narrow=True)
    first = units.groupBy("component").agg(F.min("row").alias("_first"), F.max("row").alias("_last")).where("_first <> _last")
    # Written first, so that the join can split a component that many documents are in.
    first = bounded(pinned(first, narrow=True))
    return units.join(first, "component").select("row", "place", F.col("component").alias("class"), (F.col("row") != F.col("_first")).alias("removed"))


def shared_windows(windows: DataFrame) -> DataFrame:
    """key, row, place, removed of windows whose content several documents hold."""
    # A window is no smallest place of its content if its lead is in another document, or if its
    # lead is in its own document and has itself another lead. Smallest places are kept.
    across = windows.where("lead_row <> row")
    kept = across.groupBy("key").agg(F.min(F.struct("lead_row", "lead_place")).alias("_kept"))
    inside = windows.where("lead_row = row").join(kept, "key").where("_kept.lead_row <> row")
    return (
        across.unionByName(inside.select(*across.columns))
        .select("key", "row", "place", F.lit(True).alias("removed"))
        .unionByName(kept.select("key", F.col("_kept.lead_row").alias("row"), F.col("_kept.lead_place").alias("place"), F.lit(False).alias("removed")))
    )


def runs_and_edges(shared: DataFrame, least_words: int) -> DataFrame:
    """Runs of shared windows that go or that stay, and the windows, in rows of one table.

    A run: row, removed, class, from, to (key is null). A window: row, place, key, and sides, the sides of
    its run (4: begin, 8: end) to which it is nearer than a span.
    """
    width, span = window_shape(least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "row"):
            row, place, key = (table.column(c).to_numpy() for c in ("row", "place", "key"))
            removed = table.column("removed").to_numpy().astype(bool)
            at = place >> _PLACE
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (removed[1:] != removed[:-1]) | (at[1:] - at[:-1] > width)
            first, own = np.flatnonzero(new), np.cumsum(new) - 1
            final = at[np.append(first[1:], len(row)) - 1]
            sides = 4 * (at - at[first][own] < span) + 8 * (final[own] - at < span).astype(np.int64)
            runs, windows = pa.nulls(len(first), pa.int64()), pa.nulls(len(row), pa.int64())
            columns = [
                (row[first], row), (runs, place), (runs, key), (runs, sides), (removed[first].astype(np.int64), windows),
                (np.minimum.reduceat(key, first), windows), (at[first], windows), (final + width, windows),
            ]
            joint = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in pair]) for pair in columns]
            yield from pa.Table.from_arrays(joint, ["row", "place", "key", "sides", "removed", "class", "from", "to"]).to_batches(max_chunksize=20_000)

    dealt = shared.select("row", "place", "key", F.col("removed").cast("int").alias("removed")).repartition("row").sortWithinPartitions("row", "removed", "place")
    return dealt.mapInArrow(lean(run, 50_000), "row long, place long, key long, sides long, removed long, class long, from long, to long")


def edges_of_runs(windows: DataFrame) -> DataFrame:
    """row, place of the windows beside which a shared stretch may go on.

    The place's words are sides: 1 and 2 if the words before and after the window are asked
    for, 4 and 8 where the document itself needs the answer.

    Between shared windows that touch, all words are found already. A shared stretch begins
    less than a span before its first chosen window. If that isn't in a document's run already,
    the run begins less than a span before this window. So all documents that hold such a
    window are asked for the words before it; at the end it is the same.
    """
    edges = pinned(windows.where("sides <> 0").groupBy("key").agg(F.shiftright(F.bit_or("sides"), 2).alias("_asked")), narrow=True)
    windows = only(windows, edges, "key")
    start = F.shiftleft(F.shiftright("place", _PLACE), _PLACE)
    return windows.join(bounded(edges), "key").select("row", start.bitwiseOR(F.col("sides").bitwiseOR(F.col("_asked"))).alias("place"))


class Neighbours:
    """Common beginnings of the words beside equal windows, from a stream sorted by (key, words, row).

    Of each item ``shared`` is the longest beginning that it has in common with another
    row's and ``removed`` the longest with a smaller row's. In this order the nearest
    smaller row on either side has the longest; items wait for the next on a stack of
    growing rows, which a beginning of length 0 empties. Rows are hashes, so it stays short.
    """

    def __init__(self) -> None:
        self.stack: list[list[int]] = []  # row, place, removed, shared, beginning shared with the item below, with a smaller row below
        self.run: list[list[int]] = []  # the last items, of one row
        self.done: list[tuple[int, int, int, int]] = []

    def _leave(self, item: list[int]) -> None:
        if item[3] > 0 and item[7]:
            self.done.append((item[0], item[1], item[2], item[3]))

    def add(self, row: int, place: int, removed: int, shared: int, common: int) -> None:
        """An item that has its ``common`` first words as the one before it."""
        if not common:
            self.end()
        item = [row, place, removed, shared, common, 0]
        low = common
        if self.run and self.run[-1][0] != row:
            item[3] = max(shared, common)
            for other in reversed(self.run):
                other[3] = max(other[3], low)
                low = min(low, other[4])
                if not low:
                    break
            self.run, low = [], common
        elif self.run:
            # The row's own items lie between this one and other rows'.
            item[3] = max(shared, min(common, self.run[-1][6]))
        item += [common if not self.run and self.stack else min(common, self.run[-1][6]) if self.run else 0, shared >= 0]
        while self.stack and self.stack[-1][0] > row:
            top = self.stack.pop()
            top[2] = max(top[2], low)
            top[3] = max(top[3], top[2])
            self._leave(top)
            low = min(low, top[4])
        if self.stack:
            top = self.stack[-1]
            item[5] = low if top[0] < row else min(low, top[5])
            item[2] = max(removed, item[5])
            item[4] = low
        self.stack.append(item)
        self.run.append(item)

    def end(self) -> None:
        for item in self.stack:
            self._leave(item)
        self.stack, self.run = [], []


def beside_shared(contexts: DataFrame, least_words: int) -> DataFrame:
    """row, place, removed, shared: how many words beside a window other rows with it, and smaller ones, have as well.

    ``contexts`` are the rows of ``details`` about windows; those without content are answered already.
    """
    n = window_shape(least_words)[1] - 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = Neighbours(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            words = np.frombuffer(b"".join(batch.column("content").to_pylist()), ">u4").reshape(-1, n).astype(np.uint32)
            before = last or (key[0] ^ 1, words[0])
            keys, both = np.concatenate([[before[0]], key]), np.concatenate([before[1][None], words])
            apart = np.concatenate([(both[1:] != both[:-1]) | (both[1:] == 0), np.ones((len(words), 1), bool)], 1).argmax(1)
            common = np.where(keys[1:] == keys[:-1], apart, 0)
            rows = zip(*(batch.column(c).to_pylist() for c in ("row", "place", "removed", "shared")), common.tolist())
            for row, place, removed, shared, c in rows:
                found.add(row, place, removed, shared, c)
            last = key[-1], words[-1]
            if found.done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found.done)], ["row", "place", "removed", "shared"])
                found.done = []
        found.end()
        if found.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found.done)], ["row", "place", "removed", "shared"])

    answered = contexts.where("content is null").select("row", "place", "removed", "shared")
    # Windows whose nearest word differs have nothing in common, so that word deals a window's rows as well.
    dealt = contexts.where("content is not null").select("key", "content", "row", "place", "removed", "shared")
    dealt = dealt.repartition(F.xxhash64("key", F.substring("content", 1, 4))).sortWithinPartitions("key", "content", "row")
    return dealt.mapInArrow(lean(meet, 20_000), "row long, place long, removed long, shared long").unionByName(answered)


def joined(found: DataFrame, least_words: int) -> DataFrame:
    """row, start_word, n_words, class_id, removed: overlapping or touching stretches (row, removed, class, from, to) of a row as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "row"):
            row, removed, own, begin, end = (table.column(c).to_numpy() for c in ("row", "removed", "class", "from", "to"))
            group = np.ones(len(row), bool)
            group[1:] = (row[1:] != row[:-1]) | (removed[1:] != removed[:-1])
            # Ends of earlier groups lie below all places of later ones.
            shift = (np.cumsum(group) - 1) * (int(end.max()) + 1)
            reached = np.maximum.accumulate(end + shift)
            new = group.copy()
            new[1:] |= (begin + shift)[1:] > reached[:-1]
            first = np.flatnonzero(new)
            least = np.where(own == NO_CLASS, np.iinfo(np.int64).max, own)
            columns = [row[first], begin[first], np.maximum.reduceat(end, first) - begin[first], np.minimum.reduceat(least, first), removed[first].astype(bool)]
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "start_word", "n_words", "class_id", "removed"])
            yield batch.filter(pa.array(columns[2] >= least_words))

    dealt = found.withColumn("removed", F.col("removed").cast("int")).repartition("row").sortWithinPartitions("row", "removed", "from", "to")
    return dealt.mapInArrow(lean(run), "row long, start_word long, n_words long, class_id long, removed boolean")


def repeated_passages(docs: DataFrame, similarity: float = 0.8, least_words: int = 25) -> DataFrame:
    """Stretches of text that occur in several documents: row, start_word, n_words, class_id, removed.

    One row per stretch and document: the first document of a class (in an order by hash)
    keeps the stretch (removed is false), the others lose it. Words are numbered from 0 over
    the whole text. Overlapping passages of a document are joined to one stretch; stretches
    of under ``least_words`` words are left alone. class_id is the smallest class met in the
    stretch: a window's class is its content, a paragraph's its component over verified
    pairs (five-word shingles, Jaccard of ``similarity`` or more).

    Null, empty and short texts have no passages. Repeats inside one document don't count,
    and rows equal in id and text are one document. Extra columns are not read; an empty
    table gives no rows.
    """
    met = passage_collisions(docs, similarity, least_words)
    pairs = met.where("key % 2 = 0")
    shared = pinned(runs_and_edges(shared_windows(met.where("key % 2 <> 0")), least_words), narrow=True)
    sides = pairs.select("row", "place").unionByName(pairs.select(F.col("lead_row").alias("row"), F.col("lead_place").alias("place")))
    sides = sides.unionByName(edges_of_runs(shared.where("key is not null")))
    wanted = pinned(sides.groupBy("row").agg(F.collect_set("place").alias("places")), narrow=True)
    read = pinned(details(docs, wanted, least_words))
    paragraphs = clustered_paragraphs(pairs, read.where("size >= 0"), similarity)
    beside = beside_shared(read.where("size < 0"), least_words)
    start, size = F.shiftright("place", _PLACE), F.col("place").bitwiseAND((1 << _PLACE) - 1)
    width = window_shape(least_words)[0]
    # Words beside a window: those that a smaller row has go, those that only larger rows have stay.
    parts = beside.select("row", F.explode(F.array(F.lit(True), F.lit(False))).alias("removed"), start.alias("_at"), (size == 1).alias("_before"), F.col("removed").alias("_near"), "shared")
    near, far = F.when(F.col("removed"), 0).otherwise(F.col("_near")), F.when(F.col("removed"), F.col("_near")).otherwise(F.col("shared"))
    after = F.col("_at") + width
    stretched = parts.where(far > near).select(
        "row",
        "removed",
        F.lit(NO_CLASS).alias("class"),
        F.when(F.col("_before"), F.col("_at") - far).otherwise(after + near).alias("from"),
        F.when(F.col("_before"), F.col("_at") - near).otherwise(after + far).alias("to"),
    )
    found = (
        paragraphs.select("row", "removed", "class", start.alias("from"), (start + size).alias("to"))
        .unionByName(shared.where("key is null").select("row", (F.col("removed") == 1).alias("removed"), "class", "from", "to"))
        .unionByName(stretched)
    )
    return joined(found, least_words)


def repeats_by_document(docs: DataFrame, **options) -> DataFrame:
    """repeated_passages with each document's doc_id in place of its row key."""
    ids = docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(repeated_passages(docs, **options), "row").select("doc_id", "start_word", "n_words", "class_id", "removed")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` (start, words) and the white space after them."""
    drop: set[int] = set()
    for start, n in spans:
        drop.update(range(start, start + n))
    kept, upto = [], 0
    matches = list(_WORD.finditer(text))
    for i, m in enumerate(matches):
        if i in drop:
            kept.append(text[upto : m.start()] if i - 1 not in drop else "")
            upto = matches[i + 1].start() if i + 1 < len(matches) else len(text)
    kept.append(text[upto:])
    return "".join(kept)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without repeated stretches, columns unchanged but for text and n_chars.

    A document of which no word is left by this goes; others stay, null, empty and blank texts
    as well. Rows equal in id and text are one document and lose the same. Very long texts
    are cut like others; columns of any name stay; an empty table gives no rows.
    """
    with passing(docs.sparkSession):
        spans = (
            repeated_passages(docs, **options)
            .where("removed")
            .groupBy("row")
            .agg(F.collect_list(F.struct("start_word", "n_words")).alias("__spans"))
            .withColumnRenamed("row", "__row")
        )
        gone = pinned(spans, narrow=True, lasting=True)
    side = bounded(gone, F.size("__spans"))
    spanned = docs.withColumn("__row", _row(docs)).join(side, "__row", "left").select(*docs.columns, "__spans")
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts, keep, changed = columns[text_at].to_pylist(), [], {}
            for i, own in enumerate(columns[-1].to_pylist()):
                if own:
                    changed[i] = texts[i] = cut_words(texts[i], [(s["start_word"], s["n_words"]) for s in own])
                keep.append(not own or bool(_WORD.search(texts[i])))
            if changed:
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars_at is not None:
                    sizes = columns[chars_at].to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    columns[chars_at] = pa.array(sizes, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns[:-1], names).filter(pa.array(keep, pa.bool_()))

    return spanned.mapInArrow(lean(run), schema)
