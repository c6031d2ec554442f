"""Exact n-gram Jaccard join with count vectors in an R-tree.

Tokens (word n-gram hashes) are hashed into groups. Two sets of Jaccard similarity t differ
in at most (1 - t) / (1 + t) of their summed sizes, r tokens, so of r + 1 groups one has the
same tokens in both: such a group's content is a bucket. The counts per group are points; an
R-tree bounds the overlap of a point and a node by the summed minima of coordinates. Points of
about a group a token bound what these leave more closely, as in 64 groups the differences of
long texts hide one another, and what is left is verified on the sets.

At lower similarities groups would hold too few tokens to tell texts apart. There buckets are
the tokens of a prefix filter instead: in an order that puts frequent tokens last, two sets
that link share one of their first tokens. Any order gives all links; counts of hashed tokens
only keep common passages out of the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, only, passing, pinned
from .graph import collisions, components, differing, largest_buckets, set_mark, sorted_groups
from .verify import linked, roles_of
from .words import mixed, set_hash, slices, token_sets, words_of

#: Coordinates of a point, members of a tree node, and members of a bucket's block.
GROUPS, FANOUT, BLOCK = 64, 24, 4096
#: Groups of a fine point, as powers of two.
FINE_BITS = 6, 11
#: The largest count that a point holds.
MOST = 0xFFFF
#: Bits of a token's hash that choose its counter in the token order.
COUNTER_BITS = 22


class Bands:
    """Size bands and, for each, the number of groups of which one must agree."""

    def __init__(self, percent: int, widen: float = 1.25):
        self.percent = percent
        self.lower = [1]
        while self.lower[-1] < 1 << 40:
            self.lower.append(max(self.lower[-1] + 1, floor(self.lower[-1] * widen)))
        self._lower = np.array(self.lower)

    def groups(self, band: int) -> int:
        largest = self.lower[band + 1] - 1
        return (100 - self.percent) * 2 * largest // (100 + self.percent) + 1

    def of(self, size: int) -> list[int]:
        """The set's own band, and the next where a partner may be larger."""
        own = int(np.searchsorted(self._lower, size, side="right")) - 1
        reach = size * 100 // self.percent
        return [b for b in range(own, len(self.lower) - 1) if b == own or self.lower[b] <= reach]


def group_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of which any two different sets that link share one.

    A key is a band, a group and the tokens in it. A group without tokens says nothing about
    a set; where one occurs, the set's smallest tokens (a prefix filter: two sets that link
    share one of them) stand in for it.
    """
    keys = []
    spread = mixed(tokens, 0xA5)
    content = mixed(tokens, 0x5A)
    low, high = (content & np.uint64(0xFFFFFFFF)).astype(np.float64), (content >> np.uint64(32)).astype(np.float64)
    for band in bands.of(len(tokens)):
        n = bands.groups(band)
        if n == 1:
            continue  # only equal sets link here, and those are one class already
        group = (spread % np.uint64(n)).astype(np.int64)
        counts = np.bincount(group, minlength=n)
        # Sums of 32-bit halves stay exact in doubles.
        sums = [np.bincount(group, weights=w, minlength=n).astype(np.uint64) for w in (low, high)]
        with np.errstate(over="ignore"):
            key = mixed(sums[0] + sums[1] * np.uint64(0x9E3779B97F4A7C15), band + 1)
            key = mixed(key + np.arange(n, dtype=np.uint64), 0x77)
        keys.append(key[counts > 0])
        if not counts.all():
            prefix = len(tokens) - ceil(bands.percent * len(tokens) / 100) + 1
            keys.append(mixed(np.sort(spread)[:prefix], 0x1000 + band))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def prefix_keys(tokens: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The set's first tokens, rare ones first: two sets that link share one of them."""
    spread = mixed(tokens, 0xA5)
    rank = frequent[(spread >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    length = len(tokens) - ceil(percent * len(tokens) / 100) + 1
    return spread[np.lexsort((spread, rank))[:length]]


def token_order(docs: DataFrame, words_each: int) -> np.ndarray:
    """Counts of hashed tokens over all documents, in a table of fixed size.

    Workers send their tables in blocks of low and high bytes; a stream of each block's rows is summed.
    """
    block = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        held, size = [], 0

        def add():
            np.add(counts, np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32), out=counts)

        for whole in batches:
            for batch in slices(whole, 0):
                for tokens in token_sets(words_of(batch.column(0)), words_each):
                    held.append((mixed(tokens, 0xA5) >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
                    size += len(tokens)
                if size > 2_000_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        short = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(-1, block)
        low, high = (short & 0xFF).astype(np.uint8), (short >> 8).astype(np.uint8)
        for i in range(len(short)):
            if short[i].any():
                columns = [pa.array([i], pa.int32()), pa.array([low[i].tobytes()]), pa.array([high[i].tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "low", "high"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(block, np.int64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()])], ["block", "counts"])

        for batch in batches:
            for i, low, high in zip(batch.column("block").to_pylist(), batch.column("low"), batch.column("high")):
                if i != at:
                    if at is not None:
                        yield row()
                    at, total = i, np.zeros(block, np.int64)
                total += np.frombuffer(low.as_buffer(), np.uint8) + 256 * np.frombuffer(high.as_buffer(), np.uint8).astype(np.int64)
        if at is not None:
            yield row()

    parts = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(lean(run), "block int, low binary, high binary")
    dealt = parts.repartition("block").sortWithinPartitions("block")
    counts = np.zeros(1 << COUNTER_BITS, np.uint32)
    for row in dealt.mapInArrow(lean(summed, 64), "block int, counts binary").toLocalIterator():
        counts[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["counts"], "<u4")
    # Only the order counts: finer than the square root of a counter's load, it would be noise.
    return np.minimum(counts // max(1, int(np.sqrt(counts.mean()))), 0xFFFF).astype(np.uint16)


def point_of(tokens: np.ndarray) -> np.ndarray:
    """Tokens in each group, and then 16 bits of each group's content."""
    group = (tokens % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(group, minlength=GROUPS)
    marks = np.bincount(group, weights=(mixed(tokens, 0x21) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=GROUPS)
    return np.concatenate([np.minimum(counts, MOST), marks.astype(np.uint64) & np.uint64(0xFFFF)]).astype("<u2")


def _most(points: np.ndarray) -> np.ndarray:
    """Upper bounds of the counts of points; a count of ``MOST`` stands for any number."""
    counts = points[..., :GROUPS].astype(np.int32)
    counts[counts == MOST] = 1 << 30
    return counts


def least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tokens that two sets differ in at least, from their points (the last axis).

    A group differs in its counts' difference or more; where counts agree and contents
    don't, a token was exchanged for another.
    """
    counts = np.abs(x[..., :GROUPS].astype(np.int32) - y[..., :GROUPS])
    other = (x[..., GROUPS:] != y[..., GROUPS:]) & (counts == 0) & (x[..., :GROUPS] != MOST)
    return counts.sum(-1) + 2 * other.sum(-1)


def fine_point(tokens: np.ndarray) -> np.ndarray:
    """As ``point_of``, with about a group a token: a byte of each group's count, then a byte of its content."""
    least, most = FINE_BITS
    n = 1 << min(most, max(least, (len(tokens) - 1).bit_length()))
    group = (tokens % np.uint64(n)).astype(np.int64)
    counts = np.bincount(group, minlength=n)
    marks = np.bincount(group, weights=(mixed(tokens, 0x21) & np.uint64(0xFF)).astype(np.float64), minlength=n)
    return np.concatenate([np.minimum(counts, 0xFF), marks.astype(np.uint64) & np.uint64(0xFF)]).astype(np.uint8)


def fine_difference(points: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens that the sets of the pairs (i, j) differ in at least, from their fine points.

    The finer of two points is folded: its groups' sums are the groups of the other.
    """
    groups = np.array([len(p) // 2 for p in points])
    common, apart = np.minimum(groups[i], groups[j]), np.zeros(len(i), np.int64)
    for n in np.unique(common).tolist():
        at = np.flatnonzero(common == n)
        nodes, places = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        counts, marks = np.empty((len(nodes), n), np.uint8), np.empty((len(nodes), n), np.uint8)
        for k, node in enumerate(nodes.tolist()):
            whole = np.frombuffer(points[node], np.uint8).reshape(2, -1, n).sum(1, dtype=np.int32)
            counts[k], marks[k] = np.minimum(whole[0], 0xFF), whole[1] & 0xFF
        x, y, step = places[: len(at)], places[len(at) :], (1 << 22) // n
        for a in range(0, len(at), step):
            own, other = counts[x[a : a + step]], counts[y[a : a + step]]
            exchanged = (own == other) & (own != 0xFF) & (marks[x[a : a + step]] != marks[y[a : a + step]])
            differ = np.maximum(own, other) - np.minimum(own, other)
            apart[at[a : a + step]] = differ.sum(1, dtype=np.int64) + 2 * np.count_nonzero(exchanged, axis=1)
    return apart


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketches(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """row, doc_id, n, node (hash of the token set), counts (its point) and keys of every document, in one pass.

    A worker gives the keys of a set it has already seen no second time, so exact copies
    are collapsed before anything moves.
    """
    by_groups = 100 + percent >= 16 * (100 - percent)
    frequent = None if by_groups else token_order(docs, words_each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, done = Bands(percent), set()
        for batch in (part for whole in batches for part in slices(whole, 2)):
            sizes, nodes, points, keys = [], [], [], []
            words = words_of(batch.column(2))
            for row, tokens in zip(batch.column(0).to_pylist(), token_sets(words, words_each)):
                node = set_hash(tokens)
                sizes.append(len(tokens))
                nodes.append(node if len(tokens) else row)
                points.append(point_of(tokens).tobytes())
                if not len(tokens) or node in done:
                    keys.append(np.empty(0, np.int64))
                    continue
                if len(done) >= 1_000_000:
                    done.clear()
                done.add(node)
                keys.append(_as_long(group_keys(tokens, bands) if by_groups else prefix_keys(tokens, percent, frequent)))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(points, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["row", "doc_id", "n", "node", "counts", "keys"],
            )

    narrow = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return narrow.mapInArrow(lean(run), "row long, doc_id long, n long, node long, counts binary, keys array<long>")


class CountTree:
    """R-tree over count vectors, packed bottom-up in order of size; nodes hold coordinate maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        counts = _most(points)
        # Within like sizes, neighbours in the first coordinates share a node.
        self.order = np.lexsort((*counts.T[:4], sizes))
        self.points, self.sizes = points, sizes
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, least, most = self.levels[-1]
            starts = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))

    def candidates(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of points whose bounds allow a link with this set, and their least differences."""
        at, counts = np.arange(len(self.levels[-1][0])), _most(point)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = (x[at] for x in self.levels[depth])
            bound = np.minimum(top, counts).sum(1, dtype=np.int64)
            need = percent * (size + np.maximum(least, -(-percent * size // 100)))
            passes = (100 + percent) * bound >= need
            passes &= (least * percent <= 100 * size) & (most * 100 >= percent * size)
            at = at[passes]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        places = self.order[at]
        apart = least_difference(self.points[places], point)
        keep = (100 + percent) * apart <= (100 - percent) * (self.sizes[places] + size)
        return places[keep], apart[keep]


def bounded_pairs(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, parts: np.ndarray) -> np.ndarray:
    """Rows (least difference, i, j) of the pairs of ``left`` and ``right`` in different ``parts`` whose bounds allow a link."""
    mine, theirs = np.flatnonzero(left), np.flatnonzero(right)
    if not len(mine) or not len(theirs):
        return np.empty((0, 3), np.int32)
    if len(theirs) <= FANOUT:
        # A tree of one leaf: all of its points at once.
        some = parts[mine][:, None] != parts[theirs]
        x, y = sizes[mine][:, None], sizes[theirs]
        some &= (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (~left[theirs] | (mine[:, None] < theirs))
        i, j = np.nonzero(some)
        i, j, counts = mine[i], theirs[j], _most(points)
        bound = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64)
        keep = (100 + percent) * bound >= percent * (sizes[i] + sizes[j])
        i, j = i[keep], j[keep]
        apart = least_difference(points[i], points[j])
        keep = (100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[j])
        return np.stack([apart, i, j], 1)[keep].astype(np.int32)
    tree, found = CountTree(points[theirs], sizes[theirs]), []
    for i in mine:
        places, apart = tree.candidates(points[i], int(sizes[i]), percent)
        other = parts[theirs[places]] != parts[i]
        found.append(np.stack([apart[other], np.full(other.sum(), i), theirs[places[other]]], 1).astype(np.int32))
    return np.concatenate(found)


def forest(pairs: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Least pairs that connect, if all hold, what ``pairs`` connect; the likeliest come first."""
    label, out = np.unique(component, return_inverse=True)[1], []
    parent = list(range(int(label.max()) + 1)) if len(label) else []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    for a in range(0, len(pairs), 50_000):
        roots = np.array([root(i) for i in range(len(parent))])[label]
        part = pairs[a : a + 50_000, 1:]
        for i, j in part[roots[part[:, 0]] != roots[part[:, 1]]].tolist():
            x, y = root(label[i]), root(label[j])
            if x != y:
                parent[x] = y
                out.append((i, j))
    return out


def may_link(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bounds allow a link, with their least difference ``apart``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, 2 * GROUPS) for c in ("_x", "_y"))
            apart = least_difference(x, y).astype(np.int64)
            passes = (100 + percent) * apart <= (100 - percent) * (batch.column("_m").to_numpy() + batch.column("_n").to_numpy())
            columns = [batch.column("a"), batch.column("b"), pa.array(apart)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "apart"]).filter(pa.array(passes))

    x = points.select(F.col("node").alias("a"), F.col("counts").alias("_x"), F.col("n").alias("_m"))
    y = points.select(F.col("node").alias("b"), F.col("counts").alias("_y"), F.col("n").alias("_n"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "_x", "_y", "_m", "_n").mapInArrow(lean(run, 5000), "a long, b long, apart long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Each text of their ends is moved once for every lead it meets."""
    if pairs.isEmpty():
        return pairs
    roles = roles_of(pairs).join(classes.select("node", "row"), "node")
    wanted = pinned(roles.groupBy("row").agg(F.collect_list(F.struct("a", "salt", "lead", "node")).alias("roles")), narrow=True)

    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = only(texts, wanted).join(bounded(wanted, F.size("roles")), "row").select("text", F.explode("roles").alias("_role"))
    return linked(dealt.select("_role.*", "text"), words_each, percent)


def fine_points(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words_each: int) -> DataFrame:
    """node, fine (its fine point) of ``nodes``, whose texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            fine = [fine_point(tokens).tobytes() for tokens in token_sets(words_of(batch.column(1)), words_each)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], ["node", "fine"])

    wanted = pinned(classes.join(nodes, "node").select("row", "node"), narrow=True)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = only(texts, wanted).join(bounded(wanted), "row").select("node", "text")
    # Rows that repeat give their node's point again.
    return pinned(dealt.mapInArrow(lean(run), "node long, fine binary").dropDuplicates(["node"]), narrow=True)


def bucket_pairs(
    members: DataFrame, points: DataFrame, percent: int, everything: bool, fine: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """key, a, b: pairs of buckets that aren't connected yet and that the bounds of points leave.

    ``members`` has key, node, component. Buckets are cut into blocks of about ``BLOCK``
    members; each pair of blocks goes through a tree on its own, so no task holds a whole
    bucket. Unless ``everything`` is asked for, a block gives a spanning forest of its pairs:
    if all of these hold, what the others would connect is connected. Near copies share many
    of their first tokens; of their buckets one that holds the others is gone through. With
    ``fine`` (nodes to the rows of ``fine_points``) the pairs that the R-tree leaves are bounded
    once more where they are found, so texts that are alike but don't link give hardly any rows.
    """
    shape = (
        members.groupBy("key")
        .agg(
            F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"),
            (F.min("component") != F.max("component")).alias("_apart"),
            F.count("*").alias("n"),
            set_mark("node").alias("_members"),
        )
        .where("_apart")
        .select("key", "_blocks", "n", "_members")
    )
    shape = pinned(differing(shape), narrow=True)
    shape = shape.join(largest_buckets(members, shape), "key").select("key", "_blocks")
    inside = members.join(shape, "key")
    if fine is not None:
        inside = pinned(inside, narrow=True)
        points = points.join(fine(inside.select("node").distinct()), "node")
    else:
        points = points.withColumn("fine", F.lit(None).cast("binary"))
    dealt = (
        inside
        .withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "node", "component")
        .join(points, "node")
        .select("key", "i", "j", "_own", "node", "component", "counts", "n", "fine")
    )
    group, refined = ["key", "i", "j"], fine is not None

    def pairs_of(table: pa.Table) -> np.ndarray:
        nodes, parts, own, sizes = (table.column(c).to_numpy() for c in ("node", "component", "_own", "n"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        points_here = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u2").reshape(-1, 2 * GROUPS)
        found = bounded_pairs(points_here, sizes, own == i, own == j, percent, parts)
        if refined and len(found):
            found[:, 0] = fine_difference(table.column("fine").to_pylist(), found[:, 1], found[:, 2])
            most = (100 - percent) * (sizes[found[:, 1]] + sizes[found[:, 2]])
            found = found[(100 + percent) * found[:, 0].astype(np.int64) <= most]
        pairs = found[:, 1:] if everything else np.array(forest(found, parts), np.int64).reshape(-1, 2)
        return np.unique(np.sort(nodes[pairs], axis=1), axis=0) if len(pairs) else pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held) if held else np.empty((0, 3), np.int64)
            for a in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[a : a + 100_000].T], ["key", "a", "b"])
            held.clear()

        for table in sorted_groups(batches, group):
            pairs = pairs_of(table)
            held.append(np.column_stack([np.full(len(pairs), table.column("key")[0].as_py(), np.int64), pairs]))
            if len(held) > 1000 or len(pairs) > 20_000:
                yield from out()
        yield from out()

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(lean(run), "key long, a long, b long")


def ngram_classes(docs: DataFrame, words_each: int = 3, percent: int = 90) -> DataFrame:
    """row, doc_id, n, node, component, component_id of every row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their word n-gram sets;
    component_id is the smallest doc_id that links reach. A document of fewer words has its
    whole sequence as its one n-gram; a null, empty or blank text has none and links with
    nothing, not even its like. Equality of n-grams is equality of 64-bit hashes. Exact
    copies are one node. Null ids link as others do but don't name a component (one of null
    ids only has none). Rows equal in id and text are one document. Extra columns are not
    read; an empty table gives no rows.
    """
    sketched = pinned(sketches(docs, words_each, percent))
    keyed = sketched.select(F.explode("keys").alias("key"), "node")
    narrow = sketched.select("row", "doc_id", "n", "node")
    classes = narrow.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("_first"))
    # Each bucket's first member meets the others; what the bounds leave is verified, for each
    # node one pair first, as these connect nearly all that is linked.
    met = collisions(keyed, iter, ["node"])
    stars = met.select(F.col("lead_node").alias("a"), F.col("node").alias("b")).distinct()
    # Copies are dropped first, in part where they are read, so no class of copies meets in one task.
    points = pinned(
        sketched.select("node", "counts", "n")
        .dropDuplicates(["node"])
        .join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"),
        narrow=True,
    )
    sides = met.select("key", F.explode(F.array("lead_node", "node")).alias("node")).distinct()
    nearest = F.min(F.struct("apart", "a"))["a"].alias("a")
    first = pinned(may_link(stars, points, percent).groupBy("b").agg(nearest).select("a", "b"), narrow=True)
    links = pinned(verified(first, docs, classes, words_each, percent), narrow=True)

    def with_component(df: DataFrame, links: DataFrame) -> DataFrame:
        known = components(links).withColumnRenamed("component", "_known")
        return df.join(known, "node", "left").withColumn("component", F.coalesce("_known", "node")).drop("_known")

    # Then forests over the pairs of each bucket that are not connected yet, and all such
    # pairs of the buckets in which one pair of the forest was refuted, by fine points of their members.
    tried = first

    def fine(nodes: DataFrame) -> DataFrame:
        return fine_points(nodes, docs, classes, words_each)

    for everything in (False, True):
        members = pinned(with_component(sides, links), narrow=True)
        found = pinned(bucket_pairs(members, points, percent, everything, fine if everything else None), narrow=True)
        pairs = pinned(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), narrow=True)
        links = pinned(links.unionByName(verified(pairs, docs, classes, words_each, percent)), narrow=True)
        tried = tried.unionByName(pairs)
        refuted = found.join(links, ["a", "b"], "left_anti").select("key").distinct()
        sides = sides.join(refuted, "key", "left_semi")
    linked_nodes = components(links)
    reached = classes.join(linked_nodes, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "_first")
    named = reached.groupBy("component").agg(F.min("_first").alias("component_id"))
    by_node = reached.select("node", "component").join(named, "component")
    return narrow.join(by_node, "node").withColumn(
        "component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for those that link with a kept one: of a component its smallest doc_id stays.

    Of rows equal in id and text one stays too. Columns are unchanged.
    """
    with passing(docs.sparkSession):
        rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
        found = pinned(ngram_classes(docs, **options).select("row", "component", rank.alias("_rank")), narrow=True)
        kept = found.groupBy("component").agg(F.min("_rank").alias("_rank")).select(F.col("_rank.row").alias("row"))
        counted = found.groupBy("row").agg((F.count("*") > 1).alias("_again"))
        gone = pinned(counted.join(kept, "row", "left_anti").select(F.col("row").alias("__ngram_row")), narrow=True, lasting=True)
        again = pinned(counted.where("_again").join(gone, counted["row"] == gone["__ngram_row"], "left_anti").select(F.col("row").alias("__ngram_row")), narrow=True, lasting=True)
    keyed = docs.withColumn("__ngram_row", F.xxhash64("doc_id", "text"))
    n_again = again.count()
    out = gone.select("__ngram_row").unionByName(again) if n_again else gone.select("__ngram_row")
    single = keyed.join(bounded(out), "__ngram_row", "left_anti")
    if n_again:
        repeats = keyed.join(bounded(again), "__ngram_row", "left_semi").dropDuplicates(["__ngram_row"])
        single = single.unionByName(repeats)
    return single.select(*docs.columns)


