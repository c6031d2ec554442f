"""Distributed key collisions and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, pinned, shuffle_width


#: Keyed rows that a worker combines at once.
CHUNK = 400_000


def _combined(batches: Iterator[pa.RecordBatch], n_items: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted rows (key, *items, *lead) of chunks: the lead of each row is the chunk's smallest item of its key."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = columns[0][1:] != columns[0][:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return (*columns, *[c[begin] for c in columns[1:]])

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def collisions(source: DataFrame, keys, items: list[str]) -> DataFrame:
    """Link items that share a key: key, lead_<item>, <item>.

    ``keys`` maps Arrow batches of ``source`` to batches of a key and the long columns
    ``items``. A worker first combines chunks of its rows: in each, the rows of a key are
    linked to the smallest item, and that one alone goes on to meet other chunks' under its
    key, where again all are linked to the smallest. So a key that a third of all rows hold
    reaches its task once a chunk, and that task reads a sorted stream and gathers nothing.
    The links of a key connect all its items; its smallest item is the smallest lead.
    Items alone under a key give no rows.
    """
    k = len(items)
    leads = [f"lead_{i}" for i in items]
    names = ["key", *items, *leads]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _combined(keys(batches), k):
            own, lead = columns[1 : 1 + k], columns[1 + k :]
            is_lead = np.all([a == b for a, b in zip(own, lead)], axis=0)
            first = np.ones(len(is_lead), bool)
            first[1:] = columns[0][1:] != columns[0][:-1]
            # A repeated item is its own lead again and says nothing new. Leads meet others: they have none yet.
            keep = first | ~is_lead
            table = pa.table([*(pa.array(c[keep]) for c in columns[: 1 + k]), *(pa.array(c[keep], mask=first[keep]) for c in lead)], names)
            yield from table.to_batches(max_chunksize=20_000)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, ()
        for batch in batches:
            if not batch.num_rows:
                continue
            ks, *own = (c.to_numpy() for c in batch.columns[: 1 + k])
            meets = batch.column(1 + k).is_null().to_numpy(zero_copy_only=False)
            theirs = [c.fill_null(0).to_numpy() for c in batch.columns[1 + k :]]
            at = np.arange(len(ks))
            new = np.ones(len(ks), bool)
            new[1:] = (ks[1:] != ks[:-1]) | ~meets[1:] | ~meets[:-1]
            new[0] = key is None or ks[0] != key or not meets[0]
            begin = np.maximum.accumulate(np.where(new, at, -1))
            found = [np.where(begin >= 0, c[begin], lead[i] if lead else 0) for i, c in enumerate(own)]
            found = [np.where(meets, f, t) for f, t in zip(found, theirs)]
            differs = np.any([a != b for a, b in zip(found, own)], axis=0)
            if meets[-1]:
                key, lead = ks[-1], tuple(c[-1] for c in found)
            if differs.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[differs]) for c in (ks, *found, *own)], ["key", *leads, *items])

    schema = ", ".join(f"{n} long" for n in names)
    meets = F.col(leads[0]).isNull()
    dealt = source.mapInArrow(lean(combine, 20_000), schema).repartition(shuffle_width(source.sparkSession), F.when(meets, F.col("key")).otherwise(F.xxhash64(*items)))
    out = ", ".join(f"{n} long" for n in ("key", *leads, *items))
    return pinned(dealt.sortWithinPartitions("key", meets, *items).mapInArrow(lean(meet, 20_000), out), narrow=True)


def differing(shape: DataFrame, members: str = "_members") -> DataFrame:
    """One row of ``shape`` (key, ``members``, other columns) for each set of members; buckets of the same members have the same pairs.

    ``members`` is the column of ``set_mark``. Other columns have to follow from the members.
    """
    others = [c for c in shape.columns if c not in ("key", members)]
    return shape.groupBy(members).agg(F.min("key").alias("key"), *(F.min(c).alias(c) for c in others)).drop(members)


def set_mark(node: str) -> Column:
    """An aggregate that tells sets of different nodes apart: their number and 128 bits of their hashes."""
    return F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(node)).alias("x"), F.bit_xor(F.xxhash64(node, F.lit(1))).alias("y"))


def largest_buckets(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """key: buckets of ``sizes`` (key, n) that hold all pairs of ``members`` (key, node).

    Of the largest buckets of a bucket's members the smallest is the one that may hold all of them.
    A bucket that lies inside it is left out. That one stays: of its own members' largest buckets
    none is smaller.
    """
    known = pinned(members.join(sizes.select("key", "n"), "key").select("key", "node", "n"), narrow=True)
    widest = known.groupBy("node").agg(F.max(F.struct("n", "key")).alias("_widest"))
    other = known.join(widest, "node").groupBy("key").agg(F.min("_widest")["key"].alias("_widest")).where("_widest <> key")
    held = known.select(F.col("key").alias("_widest"), "node")
    inside = known.join(other, "key").join(held, ["_widest", "node"]).groupBy("key", "n").agg(F.count("*").alias("_held")).where("_held = n")
    return sizes.select("key").join(inside, "key", "left_anti")


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups of equal values in ``column``, by which the rows are sorted; several groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if held and (cut or held[-1].column(column)[-1].as_py() != values[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held:
            held.append(batch)
        else:
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """The tables of equal values in the columns ``group``, by which the rows are sorted."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ids = [table.column(c).to_numpy() for c in group]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1).tolist(), len(table)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and any(held[0].column(c)[0].as_py() != x[a] for c, x in zip(group, ids)):
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


#: Edges that one task contracts at once, about.
EDGES_A_TASK = 500_000


def _contracted(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Replace the edges of each of a few bounded parts by stars to the part's smallest nodes."""
    parts = max(1, -(-n // EDGES_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        lo, hi = (np.concatenate(c) for c in zip(*held))
        nodes, places = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # Nodes are in order, so the smaller place is the smaller node.
        for a, b in zip(places[: len(lo)].tolist(), places[len(lo) :].tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = nodes[[root(i) for i in range(len(nodes))]]
        leaf = roots != nodes
        table = pa.table([pa.array(roots[leaf]), pa.array(nodes[leaf])], ["lo", "hi"])
        yield from table.to_batches(max_chunksize=20_000)

    # Dealt in turn, so that no part holds more than its share.
    dealt = edges.select("lo", "hi").repartition(parts) if parts > 1 else edges.select("lo", "hi").coalesce(1)
    return pinned(dealt.mapInArrow(lean(run, 20_000), "lo long, hi long")), parts


def components(links: DataFrame, rounds: int = 30) -> DataFrame:
    """node, component (its smallest node) of every node of ``links`` (columns a, b).

    Parts of about ``EDGES_A_TASK`` edges are contracted to stars, each in a task; where one
    part held them all, that is the answer. Otherwise large-star and small-star steps join
    the parts' stars, again and again with contractions, until nothing changes: their work
    is in joins and partial minima, so a node with very many links is no single task's
    group. Raises if ``rounds`` don't suffice (they grow with the logarithm of the longest
    chain).
    """
    edges = pinned(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), narrow=True)
    done = False
    for _ in range(rounds):
        edges, parts = (edges, 1) if done else _contracted(edges, edges.count())
        if parts == 1:
            roots = edges.select(F.col("lo").alias("node")).distinct()
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        after = pinned(small.select(F.col("m").alias("lo"), "hi").unionByName(moved).distinct(), narrow=True)
        # Only stars to smallest nodes stay as they are in both steps.
        done = _mark(after) == _mark(edges)
        edges = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its count and two sums of hashes."""
    mixed = F.xxhash64("lo", "hi")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.sum(mixed.bitwiseAND(0xFFFFF))).first())
