"""Exact Jaccard of candidate pairs, each set moved once for every lead that it meets.

A pair (a, b) is looked at in the group of its lead a. The lead's set goes there once and each
member's once, sorted so that the lead comes first: a task holds one set and reads a stream.
Leads of more than ``PER_LEAD`` members are dealt over several groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .words import slices, token_sets, words_of

#: Members of a lead's group, about.
PER_LEAD = 4096


def roles_of(pairs: DataFrame) -> DataFrame:
    """a, salt, lead, node: the groups to which the sets of the pairs (a, b) have to go."""
    shape = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_LEAD).cast("int").alias("_salts"))
    members = pairs.join(shape, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int").alias("salt"), F.lit(False).alias("lead"), F.col("b").alias("node"))
    leads = shape.select("a", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(True).alias("lead"), F.col("a").alias("node"))
    return members.unionByName(leads)


def common_tokens(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def linked(dealt: DataFrame, words_each: int, percent: float) -> DataFrame:
    """a, b: the pairs whose sets of word n-grams have 100 * intersection >= percent * union.

    ``dealt`` has the columns of ``roles_of`` and text, the node's words: text is smaller
    than its set, so that is what moves. Empty sets link with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in (part for whole in batches for part in slices(whole, 4)):
            links = []
            rows = zip(*(c.to_pylist() for c in batch.columns[:4]))
            for (a, salt, lead, node), own in zip(rows, token_sets(words_of(batch.column(4)), words_each)):
                if lead:
                    group, held = (a, salt), own
                elif group == (a, salt) and 100 * min(len(own), len(held)) >= percent * max(len(own), len(held), 1):
                    common = common_tokens(own, held)
                    if common and 100 * common >= percent * (len(own) + len(held) - common):
                        links.append((a, node))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    narrow = dealt.select("a", "salt", "lead", "node", "text")
    return narrow.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("lead").desc()).mapInArrow(lean(run), "a long, b long")
