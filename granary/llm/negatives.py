"""Hard-negative mining by slot-decomposed selection.

A negative of an anchor and one of its positives has a score between two shares of the positive's
score. The windows of an anchor's positives overlap, so they aren't answered one by one: the
positives' upper limits cut the scores into disjoint slots, and a row goes into one slot only. Every task
keeps the best k rows of each slot, combiners merge them, and from the lowest slot up the best k of all slots
so far are the best k below each upper limit. Those of them that reach the positive's lower limit are the answer, for
higher scores come first.

Anchors are a stated query set. They meet all rows in blocks of bounded size; a block goes to the tasks, which score
it against their rows as matrices. No row is sent but the best of each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, stored, tidied

K = 10
POSITIVES = 5
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Numbers in the vectors of a block of anchors (8 bytes each), and scores that a task holds at once.
BLOCK_NUMBERS = 4_000_000
SLICE = 2_000_000
#: Scores are held within these bounds, so that their percentages are long integers, too.
LARGEST = (1 << 63) // 128


class Rows(NamedTuple):
    """Rows of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def by_length(ids, labels, vectors: pa.ListArray, scale: float) -> list[Rows]:
    """Scaled rows of a batch. Rows with any null, and those with a component that is no finite number, are left out."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    whole = ids.is_valid().to_numpy(False) & labels.is_valid().to_numpy(False) & vectors.is_valid().to_numpy(False)
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    numbers = vectors.flatten().to_numpy(False)  # null numbers become NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    whole &= bad[ends] == bad[ends - sizes]
    ids, labels = (np.asarray(x.fill_null(0), np.int64) for x in (ids, labels))
    found = []
    for size in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == size))
        place = (ends - sizes)[at][:, None] + np.arange(size)
        found.append(Rows(ids[at], labels[at], np.floor(numbers[place] * scale)))
    return found


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two matrices of whole numbers; exact, whatever their size."""
    most = lambda x: float(np.abs(x).max(initial=0))
    bound = most(left) * most(right) * max(1, left.shape[1])
    if bound < 1 << 53:
        return (left @ right.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    if bound < LARGEST:
        return left.astype(np.int64) @ right.astype(np.int64).T
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    return np.clip(exact(left) @ exact(right).T, -LARGEST, LARGEST).astype(np.int64)


class Best:
    """The first k rows of each group: higher scores first, ties by the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, -LARGEST - 1)
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._open = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[group]
        self._parts.append((group[keep], score[keep], ids[keep]))
        self._open += int(keep.sum())
        if self._open > SLICE:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self._parts:
            return (np.zeros(0, np.int64),) * 3
        group, score, ids = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
        nth = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
        last = nth == self.k - 1
        self.floor[group[last]] = score[last]
        keep = nth < self.k
        self._parts, self._open = [(group[keep], score[keep], ids[keep])], 0
        return self._parts[0]


class Anchors(NamedTuple):
    """A block of anchors by vector length: their places in the block, ids, labels and vectors."""

    ids: np.ndarray
    parts: list[tuple[np.ndarray, Rows]]

    @classmethod
    def of(cls, batch: pa.Table, scale: float) -> Anchors:
        columns = [batch.column(i).combine_chunks() for i in range(3)]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        found, at = [], 0
        for rows in by_length(*columns, scale):
            found.append((np.arange(at, at + len(rows.ids)), rows))
            at += len(rows.ids)
        return cls(np.concatenate([r.ids for _, r in found]) if found else np.zeros(0, np.int64), found)

    def against(self, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Rows]]:
        """(places of anchors, whether ids differ and labels are the same, scores, rows), in slices."""
        for rows in by_length(*batch.columns, scale):
            for place, own in self.parts:
                if own.vectors.shape[1] != rows.vectors.shape[1]:
                    continue  # vectors of different lengths have no score
                step = max(1, SLICE // max(1, len(own.ids)))
                for start in range(0, len(rows.ids), step):
                    some = Rows(*(x[start : start + step] for x in rows))
                    yield place, own.labels[:, None] == some.labels[None, :], scores(own.vectors, some.vectors), some


def limits(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest score of a negative, of each positive score."""
    return -(-low * positive // 100), high * positive // 100


def _first(rows: DataFrame, k: int, *group: str) -> DataFrame:
    # Spark keeps the first k of each group before the shuffle, too
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def _positives(rows: DataFrame, block, n: int, scale: float) -> DataFrame:
    """anchor (place in the block), score and id of the first n rows of an anchor's label."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        best = Best(len(anchors.ids), n)
        for batch in batches:
            for place, same, score, own in anchors.against(batch, scale):
                a, r = np.nonzero(same & (anchors.ids[place][:, None] != own.ids[None, :]))
                best.add(place[a], score[a, r], own.ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["anchor", "score", "id"])

    return _first(rows.mapInArrow(run, "anchor long, score long, id long"), n, "anchor")


def _slots(rows: DataFrame, block, edges, k: int, scale: float) -> DataFrame:
    """anchor, slot, score and id of the first k rows of another label in each slot.

    ``edges`` has the ascending upper limits of each anchor's positives, and its lowest limit in front.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (lowest, upper) = block.value, edges.value
        width = upper.shape[1]
        best = Best(len(anchors.ids) * width, k)
        for batch in batches:
            for place, same, score, own in anchors.against(batch, scale):
                mine = upper[place]
                a, r = np.nonzero(~same & (score >= lowest[place][:, None]) & (score <= mine[:, -1:]))
                found = score[a, r]
                slot = (found[:, None] > mine[a]).sum(1)  # the first upper limit that the score doesn't exceed
                best.add(place[a] * width + slot, found, own.ids[r])
        group, score, ids = best.rows()
        columns = [group // width, group % width, score, ids]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "slot", "score", "id"])

    return _first(rows.mapInArrow(run, "anchor long, slot long, score long, id long"), k, "anchor", "slot")


def merged(slots: np.ndarray, positives: np.ndarray, k: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(positive, its negatives) of one anchor, either side as rows of score and id.

    From the lowest slot up, the best k so far are those below the slot's upper limit.
    """
    lower, upper = limits(positives[:, 0], low, high)
    edges = np.unique(upper)
    cut = np.searchsorted(edges, slots[:, 0], "left")
    best = slots[:0]
    for nth, edge in enumerate(edges):
        rows = np.concatenate([slots[cut == nth], best])
        best = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:k]]
        for at in np.flatnonzero(upper == edge).tolist():
            yield at, best[best[:, 0] >= lower[at]]


def _answers(slots: DataFrame, block, positives, k: int, low: int, high: int) -> DataFrame:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        place = int(group["anchor"].iloc[0])
        own, parts = positives.value[place], [np.zeros((0, 5), np.int64)]
        for at, found in merged(group[["score", "id"]].to_numpy(np.int64), own, k, low, high):
            rank = np.arange(1, len(found) + 1)
            score, positive = (np.full(len(found), x) for x in own[at])
            parts.append(np.column_stack([positive, rank, found[:, 1], score, found[:, 0]]))
        rows = pd.DataFrame(np.concatenate(parts), columns=names[1:])
        return rows.assign(anchor_id=block.value.ids[place], rank=rows["rank"].astype(np.int32))[names]

    return slots.groupBy("anchor").applyInPandas(
        run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def _blocks(rows: DataFrame, anchor: Column, numbers: int) -> Iterator[pa.Table]:
    """Anchors in blocks of about so many numbers together at most; one block is in the driver at a time."""
    own = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    own = own.select("vec_id", "row.label", "row.embedding")
    total = own.agg(F.sum(F.greatest(F.size("embedding"), F.lit(1)))).first()[0] or 0
    n = -(-2 * total // numbers) if total > numbers else 1
    for nth in range(n):
        part = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == nth) if n > 1 else own
        yield part.toArrow()


def mine(
    vectors: DataFrame,
    anchor: Column,
    k: int = K,
    positives: int = POSITIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    ``vectors`` has vec_id, label and embedding; ``anchor`` says which rows are anchors. Components become
    floor(scale * x), a score is the inner product with the anchor, higher ones come first, ties by the smaller vec_id. The
    positives of an anchor are the first rows of its label with another vec_id; its negatives are the first
    ``k`` rows of another label whose score is between ``low`` and ``high`` percent of the positive's.
    Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows with a null id, label, vector or component, or one that is no finite number, take no part. Vectors of different
    lengths have no score with each other. Rows that repeat an id are candidates of their own, as an
    anchor an id counts once (its smallest label and vector). Scores are held within 2**56. An anchor without
    a positive, and a positive without a negative, have no row; so have empty tables.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = None
    for table in _blocks(rows.where(whole), anchor, block_numbers):
        block = spark.sparkContext.broadcast(Anchors.of(table, scale))
        first = _positives(rows, block, positives, scale).toArrow().to_pandas()
        by_anchor = {place: own[["score", "id"]].to_numpy() for place, own in first.groupby("anchor")}
        lowest, upper = np.full(len(block.value.ids), LARGEST), np.full((len(block.value.ids), max(1, positives)), -LARGEST - 1)
        for place, own in by_anchor.items():
            lower, most = limits(own[:, 0], low, high)
            lowest[place] = lower.min()
            upper[place, -len(most) :] = np.sort(most)
        edges, of_anchor = spark.sparkContext.broadcast((lowest, upper)), spark.sparkContext.broadcast(by_anchor)
        slots = _slots(rows, block, edges, k, scale)
        part = stored(_answers(slots, block, of_anchor, k, low, high))
        found = part if found is None else found.unionByName(part)
    return found
