"""Scores of whole texts by a hashed maximum-entropy language model.

A token's probability is factored by classes: words are the leaves of a tree, and each inner node is a
softmax over its children. Features are n-grams and skips (the word before, the two words before, the word before
that one); with the node they are hashed to a slot. A slot's value for a child is the logarithm of how much more often
than at the node at all the child came after it; its weight is one of those that gradient updates train.

1. Counts of all tokens of the training texts. Frequent words become leaves, all others share one.
2. All texts as ids of leaves, once. Words whose counts don't fit a table of bounded size are listed.
3. Classes: texts are told apart by the main components of their frequent words; words that prefer the same kind of
   text come into the same classes.
4. Counts of children in all slots, of all training texts.
5. Weights: each round sums gradient and curvature over the texts of one fold, which the slots' values then leave out
   (a slot is worth what it says of other texts), and all weights take a step.
6. Scores, in batches of numpy arrays. Listed words are joined with their counts.

What goes through the driver, and to the tasks, has a size that parameters fix; only counts by word grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, portions, stored, tidied, utf8

#: The tree: so many levels of nodes with so many children.
LEVELS, BRANCH = 3, 32
LEAVES = BRANCH**LEVELS
#: Ids of the end of a text, and of all words that are no leaves.
END, RARE = 0, 1
#: Slots of hashed features, and the kinds of features.
SLOTS = 1 << 18
KINDS = 3
#: Words whose counts go to the tasks.
COUNTED = 1 << 20
#: Frequent words that tell kinds of texts apart, and main components (two kinds each).
MARKERS, COMPONENTS = 256, 4
#: Weights are shared by slots of about the same count; gradient rounds, and one fold of so many has their texts.
BUCKETS = 16
ROUNDS, FOLDS, STEP, RIDGE, LARGEST = 4, 16, 0.35, 20.0, 1.25
#: Occurrences that a slot needs to count as much as its node.
PRIOR = 4.0
PORTION, TOKENS = 1_000_000, 1024
#: Tokens that are scored together, equal ones in equal contexts once.
TOGETHER = 1 << 20
_BLOCK = 1 << 16
#: Bytes of words, A-Z in lower case, white space as spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_END_KEY = xxhash.xxh3_64_intdigest(b" ")  # no word has a space
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_STARTS = np.cumsum([0, *(BRANCH**n for n in range(LEVELS))])  # the first node of each level


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return utf8(text).translate(_BYTES).split()


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, an end behind each text; tokens of each text)."""
    tokens = [[*words(text), b" "] for text in texts]
    sizes = np.array(list(map(len, tokens)), np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(tokens)), np.uint64, int(sizes.sum())), sizes


# sums of arrays over all tasks


def _rows(array: np.ndarray) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(array[at : at + _BLOCK].tobytes()) for at in range(0, len(array), _BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["block", "data"])


def _added(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """The sum of the arrays that tasks have sent in blocks; each block is added up where it is dealt, one array at a time."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                array = np.frombuffer(unpack(data), kind)
                sums[block] = sums[block] + array if block in sums else array
        data = [pack(x.tobytes()) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    unpack = zstandard.ZstdDecompressor().decompress
    table = rows.repartition("block").mapInArrow(run, "block long, data binary").toArrow()
    out = np.zeros(size, kind)
    for block, data in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        part = np.frombuffer(unpack(data), kind)
        out[block * _BLOCK : block * _BLOCK + len(part)] = part
    return out


def _gathered(frame: DataFrame, per_batch, kind: str, size: int) -> np.ndarray:
    """The sum over all tasks of an array that ``per_batch(batch, array)`` adds to."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.zeros(size, kind)
        for batch in batches:
            per_batch(batch, array)
        if array.any():
            yield _rows(array)

    return _added(frame.mapInArrow(run, "block long, data binary"), kind, size)


# tokens


def token_counts(texts: DataFrame) -> DataFrame:
    """word (64-bit hash) and n, over all texts of the column ``text``; a task sends a row for each of its different words."""
    most = 4_000_000

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, open_, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge():
            new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *open_]), return_counts=True)
            merged, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return merged, np.bincount(back, np.concatenate([counts, n]), len(merged)).astype(np.int64)

        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for start, stop in portions(rows, PORTION):
                open_.append(_hashed(rows[start:stop])[0])
                waiting += len(open_[-1])
                if waiting > max(1_000_000, len(keys)):
                    (keys, counts), open_, waiting = merge(), [], 0
            if len(keys) > most:
                yield out()
                keys, counts = keys[:0], counts[:0]
        keys, counts = merge()
        yield out()

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """Counts of the training tokens. Ids from 2 on are words, by rising hash."""

    tokens: int
    distinct: int
    words: np.ndarray  # hashes of the leaves' words, rising
    counts: np.ndarray  # of all ids: the end, all rare words together, words
    rare_words: np.ndarray  # hashes of rare words with a known count, rising
    rare_counts: np.ndarray
    rare_from: int  # words that occur less often aren't among them
    unknown: float  # the share of a word that was never met among rare words


def _order(n: Column) -> Column:
    return F.floor(F.log2(n) * 16)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, up to a bounded number; words that occur as often as each other go together."""
    own = counts.where(F.col("word") != _signed(_END_KEY))
    end = counts.where(F.col("word") == _signed(_END_KEY)).agg(F.sum("n")).first()[0] or 0
    steps = sorted((r.step, r.words, r.n) for r in own.groupBy(_order(F.col("n")).alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect())
    tokens, distinct = end + sum(n for *_, n in steps), (end > 0) + sum(w for _, w, _ in steps)

    def least(most: int) -> int:
        """The smallest step of a count of two or more from which on there are no more words."""
        found, total = 1 << 20, 0
        for step, n, _ in reversed(steps):
            total += n
            if total > most or step < 1:
                break
            found = step
        return found

    leaf, counted = least(LEAVES - 2), least(LEAVES - 2 + COUNTED)
    table = own.where(_order(F.col("n")) >= counted).toArrow()
    keys, n = (np.asarray(table.column(i).combine_chunks(), np.int64) for i in (0, 1))
    order = np.argsort(keys.view(np.uint64))
    keys, n = keys.view(np.uint64)[order], n[order]
    is_leaf = np.isin(keys, own.where(_order(F.col("n")) >= leaf).select("word").toArrow().column(0).to_numpy().view(np.uint64))
    rare = sum(m for step, _, m in steps if step < leaf)
    once = sum(m for step, _, m in steps if step < 1)
    return Vocabulary(
        tokens, distinct, keys[is_leaf], np.concatenate([[end, rare], n[is_leaf]]), keys[~is_leaf], n[~is_leaf], counted, (once + 1) / (rare + 2)
    )


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


_ENCODED = "key long, doc_id long, held_out boolean, fold int, n_tokens long, ids binary, n_rare long, log_next double, log_own double, tail array<long>, tail_n array<int>"


def encoded(texts: DataFrame, known) -> DataFrame:
    """Texts as ids of leaves (compressed 16-bit numbers), and their rare words.

    n_rare, log_next and log_own are sums over rare words of known count: of 1, log10(count + 1) and log10(count). Other
    rare words are in ``tail``, with the times they occur.
    """
    names = [x.split()[0] for x in _ENCODED.split(", ")]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Vocabulary = known.value
        pack = zstandard.ZstdCompressor(level=1).compress
        find = lambda keys, table: np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
        for batch in batches:
            rows, out = batch.column(4).to_pylist(), []
            for start, stop in portions(rows, PORTION):
                keys, sizes = _hashed(rows[start:stop])
                ids = np.full(len(keys), RARE, "<u2")
                ids[np.cumsum(sizes) - 1] = END
                if len(have.words):
                    at = find(keys, have.words)
                    there = have.words[at] == keys
                    ids[there] = at[there] + 2
                rare = np.flatnonzero(ids == RARE)
                rare_doc, rare_key = np.repeat(np.arange(len(sizes)), sizes)[rare], keys[rare]
                counted, n = np.zeros(len(rare), bool), np.zeros(len(rare))
                if len(have.rare_words):
                    at = find(rare_key, have.rare_words)
                    counted = have.rare_words[at] == rare_key
                    n = np.where(counted, have.rare_counts[at], 0)
                sums = [np.bincount(rare_doc[counted], x, len(sizes)) for x in (None, np.log10(n[counted] + 1), np.log10(np.maximum(n[counted], 1)))]
                doc, key = rare_doc[~counted], rare_key[~counted]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else doc
                times = np.diff(np.append(head, len(doc)))
                of = np.append(0, np.cumsum(np.bincount(doc[head], minlength=len(sizes)))).astype(np.int32)
                tails = [pa.ListArray.from_arrays(pa.array(of), pa.array(x)) for x in (key[head].view(np.int64), times.astype(np.int32))]
                edge = np.append(0, np.cumsum(sizes)).tolist()
                blobs = [pack(ids[a:b].tobytes()) for a, b in zip(edge, edge[1:])]
                out.append([pa.array(sizes), pa.array(blobs, pa.binary()), pa.array(sums[0].astype(np.int64)), *(pa.array(x.astype(np.float64)) for x in sums[1:]), *tails])
            if out:
                made = [pa.concat_arrays(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=names)

    return texts.select("key", "doc_id", "held_out", "fold", "text").mapInArrow(run, _ENCODED)


def _ids(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each text)."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(unpack(x), "<u2") for x in blobs.to_pylist()]
    return np.concatenate([np.zeros(0, "<u2"), *parts]), np.array([len(x) for x in parts], np.int64)


def _slices(blobs: pa.Array, texts: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for start in range(0, len(blobs), texts):
        yield _ids(blobs[start : start + texts])


def _together(blobs: pa.Array, n_tokens: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of as many texts as have about so many tokens."""
    edge = np.flatnonzero(np.diff((np.cumsum(n_tokens) - n_tokens) // most, prepend=-1, append=-1))
    for start, stop in zip(edge.tolist(), edge[1:].tolist()):
        yield _ids(blobs[start:stop])


# classes


def _kinds_of_texts(training: DataFrame, counts: np.ndarray):
    """A function (ids, sizes) -> the kind of each text, 0 to 2 ** COMPONENTS - 1: on which side of each main component it is."""
    frequent = np.argsort(-counts[2:], kind="stable")[:MARKERS] + 2
    place = np.full(len(counts), -1)
    place[frequent] = np.arange(len(frequent))
    width = len(frequent)

    def vectors(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at, doc = place[ids], np.repeat(np.arange(len(sizes)), sizes)
        there = at >= 0
        x = np.sqrt(np.bincount(doc[there] * width + at[there], minlength=len(sizes) * width).reshape(len(sizes), width))
        return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for ids, sizes in _slices(batch.column(0)):
            x = vectors(ids, sizes)
            sums += np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])

    if not width:
        return lambda ids, sizes: np.zeros(len(sizes), np.int64)
    sums = _gathered(training.select("ids"), add, "<f8", width * width + width + 1)
    n, mean = max(1, sums[-1]), sums[width * width : -1] / max(1, sums[-1])
    _, axes = np.linalg.eigh(sums[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    axes = axes[:, -COMPONENTS:]
    return lambda ids, sizes: ((vectors(ids, sizes) - mean) @ axes > 0) @ (1 << np.arange(axes.shape[1]))


def classes(training: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The leaf of each id: words by the kind of text that they prefer, frequent ones first."""
    kind_of, kinds = _kinds_of_texts(training, counts), 1 << COMPONENTS

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for ids, sizes in _slices(batch.column(0)):
            kind = np.repeat(kind_of(ids, sizes), sizes)
            sums += np.bincount(ids * kinds + kind, minlength=len(sums))

    there = _gathered(training.select("ids"), add, "<i8", len(counts) * kinds).reshape(len(counts), kinds)
    liked = ((there + 0.1) / (there.sum(0) + 1)).argmax(1)
    leaf = np.empty(len(counts), np.int64)
    leaf[np.lexsort((-counts, liked))] = np.arange(len(counts)) * (LEAVES - 1) // max(1, len(counts) - 1)
    return leaf


# the model


class Tree:
    """Leaves of ids, each node's children as they occur in the training tokens, and its share of the slots."""

    def __init__(self, leaf: np.ndarray, counts: np.ndarray, slots: int):
        self.leaf = leaf
        children = np.zeros((_STARTS[-1], BRANCH))
        for level in range(LEVELS):
            np.add.at(children, (self.node(leaf, level), self.child(leaf, level)), counts + 0.5)
        mass = children.sum(1)
        self.bias = np.log((children + 1e-6) / (mass + 1e-6 * BRANCH)[:, None]).astype(np.float32)
        self.size = np.maximum(2, (slots * 0.9 * mass / max(1.0, mass.sum() / LEVELS) / LEVELS).astype(np.int64))
        self.first = np.cumsum(self.size) - self.size
        self.slots = int(self.size.sum())
        self._size, self._first = self.size.astype(np.uint64), self.first.astype(np.uint64)

    @staticmethod
    def node(leaf: np.ndarray, level: int) -> np.ndarray:
        return _STARTS[level] + leaf // BRANCH ** (LEVELS - level)

    @staticmethod
    def child(leaf: np.ndarray, level: int) -> np.ndarray:
        return leaf // BRANCH ** (LEVELS - 1 - level) % BRANCH

    def laid(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves of the tokens of texts laid end to end, of the tokens before, and of those before them."""
        # two ends stand before each text
        n = len(sizes)
        laid = np.full(len(ids) + 2 * n, self.leaf[END], np.int64)
        at = np.arange(len(ids)) + 2 * np.repeat(np.arange(1, n + 1), sizes)
        leaves = laid[at] = self.leaf[ids]
        return leaves, laid[at - 1], laid[at - 2]

    @staticmethod
    def features(before: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Hashes of the features of each kind."""
        before, skipped = before.astype(np.uint64) + np.uint64(1), skipped.astype(np.uint64) + np.uint64(1)
        keys = np.stack([before * _M1, (before * _M1 + skipped) * _M2 + np.uint64(77), skipped * _M1 + np.uint64(99991)])
        keys ^= keys >> np.uint64(29)
        return keys * _M2

    def contexts(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, hashes of the features of each kind) of the tokens of texts laid end to end."""
        leaves, before, skipped = self.laid(ids, sizes)
        return leaves, self.features(before, skipped)

    def slot(self, keys: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Slots of features at nodes; no two nodes share one."""
        x = keys ^ node.astype(np.uint64) * _M1
        x *= _M2
        x >>= np.uint64(32)
        x *= self._size[node]
        x >>= np.uint64(32)
        x += self._first[node]
        return x.view(np.int64)


def slot_counts(training: DataFrame, tree) -> tuple[np.ndarray, np.ndarray]:
    """Children of each slot, in the training texts outside of fold 0, and in fold 0."""
    size = tree.value.slots * BRANCH

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        own: Tree = tree.value
        fold = batch.column(1).to_numpy()
        for part in (0, 1):
            for ids, sizes in _slices(batch.column(0).filter(pa.array((fold == 0) == part))):
                leaves, keys = own.contexts(ids, sizes)
                for start in range(0, len(leaves), TOKENS):
                    some, features = leaves[start : start + TOKENS], keys[:, start : start + TOKENS]
                    for level in range(LEVELS):
                        at = own.slot(features, own.node(some, level)) * BRANCH + own.child(some, level)
                        np.add.at(sums, at.ravel() + part * size, np.int32(1))

    both = _gathered(training.select("ids", "fold"), add, "<i4", 2 * size).reshape(2, tree.value.slots, BRANCH)
    return both[0], both[1]


class Model:
    """Values of the slots' features, and the weights by level, kind and bucket."""

    def __init__(self, tree: Tree, counts: np.ndarray, weights: np.ndarray):
        self.tree, self.weights = tree, weights
        n = counts.sum(1)
        self.value = np.empty(counts.shape, np.float32)
        node = np.repeat(np.arange(len(tree.size)), tree.size)
        for start in range(0, len(counts), _BLOCK):
            at = slice(start, start + _BLOCK)
            bias = tree.bias[node[at]]
            self.value[at] = np.log((counts[at] + PRIOR * np.exp(bias)) / (n[at] + PRIOR)[:, None]) - bias
        self.bucket = np.minimum(BUCKETS - 1, np.log2(n + 1)).astype(np.int8)

    def logs(self, leaves: np.ndarray, keys: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Natural logarithms of the probabilities of a few thousand tokens; ``sums`` gets gradient and curvature of the weights."""
        out, every = np.zeros(len(leaves)), np.arange(len(leaves))
        for level in range(LEVELS):
            node, child = self.tree.node(leaves, level), self.tree.child(leaves, level)
            slot = self.tree.slot(keys, node)
            bucket, score = self.bucket[slot], self.tree.bias[node]
            values = [self.value[s] for s in slot]
            for kind in range(KINDS):
                score += self.weights[level, kind][bucket[kind]][:, None] * values[kind]
            own = score[every, child]
            share = np.exp(score, out=score)  # in the range of its type: weights are bounded
            total = share.sum(1)
            out += own - np.log(total)
            if sums is not None:
                share /= total[:, None]
                for kind in range(KINDS):
                    weighted = share * values[kind]
                    mean = weighted.sum(1)
                    spread = (weighted * values[kind]).sum(1) - mean * mean
                    for array, x in zip(sums, (values[kind][every, child] - mean, spread), strict=True):
                        array[level, kind] += np.bincount(bucket[kind], x, BUCKETS)
        return out

    def different(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What ``texts`` gives, worked out once for tokens that are equal and have equal contexts, and once for a node in a context."""
        leaves, before, skipped = self.tree.laid(ids, sizes)
        code, back = np.unique((before * LEAVES + skipped) * LEAVES + leaves, return_inverse=True)
        out = np.empty(len(code))
        for start in range(0, len(code), TOKENS):
            context, leaf = np.divmod(code[start : start + TOKENS], LEAVES)
            out[start : start + TOKENS] = self._logs_in_order(context, leaf)
        return out[back] / math.log(10)

    def _logs_in_order(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural logarithms as those of ``logs``, of tokens in the order of context and leaf: those that share a node stand together."""
        out, keys = np.zeros(len(leaf)), self.tree.features(*np.divmod(context, LEAVES))
        for level in range(LEVELS):
            node, child = self.tree.node(leaf, level), self.tree.child(leaf, level)
            new = np.ones(len(leaf), bool)
            new[1:] = (context[1:] != context[:-1]) | (node[1:] != node[:-1])
            head, row = np.flatnonzero(new), np.cumsum(new) - 1
            slot = self.tree.slot(keys[:, head], node[head])
            bucket, score = self.bucket[slot], self.tree.bias[node[head]]
            for kind in range(KINDS):
                score += self.weights[level, kind][bucket[kind]][:, None] * self.value[slot[kind]]
            own = score[row, child]
            out += own - np.log(np.exp(score, out=score).sum(1))[row]
        return out

    def texts(self, ids: np.ndarray, sizes: np.ndarray, sums=None) -> np.ndarray:
        """log10 of the probabilities of all tokens."""
        leaves, keys = self.tree.contexts(ids, sizes)
        parts = [self.logs(leaves[at : at + TOKENS], keys[:, at : at + TOKENS], sums) for at in range(0, len(leaves), TOKENS)]
        return np.concatenate([np.zeros(0), *parts]) / math.log(10)


def trained_weights(training: DataFrame, tree: Tree, outside: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Each round sums gradient and curvature over fold 0, whose texts the slots' values leave out."""
    spark, shape = training.sparkSession, (LEVELS, KINDS, BUCKETS)
    model = spark.sparkContext.broadcast(Model(tree, outside, np.zeros(shape, np.float32)))
    fold = training.where("fold = 0").select("ids")
    weights = np.full(shape, 0.3, np.float32)
    for _ in range(rounds):

        def add(batch: pa.RecordBatch, sums: np.ndarray, weights=weights) -> None:
            own: Model = model.value
            own.weights = weights
            for ids, sizes in _slices(batch.column(0)):
                own.texts(ids, sizes, tuple(sums.reshape(2, *shape)))

        gradient, curvature = _gathered(fold, add, "<f8", 2 * math.prod(shape)).reshape(2, *shape)
        weights = np.clip(weights + STEP * gradient / (curvature + RIDGE), -LARGEST, LARGEST).astype(np.float32)
    model.unpersist()
    return weights


_SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, log_next double, model double"


def scored(texts: DataFrame, model, counts: np.ndarray, unknown: float) -> DataFrame:
    """Sums over each text, but for the words listed in its tail."""
    log_next, is_known, share = np.log10(counts + 1), counts > 0, math.log10((1 - unknown) / max(1, int(counts[RARE])))
    log_next[RARE], is_known[RARE] = 0, False
    names = [x.split()[0] for x in _SCORED.split(", ")]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for batch in batches:
            sums = []
            for ids, sizes in _together(batch.column("ids"), batch.column("n_tokens").to_numpy(), TOGETHER):
                head = np.cumsum(sizes) - sizes
                sums.append([np.add.reduceat(x, head) for x in (is_known[ids].astype(np.int64), log_next[ids], own.different(ids, sizes))])
            n, after, logs = (np.concatenate(x) for x in zip(*sums, strict=True)) if sums else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
            rare, rare_next, rare_own = (batch.column(x).to_numpy() for x in ("n_rare", "log_next", "log_own"))
            columns = [*(batch.column(x) for x in names[:4]), pa.array(n + rare), pa.array(after + rare_next), pa.array(logs + rare_own + rare * share)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.drop("fold", "tail", "tail_n").mapInArrow(run, _SCORED)


def score_documents(docs: DataFrame, held_out: str, slots: int = SLOTS, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of all whole texts, learned from those of which the condition ``held_out`` does not hold.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end. Returns doc_id, held_out, n_tokens,
    n_known (tokens met in training), train_tokens, base_score and score. The base is the sum over tokens of
    log10((c + 1) / (N + V + 1)): c times that the token was met, N tokens and V different ones. The score is the model's;
    all words that were never met count as one, as in the base. A null text is empty: its end alone. Where ``held_out``
    is null (a null doc_id) a row is learned from. Rows that repeat are learned from each time and score the same. Without
    any training text the base is 0 and the model knows the end and one word. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(
        F.monotonically_increasing_id().alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).cast("int").alias("fold"),
        text.alias("text"),
    )
    counts = stored(token_counts(texts.where("NOT held_out")))
    have = vocabulary(counts)
    known = spark.sparkContext.broadcast(have)
    ids = stored(encoded(texts, known))
    training = ids.where("NOT held_out")
    tree = Tree(classes(training, have.counts), have.counts, slots)
    outside, inside = slot_counts(training, spark.sparkContext.broadcast(tree))
    weights = trained_weights(training, tree, outside, rounds)
    model = spark.sparkContext.broadcast(Model(tree, outside + inside, weights))
    rows = scored(ids, model, have.counts, have.unknown)

    n, met = F.col("times"), F.col("n").isNotNull()
    tail = ids.select("key", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("key", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("times"))
    rare = counts.where(_order(F.col("n")) < have.rare_from)
    share = math.log10((1 - have.unknown) / max(1, int(have.counts[RARE])))
    by_key = (
        tail.join(rare, "word", "left")
        .groupBy("key")
        .agg(
            F.sum(F.when(met, n)).alias("tail_known"),
            F.sum(F.when(met, n * F.log10(F.col("n") + 1))).alias("tail_next"),
            F.sum(n * F.when(met, F.log10("n") + share).otherwise(math.log10(have.unknown))).alias("tail_model"),
        )
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return rows.join(by_key, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("tail_known")).alias("n_known"),
        F.lit(have.tokens).cast("long").alias("train_tokens"),
        (F.col("log_next") + zero("tail_next") - F.col("n_tokens") * math.log10(have.tokens + have.distinct + 1)).alias("base_score"),
        (F.col("model") + zero("tail_model")).alias("score"),
    )
