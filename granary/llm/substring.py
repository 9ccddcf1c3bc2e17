"""Exact substring deduplication by recompression.

A text is a string of words. Rounds of recompression rename it level by level: maximal runs of
a symbol get one name, then neighbours whose names' bits are 0 and 1 are paired under a
new name. Names are hashes of what they stand for, so every task gives equal parts
equal names without asking the others, and equal substrings consist of the same symbols
but for some at either end. How many words beside a symbol had a say in its making, its
reach, is kept exactly; so it is known which symbols any copy of a window must hold as well.

Every window chooses an anchor among those symbols: a pair of neighbours of the highest level,
the smallest name if there are several, symbols of a lower level if there is none. Copies of a
window choose the same anchor. So only three things go through a shuffle:

1. one row for each anchor, with a hash of all the text whose windows have chosen it. Where
   that text has an earlier copy, all its windows have one. Where the anchor's name occurs
   once, none has;
2. windows of the anchors that remain, one by one;
3. what is to be removed, to the documents.

Within a batch a task settles by itself all but the first copy of everything, so that
a passage that a third of all documents hold sends one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import WordHashes, mixed, portions, release, sha256_hex, space_words, stored, tidied

WINDOW = 20
ROUNDS = 3
PORTION = 1_500_000

#: Kinds of anchor rows: the only one or one of several of its name in the batch, a further text with that
#: name, a copy of an earlier text of the batch.
ALONE, ONE_OF_SEVERAL, FURTHER, COPY = range(4)
_KIND_BIT = 22
_FAR = 1 << 40
_NULL_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_MOST = np.iinfo(np.uint64).max


class Level:
    """Symbols of one level, left to right: name, first word, number of words, reach to the left and right."""

    def __init__(self, name, start, length, left, right, first):
        self.name, self.start, self.length, self.left, self.right = name, start, length, left, right
        self.first = first  # opens a document

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that one has to know to know the symbol before, and the symbol after."""
        before = np.concatenate([[0], (self.length + self.left)[:-1]])
        before[self.first] = _FAR  # what another copy has there is unknown
        after = np.concatenate([(self.length + self.right)[1:], [0]])
        after[np.append(self.first[1:], True)] = _FAR
        return before, after

    def across(self, length: np.ndarray, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the right neighbour's reach goes out on the left of symbols head..last, and the left one's on the right."""
        left = np.append(self.left[1:], 0)[last] - length
        right = np.concatenate([[0], self.right[:-1]])[head] - length
        return left, right


def compress_runs(level: Level, words: np.ndarray, salt: int) -> Level:
    """Name maximal runs. Also a symbol that stands alone does so only because its neighbours differ from it."""
    same = np.zeros(len(level.name), bool)
    same[1:] = (level.name[1:] == level.name[:-1]) & ~level.first[1:]
    before, after = level.beside()
    head = np.flatnonzero(~same)
    count = np.diff(np.append(head, len(same)))
    last = head + count - 1
    # a neighbour differs for sure if the word at the border does; then that word is all one has to know
    unit, start = level.length[head], level.start[head]
    end = level.start[last] + unit
    clear = words[np.maximum(start - 1, 0)] != words[start + unit - 1]
    clear_left = clear & ~level.first[head]
    clear = words[np.minimum(end, len(words) - 1)] != words[start]
    clear_right = clear & ~np.append(level.first[1:], True)[last]
    # else one has to know the neighbour, with what has a say in it on its far side and on ours
    over_left, over_right = level.across(unit * count, head, last)
    left = np.maximum.reduceat(level.left, head) if len(head) else level.left
    right = np.maximum.reduceat(level.right, head) if len(head) else level.right
    left = np.maximum(left, np.maximum(np.where(clear_left, 1, before[head]), np.where(clear_right, 0, over_left)))
    right = np.maximum(right, np.maximum(np.where(clear_right, 1, after[last]), np.where(clear_left, 0, over_right)))
    power = mixed(level.name[head] * _PRIME + count.astype(np.uint64) + np.uint64(salt << 40))
    name = np.where(count > 1, power, level.name[head])
    return Level(name, start, unit * count, left, right, level.first[head])


def compress_pairs(level: Level, salt: int, longest: int) -> Level:
    n = len(level.name)
    right_half = (mixed(level.name + np.uint64(salt * int(_M) & int(_MOST))) >> np.uint64(63)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = (
        ~right_half[:-1] & right_half[1:] & ~level.first[1:] & (level.length[:-1] + level.length[1:] <= longest)
    )
    paired = np.zeros(n, bool)
    paired[1:] = pair[:-1]
    before, after = level.beside()
    name, length = level.name.copy(), level.length.copy()
    # a half that stays alone does so because of its neighbour
    every = np.arange(n)
    over_left, over_right = level.across(level.length, every, every)
    looks_left, looks_right = right_half & ~paired, ~right_half & ~pair
    left = np.maximum(level.left, np.where(looks_left, before, np.where(looks_right, over_left, 0)))
    right = np.maximum(level.right, np.where(looks_right, after, np.where(looks_left, over_right, 0)))
    p = np.flatnonzero(pair)
    q = p + 1
    name[p] = mixed(level.name[p] * _PRIME + mixed(level.name[q]) + np.uint64(salt))
    length[p] = level.length[p] + level.length[q]
    left[p] = np.maximum(level.left[p], level.left[q] - level.length[p])  # a pair needs its halves only
    right[p] = np.maximum(level.right[q], level.right[p] - level.length[q])
    keep = ~paired
    return Level(name[keep], level.start[keep], length[keep], left[keep], right[keep], level.first[keep])


def recompress(words: np.ndarray, first: np.ndarray, rounds: int, longest: int) -> list[Level]:
    zero = np.zeros(len(words), np.int64)
    levels = [Level(words, np.arange(len(words)), zero + 1, zero, zero, first)]
    for n in range(1, rounds + 1):
        levels.append(compress_pairs(compress_runs(levels[-1], words, n), n, longest))
    return levels


class Ranges:
    """Hashes of ranges of words, all in one pass."""

    def __init__(self, words: np.ndarray, salt: int = 0):
        power = np.full(len(words) + 1, _M)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        inverse = np.full(len(words) + 1, np.uint64(pow(int(_M), -1, 1 << 64)))
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words + np.uint64(salt)) * self.power[:-1])])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def anchors(words: np.ndarray, sizes: np.ndarray, window: int, rounds: int = ROUNDS):
    """(document, first window, number of windows, name, hash of their text) of the anchors of documents laid end to end."""
    offset = np.cumsum(sizes) - sizes
    n = len(words)
    first = np.zeros(n, bool)
    first[offset[sizes > 0]] = True
    document = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = offset[document], offset[document] + sizes[document]
    whole = np.arange(n) + window <= end
    name, place = np.zeros(n, np.uint64), np.full(n, -1)
    levels = recompress(words, first, rounds, max(1, window // 2))
    for depth, together in [*((k, m) for k in range(rounds, 0, -1) for m in (2, 1)), (0, 1)]:
        open_ = whole & (place < 0)
        if not open_.any():
            break
        level = levels[depth]
        units = max(0, len(level.name) - together + 1)
        unit = np.full(units, np.uint64(depth * 31 + together))
        low, high = np.full(units, _FAR), np.zeros(units, np.int64)
        for d in range(together):
            at = slice(d, d + units)
            unit = mixed(unit * _PRIME + level.name[at])
            low = np.minimum(low, level.start[at] - level.left[at])
            high = np.maximum(high, level.start[at] + level.length[at] + level.right[at])
        at = level.start[:units]
        good = np.flatnonzero((high - low <= window) & (low >= begin[at]) & (high <= end[at]))
        waiting = np.concatenate([[0], np.cumsum(open_)])
        good = good[waiting[low[good] + 1] > waiting[np.maximum(high[good] - window, 0)]]
        unit, low, high, at = unit[good], low[good], high[good], at[good]
        # smallest name, then leftmost, for every window that holds it
        low_bits = np.uint64((1 << max(24, len(unit).bit_length())) - 1)
        key = (mixed(unit) & ~low_bits) | np.arange(len(unit), dtype=np.uint64)
        best, start = np.full(n, _MOST), np.maximum(high - window, 0)
        for d in range(window):
            reached = start + d
            holds = reached <= low
            np.minimum.at(best, reached[holds], key[holds])
        new = np.flatnonzero(open_ & (best != _MOST))
        which = (best[new] & low_bits).astype(np.int64)
        name[new], place[new] = unit[which], at[which] * 64 + depth * 2 + together - 1
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | first[1:]
    run = np.flatnonzero(change & whole)
    if not len(run):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.append((change | ~whole)[1:], True) & whole) + 1
    count = ends - run
    if (more := count > 255).any():  # the number of windows has 8 bits
        parts = -(-count // 255)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run, ends = np.repeat(run, parts) + 255 * nth, np.repeat(ends, parts)
        count = np.minimum(255, ends - run)
        assert more.any()
    text = mixed(Ranges(words)(run, run + count + window - 1) + count.astype(np.uint64) * _M + (place[run] // 64 - run).astype(np.uint64))
    return document[run], run - begin[run], count, name[run], text


def _hashed(texts: list[str], hashes: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of all words, words of each text) of portions of texts."""
    for start, stop in portions(texts, PORTION):
        parts = [hashes.array(space_words(text)) for text in texts[start:stop]]
        yield start, np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _first_copies(keys: tuple[np.ndarray, ...], ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Is there a row with the same keys and a smaller (id, start)?"""
    order = np.lexsort((start, ids, *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    copy = np.zeros(len(order), bool)
    copy[order] = (ids[lead] != ids[order]) | (start[lead] != start[order])
    return copy


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """part, span, id, tag, packed: what to group by, hash of the text, document, and start, windows and kind."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = WordHashes()
        for batch in batches:
            ids = np.array(batch.column(0), np.int64)
            tags = np.array(batch.column(1), np.int64)
            parts = []
            for first, words, sizes in _hashed(batch.column(2).to_pylist(), hashes):
                doc, *rest = anchors(words, sizes, window)
                parts.append((doc + first, *rest))
            if not parts:
                continue
            doc, start, count, name, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            copy = _first_copies((name, span), ids[doc], start)
            kind = np.where(copy, COPY, ALONE)
            # the first text of each name is grouped by the name, further ones by name and text
            rest = np.flatnonzero(~copy)
            order = rest[np.argsort(name[rest], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = name[order][1:] != name[order][:-1]
            last = np.append(new[1:], True)
            kind[order] = np.where(new, np.where(last, ALONE, ONE_OF_SEVERAL), FURTHER)
            own = mixed(name ^ mixed(span))
            spread = mixed(start.astype(np.uint64) * _M + own)  # copies are settled and go anywhere
            part = np.where(kind == FURTHER, own, np.where(kind == COPY, spread, name))
            packed = start << 32 | count << 24 | kind << _KIND_BIT
            columns = [pa.array(x) for x in (part.view(np.int64), span.view(np.int64), ids[doc], tags[doc], packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "span", "id", "tag", "packed"])

    return docs.mapInArrow(run, "part long, span long, id long, tag long, packed long")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, id, tag, packed: hashes of a window, document, and its start and kind; of the runs listed with the documents."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = np.array(batch.column(0), np.int64)
            tags = np.array(batch.column(1), np.int64)
            texts = [unpack(x).decode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
            runs = batch.column(3).to_pylist()
            out = []
            for first, words, sizes in _hashed(texts, hashes):
                offset = np.cumsum(sizes) - sizes
                listed = [np.array(runs[first + k], np.int64) for k in range(len(sizes))]
                doc = np.repeat(np.arange(len(sizes)), [len(x) for x in listed])
                start, count = np.concatenate(listed) >> 8, np.concatenate(listed) & 255
                doc = np.repeat(doc, count)
                at = np.repeat(start, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                place = offset[doc] + at
                h1, h2 = (Ranges(words, salt)(place, place + window) for salt in (1, 2))
                out.append((h1, h2, doc + first, at))
            if not out:
                continue
            h1, h2, doc, at = (np.concatenate(x) for x in zip(*out, strict=True))
            copy = _first_copies((h1, h2), ids[doc], at)
            spread = mixed(at.astype(np.uint64) * _M + h1)
            packed = at << 32 | np.where(copy, COPY, ALONE) << _KIND_BIT
            columns = [np.where(copy, spread, h1).view(np.int64), h2.view(np.int64), ids[doc], tags[doc], packed]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h1", "h2", "id", "tag", "packed"])

    return docs.mapInArrow(run, "h1 long, h2 long, id long, tag long, packed long")


def _field(name: str) -> Column:
    packed = F.col("packed")
    return {
        "start": F.shiftright(packed, 32),
        "count": F.shiftright(packed, 24).bitwiseAND(F.lit(255)),
        "kind": F.shiftright(packed, _KIND_BIT).bitwiseAND(F.lit(3)),
    }[name]


def _later(*keys: str) -> Column:
    """Does a row of the same keys come earlier, in a smaller id or further left?"""
    group = Window.partitionBy(*keys).orderBy("id", "packed")
    return (F.first("id").over(group) != F.col("id")) | (F.shiftright(F.first("packed").over(group), 32) != _field("start"))


@F.pandas_udf(T.BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1).compress
    return texts.map(lambda text: pack(text.encode("utf-8", "surrogatepass")))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``__id``, ``__tag`` (the text's hash) and text, null as empty.

    In place of a null id stands a hash of the text, from -2**63 to -2**62: smaller than other ids are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID) + F.shiftrightunsigned(F.xxhash64(text), 2)),
            "__tag": F.xxhash64(text),
            "__text": text,
        }
    )


def _briefly_keyed(docs: DataFrame) -> DataFrame:
    """``keyed`` rows whose tag is 0 where all texts of the id are equal; there the id alone tells them apart.

    A tag goes with every anchor and window, and a hash doesn't compress.
    """
    rows = keyed(docs)
    texts_of = rows.groupBy("__id").agg(F.min("__tag").alias("low"), F.max("__tag").alias("high"))
    shared = stored(texts_of.where("low <> high").select(F.col("__id").alias("__shared")))
    joined = rows.join(shared, F.col("__id") == F.col("__shared"), "left")
    return joined.withColumn("__tag", F.when(F.col("__shared").isNull(), F.lit(0)).otherwise(F.col("__tag")).cast("long")).drop("__shared")


def _repeats(rows: DataFrame, window: int) -> DataFrame:
    """id, tag and runs (first window times 256 plus number of windows) that have an earlier copy, for each document with any."""
    texts = rows.select("__id", "__tag", "__text")
    every = Window.partitionBy("part").orderBy("span", "id", "packed").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = _field("kind")
    settled = (
        _anchor_rows(texts, window)
        .withColumn("n", F.count("*").over(every))
        .withColumn("copy", (kind == COPY) | _later("part", "span"))
        .where(F.col("copy") | (F.col("n") > 1) | kind.isin(ONE_OF_SEVERAL, FURTHER))
        .select("id", "tag", (F.shiftleft(_field("start"), 8) + _field("count")).alias("run"), "copy")
    )
    settled = stored(settled)
    open_ = settled.where(~F.col("copy")).groupBy("id", "tag").agg(F.collect_list("run").alias("runs"))
    packed = texts.select(F.col("__id").alias("id"), F.col("__tag").alias("tag"), _pack("__text").alias("text"))
    # a merge join, in small tables too: where packing and windows share a task, it has two Python workers
    windows = _window_rows(packed.join(open_.hint("merge"), ["id", "tag"]).select("id", "tag", "text", "runs"), window)
    single = windows.withColumn("copy", (_field("kind") == COPY) | _later("h1", "h2")).where("copy")
    single = single.select("id", "tag", (F.shiftleft(_field("start"), 8) + 1).alias("run"))
    return settled.where("copy").select("id", "tag", "run").unionByName(single).groupBy("id", "tag").agg(F.collect_list("run").alias("runs"))


def covered(n: int, runs: list[int] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window of the runs."""
    edge = np.zeros(n + 1, np.int64)
    if runs is not None and len(runs):
        run = np.array(runs, np.int64)
        np.add.at(edge, run >> 8, 1)
        np.add.at(edge, (run >> 8) + (run & 255) - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of each whole text that lie in a window of words which also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; earlier is a smaller doc_id, or the same document
    further left. Windows are judged on the input. Returns doc_id, n_words, n_removed and
    kept_sha256, of the words kept, joined by one space. A null text has no words. Different texts
    without an id are different documents, before all others in the order of a hash. Rows that
    repeat are the same document and get the same result.
    """
    keys = _briefly_keyed(docs)
    found = _repeats(keys, window)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for blob, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = space_words(unpack(blob).decode("utf-8", "surrogatepass"))
                gone = covered(len(words), runs, window)
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words
                rows.append((len(words), len(words) - len(kept), sha256_hex(b" ".join(kept))))
            n, removed, digest = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    texts = keys.select(F.col("doc_id").cast("long").alias("doc_id"), "__id", "__tag", _pack("__text").alias("text"))
    joined = texts.join(found, (F.col("__id") == F.col("id")) & (F.col("__tag") == F.col("tag")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: str, runs: list[int] | None, window: int) -> str:
    """The text without the words of the runs' windows and the white space before each of them."""
    if runs is None or not len(runs):
        return text
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = (data == 32) | (data >= 9) & (data <= 13)
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    gone = covered(len(starts), runs, window)
    # a word and the white space before it
    owner = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    owner = np.where(space, owner + 1, owner)
    return data[~np.append(gone, False)[owner]].tobytes().decode("utf-8", "surrogatepass").lstrip(" \t\n\v\f\r")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of text; a row whose text loses all its words goes."""
    keys = _briefly_keyed(docs)
    found = _repeats(keys, window).toDF("__of", "__of_tag", "__runs")
    names, rest = docs.columns, [name for name in docs.columns if name != "text"]

    # the text is cut and judged in one pass: a filter on a column function's result would call it twice, with a second worker
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            null, blobs, runs = (column.to_pylist() for column in batch.columns[-3:])
            new = [without(unpack(b).decode("utf-8", "surrogatepass"), r, window) for b, r in zip(blobs, runs, strict=True)]
            columns = dict(zip(rest, batch.columns)) | {
                "text": pa.array([None if none else text for none, text in zip(null, new, strict=True)], pa.string())
            }
            kept = pa.array([r is None or bool(text) for r, text in zip(runs, new, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names=names).filter(kept)

    packed = keys.select(*rest, "__id", "__tag", F.col("text").isNull().alias("__null"), _pack("__text").alias("__packed"))
    joined = packed.join(found, (F.col("__id") == F.col("__of")) & (F.col("__tag") == F.col("__of_tag")), "left")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema])
    return joined.select(*rest, "__null", "__packed", "__runs").mapInArrow(run, schema)
