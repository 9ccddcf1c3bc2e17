"""Benchmark decontamination with suffix arrays over the training documents.

Every Arrow batch of documents is a shard: its words become numbers, and a suffix array
orders the places of the shard by the words that follow. Each suffix of the benchmark is
found in it by binary search, one word deeper at a time, which gives its
longest verbatim match and all locations. The benchmark is the side that is sent to
the shards; if it is larger than BLOCK_CHARS it goes there in blocks, one after the other; items of
more than SEGMENT_CHARS go in segments.

Only words of the benchmark get numbers. A place is indexed if at least as many
benchmark words follow as the shortest window has, since nothing shorter can match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower_words, id_and_text, release, sha256_hex, stored, tidied

WINDOW = 10
#: Characters of the benchmark that the driver holds, and sends to the tasks, at once.
BLOCK_CHARS = 4_000_000
#: Characters of an item from which on it goes in segments.
SEGMENT_CHARS = 2_000_000


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        return 0


class Block:
    """Windows of benchmark items: their words as numbers, and the items that each belongs to."""

    def __init__(self, items: list[tuple], window: int):
        """``items`` are (item, text), or (item, text, first word) of a segment."""
        self.numbers = _Numbers()
        found: dict[tuple[int, ...], set[str]] = {}
        self.items: list[tuple[str | None, np.ndarray]] = []
        self.first = [x[2] if len(x) > 2 else 0 for x in items]
        for item, text, *_ in items:
            words = ascii_lower_words(text)
            coded = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            self.items.append((item, np.array(coded, np.int64)))
            for at in range(max(1, len(coded) - window + 1) if coded else 0):
                owners = found.setdefault(tuple(coded[at : at + window]), set())
                if item is not None:
                    owners.add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for row, words in zip(self.words, found, strict=True):
            row[: len(words)] = words
        self.owners = [sorted(x) for x in found.values()]


class Shard:
    """Suffix array over the words of a batch of texts."""

    def __init__(self, texts: list[str], block: Block, depth: int):
        coded, sizes = [np.zeros(0, np.int32)], []
        number = block.numbers.__getitem__
        for text in texts:
            words = ascii_lower_words(text)
            sizes.append(len(words))
            coded.append(np.fromiter(map(number, words), np.int32, len(words)))
            coded.append(np.zeros(1, np.int32))  # no match goes from one document into the next
        self.sizes = np.array(sizes, np.int64)
        self.words = np.concatenate([*coded, np.zeros(depth + 1, np.int32)])
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        # the number of benchmark words from each place on
        zeros = np.where(self.words == 0, np.arange(len(self.words)), len(self.words))
        run = np.minimum.accumulate(zeros[::-1])[::-1] - np.arange(len(self.words))
        at = np.flatnonzero(run >= (block.lengths.min() if len(block.lengths) else 1))
        # several words to a sort key, the first ones in the highest bits
        bits = max(1, len(block.numbers)).bit_length()
        each = max(1, 62 // bits)
        keys = []
        for first in range(0, depth, each):
            key = np.zeros(len(at), np.int64)
            for d in range(first, min(first + each, depth)):
                key = key << bits | self._word(at, d, first > 0 or d > 0, run)
            keys.append(key)
        self.order = at[np.lexsort(keys[::-1])]
        self._run = run

    def _word(self, at: np.ndarray, d: int, check: bool, run: np.ndarray) -> np.ndarray:
        # behind the first word without a number a suffix counts as ended
        word = self.words[np.minimum(at + d, len(self.words) - 1)].astype(np.int64)
        return np.where(run[at] > d, word, 0) if check else word

    def _bound(self, low: np.ndarray, high: np.ndarray, d: int, word: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            value = self._word(self.order[np.minimum(middle, max(0, len(self.order) - 1))], d, True, self._run)
            below = open_ & (value <= word if right else value < word)
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched words, first, last + 1 place in the suffix order) of each row of numbers, 0 ending a row."""
        n = len(words)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        matched = np.zeros(n, np.int64)
        if not len(self.order):
            return matched, low, high
        alive = np.arange(n)
        for d in range(words.shape[1]):
            alive = alive[words[alive, d] > 0]
            if not len(alive):
                break
            word = words[alive, d]
            first = self._bound(low[alive], high[alive], d, word, False)
            last = self._bound(first, high[alive], d, word, True)
            good = last > first
            alive, first, last = alive[good], first[good], last[good]
            low[alive], high[alive] = first, last
            matched[alive] = d + 1
        return matched, low, high

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values low <= value < high of each row."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def match(texts: list[str], block: Block, window: int) -> list[tuple[int, list[int], list[str]]]:
    """(words, hit words' places, item ids) of each text."""
    shard = Shard(texts, block, window)
    matched, low, high = shard.search(block.words)
    whole = np.flatnonzero((matched == block.lengths) & (matched > 0))
    row, at = _expand(low[whole], high[whole])
    place, which = shard.order[at], whole[row]
    edge = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + block.lengths[which], -1)
    hit = np.flatnonzero(np.cumsum(edge) > 0)
    border = np.searchsorted(hit, np.append(shard.starts, len(shard.words)))
    places = [(hit[a:b] - start).tolist() for a, b, start in zip(border[:-1], border[1:], shard.starts.tolist(), strict=True)]
    items: list[set[str]] = [set() for _ in texts]
    if len(place):
        for doc, w in np.unique(np.column_stack([shard.document(place), which]), axis=0).tolist():
            items[doc].update(block.owners[w])
    return [(int(n), p, sorted(i)) for n, p, i in zip(shard.sizes, places, items, strict=True)]


def longest_matches(texts: list[str], block: Block, window: int) -> list[tuple[int, str | None, int, int, int]]:
    """(text, item id, word of the item, word of the text, words) of every maximal match of a window or more.

    Every suffix of every item is searched. Places of the text that stand one behind the other, for
    suffixes that do, too, are one match.
    """
    shard = Shard(texts, block, window)
    sizes = np.array([len(words) for _, words in block.items], np.int64)
    if not sizes.sum():
        return []
    end = np.cumsum(sizes + window)  # items end to end, with so many zeros behind each
    laid = np.zeros(int(end[-1]), np.int64)
    for (_, words), stop in zip(block.items, end.tolist(), strict=True):
        laid[stop - window - len(words) : stop - window] = words
    least = np.repeat(np.minimum(sizes, window), sizes + window)
    suffix = np.flatnonzero(laid)
    matched, low, high = shard.search(laid[suffix[:, None] + np.arange(window)])
    good = np.flatnonzero(matched >= least[suffix])
    row, at = _expand(low[good], high[good])
    item_word, place = suffix[good[row]], shard.order[at]
    order = np.lexsort((place, place - item_word))
    item_word, place = item_word[order], place[order]
    opens = np.ones(len(place), bool)
    opens[1:] = (place[1:] != place[:-1] + 1) | (item_word[1:] != item_word[:-1] + 1)
    head = np.flatnonzero(opens)
    n = np.diff(np.append(head, len(place))) - 1 + least[item_word[head]] if len(head) else head
    item = np.searchsorted(end, item_word[head], "right")
    doc = shard.document(place[head])
    found = zip(doc.tolist(), item.tolist(), (item_word[head] - (end - window - sizes)[item]).tolist(), (place[head] - shard.starts[doc]).tolist(), n.tolist(), strict=True)
    return sorted(((d, block.items[i][0], block.first[i] + a, b, k) for d, i, a, b, k in found), key=lambda x: (x[0], x[3], str(x[1]), x[2]))


def _segments(benchmark: DataFrame, window: int, chars: int) -> DataFrame:
    """item, first, text: each different item once, as its words; a long one in segments that overlap by a window less one word."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = ascii_lower_words(text)
                ends = np.cumsum([len(w) + 1 for w in words])
                start, rows = 0, []
                while not rows or start + window - 1 < len(words):
                    stop = max(start + window, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + chars, "right")))
                    rows.append((item, start, b" ".join(words[start:stop]).decode("utf-8", "surrogatepass")))
                    start = max(start + 1, stop - window + 1) if stop < len(words) else len(words)
                columns = zip(*rows, strict=True)
                types = [pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "first", "text"])

    picked = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    return picked.mapInArrow(run, "item string, first long, text string")


def _blocks(benchmark: DataFrame, window: int, block_chars: int, segment_chars: int = SEGMENT_CHARS) -> Iterator[list[tuple[str | None, str, int]]]:
    """Blocks of (item, words, first word) of bounded size, by a hash; each is collected when its turn comes."""
    picked = stored(_segments(benchmark, window, segment_chars))
    size = picked.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = max(1, -(-2 * size // block_chars) if size > block_chars else 1)
    for k in range(n):
        part = picked.where(F.pmod(F.xxhash64("text", "item", "first"), F.lit(n)) == k) if n > 1 else picked
        yield [(row.item, row.text, row.first) for row in part.select("item", "text", F.col("first")).collect()]


def locate_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All maximal verbatim matches of benchmark items in whole texts.

    Returns doc_id, item_id (as text), item_word and doc_word (where the match begins, words from
    0) and n_words: ``window`` words or more, or all of a shorter item. An item of more than SEGMENT_CHARS goes in segments, and a match
    over their border is two. A document without a match has no
    row; null texts have no words; a row of ``docs`` that repeats has its matches
    each time, a benchmark row that repeats is one.
    """
    schema = "doc_id long, item_id string, item_word long, doc_word long, n_words long"
    names, types = ["doc_id", "item_id", "item_word", "doc_word", "n_words"], [pa.int64(), pa.string(), *[pa.int64()] * 3]
    texts, found = id_and_text(docs), None

    def of(block: Block):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[doc], *rest) for doc, *rest in longest_matches(batch.column(1).to_pylist(), block, window)]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return run

    for items in _blocks(benchmark, window, block_chars):
        part = stored(texts.mapInArrow(of(Block(items, window)), schema))
        found = part if found is None else found.unionByName(part)
    return found


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """Words of each whole text that lie in a window of the benchmark.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is
    ``window`` consecutive words of an item, or all of a shorter one. Returns doc_id,
    n_words, n_hit (words inside any occurrence), n_items (items with occurring windows),
    items_sha256 (of their ids, sorted as strings, comma-joined) and contaminated. A null text has no
    words; a null item id hits but isn't listed; rows that repeat an item add nothing.
    """
    texts = id_and_text(docs)
    blocks = _blocks(benchmark, window, block_chars, segment_chars)
    first, second = Block(next(blocks), window), next(blocks, None)
    if second is None:
        return texts.mapInArrow(_hits(first, window), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")

    # each block marks the words that it hits; a document's marks are put together afterwards
    keyed = texts.withColumn("tag", F.xxhash64("text"))
    marked = None
    for block in chain([first, Block(second, window)], (Block(items, window) for items in blocks)):
        part = stored(keyed.mapInArrow(_marks(block, window), "doc_id long, tag long, places array<int>, items array<string>"))
        marked = part if marked is None else marked.unionByName(part)
    marks = marked.groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("of")).agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    n_hit, n_items = F.coalesce(F.size("places"), F.lit(0)), F.coalesce(F.size("items"), F.lit(0))
    return (
        keyed.mapInArrow(_counts, "doc_id long, tag long, n_words long")
        .join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")), "left")
        .select(
            "doc_id",
            "n_words",
            F.greatest(n_hit, F.lit(0)).cast("long").alias("n_hit"),
            F.greatest(n_items, F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def _hits(block: Block, window: int):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = match(batch.column(1).to_pylist(), block, window)
            columns = [
                batch.column(0),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([len(p) for _, p, _ in found], pa.int64()),
                pa.array([len(i) for _, _, i in found], pa.int64()),
                pa.array([sha256_hex(",".join(i).encode()) for _, _, i in found], pa.string()),
                pa.array([bool(p) for _, p, _ in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _marks(block: Block, window: int):
    """Of the texts that the block hits."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = match(batch.column(1).to_pylist(), block, window)
            hit = pa.array([bool(p) for _, p, _ in found], pa.bool_())
            columns = [pa.array([p for _, p, _ in found], pa.list_(pa.int32())), pa.array([i for _, _, i in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "tag", "places", "items"]).filter(hit)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = pa.array([len(ascii_lower_words(text)) for text in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["doc_id", "tag", "n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with all their columns.

    Each row is judged by its own text, whatever its id is or who shares it. A block of the benchmark leaves what it
    doesn't hit to the next one.
    """
    schema, left = docs.schema, docs
    blocks = _blocks(benchmark, window, block_chars)
    items, further = next(blocks), next(blocks, None)
    while items is not None:
        texts = left.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
        left = texts.mapInArrow(_clean(Block(items, window), window), schema)
        items, further = further, next(blocks, None)
        if items is not None:
            left = stored(left)
    return left


def _clean(block: Block, window: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = match(batch.column(batch.num_columns - 1).to_pylist(), block, window)
            kept = batch.filter(pa.array([not places for _, places, _ in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return run
