"""Byte-level repeats by longest-previous-factor arrays.

The longest previous factor of a position is the longest string from there that also starts
earlier. In suffix order it is shared with the nearest smaller position before or
after; so a position repeats an earlier one for ``length`` bytes or more if, among suffixes
equal in their first ``length`` bytes, one with a smaller position stands beside it.

In the arrays here the order is cut at ``length`` bytes, and equal strings stand by place. Then the
nearest smaller place of a copy is the one before it, and a first copy is a nearest smaller place of another.

One array over everything does not fit a cluster. Instead every string of ``length`` bytes
chooses an anchor inside it, the gram with the smallest hash; copies choose the same gram.
Consecutive strings with one anchor form a piece. Pieces that are equal as a whole are
settled by counting. Of each different piece whose gram occurs again one copy goes, with the
others of its gram, into a suffix array. A gram with very many different pieces sends
hashes of its strings instead, which spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import mixed, release, sha256_hex, stored, tidied, utf8
from granary.llm.substring import _M, ALONE, COPY, FURTHER, ONE_OF_SEVERAL, Ranges, _pack, keyed

LENGTH = 400
GRAM = 64
#: Different pieces of one gram up to which they go into a suffix array.
PIECES = 2000
#: Bytes of one suffix array, and of documents that are worked on at once.
ARRAY_BYTES = 1_000_000
PORTION = 1_000_000

_MOST_WINDOWS = 511
_PAD = b"\0" * 8


def _ranked(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Places of values, or of pairs of values, in their order; equal ones get equal places."""
    if second is not None:
        first = first.astype(np.int64) * (int(second.max(initial=0)) + 2) + second + 1
    return np.unique(first, return_inverse=True)[1]


def suffix_ranks(data: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` bytes; suffixes end at ``stop``, -1 where fewer remain.

    Prefix doubling from 8 bytes on. From 64 bytes on, positions before a gram that stands
    alone are left out: no string over it can repeat.
    """
    n = len(data)
    place = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.zeros(n, np.uint64)
    for d in range(min(8, length)):
        value = value << np.uint64(8) | padded[d : d + n].astype(np.uint64)
    known = min(8, length)
    rank = _ranked(value)
    rank[place + known > stop] = -1
    alive = np.flatnonzero(rank >= 0)
    while known < length and len(alive):
        step = min(known, length - known)
        ok = alive[alive + known + step <= stop[alive]]
        ok = ok[(rank[ok] >= 0) & (rank[ok + step] >= 0)]
        new = np.full(n, -1)
        if len(ok):
            new[ok] = _ranked(rank[ok], rank[ok + step])
            if known >= 32:  # a rank that stands alone can be dropped, and with it all that reach over it
                alone = np.bincount(new[ok]) == 1
                ok = ok[~alone[new[ok]]]
                keep = np.full(n, -1)
                keep[ok] = new[ok]
                new = keep
        rank, known, alive = new, known + step, ok
    return rank


def longest_previous_factors(data: bytes) -> list[int]:
    """For every position the length of the longest string that also starts earlier (overlaps count)."""
    n = len(data)
    if not n:
        return []
    rank = _ranked(np.frombuffer(data, np.uint8))
    known = 1
    while known < n and rank.max() < n - 1:
        after = np.full(n, -1)
        after[: n - known] = rank[known:]
        rank = _ranked(rank, after)
        known *= 2
    order = np.argsort(rank, kind="stable").tolist()
    before: list[int] = [-1] * n  # nearest smaller positions on both sides in suffix order
    behind: list[int] = [-1] * n
    stack: list[int] = []
    for position in order:
        while stack and stack[-1] > position:
            behind[stack.pop()] = position
        before[position] = stack[-1] if stack else -1
        stack.append(position)

    out = [0] * n
    for position in range(n):
        # the value falls by one at most from one position to the next
        size = max(0, out[position - 1] - 1) if position else 0
        for other in (before[position], behind[position]):
            if other >= 0:
                shared = size if data[other : other + size] == data[position : position + size] else 0
                while position + shared < n and data[other + shared] == data[position + shared]:
                    shared += 1
                out[position] = max(out[position], shared)
    return out


def pieces(data: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """(document, first string, number of strings, gram's hash, hash of all their text) of documents laid end to end."""
    n = len(data)
    offset = np.cumsum(sizes) - sizes
    document = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.arange(n) + length <= (offset + sizes)[document]
    if not whole.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ranges = Ranges(data.astype(np.uint64))
    grams = ranges(np.arange(n - gram + 1), np.arange(gram, n + 1))
    low = np.uint64((1 << 32) - 1)
    key = (mixed(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach, width = length - gram + 1, 1
    while width * 2 <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    place = np.full(n, -1)
    place[: len(key)] = (key & low).astype(np.int64)
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
    run = np.flatnonzero(change & whole)
    end = np.flatnonzero(np.append((change | ~whole)[1:], True) & whole) + 1
    parts = -(-(end - run) // _MOST_WINDOWS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    run, end = np.repeat(run, parts) + _MOST_WINDOWS * nth, np.repeat(end, parts)
    count = np.minimum(_MOST_WINDOWS, end - run)
    text = mixed(ranges(run, run + count + length - 1) + count.astype(np.uint64) * _M + (place[run] - run).astype(np.uint64))
    return document[run], run - offset[document[run]], count, grams[place[run]], text


def _joined(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, sizes) of portions of texts."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PORTION or k + 1 == len(texts):
            part = texts[start : k + 1]
            yield start, np.frombuffer(b"".join(part), np.uint8), np.array([len(x) for x in part], np.int64)
            start, size = k + 1, 0


def _previous(keys: tuple[np.ndarray, ...], ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each place the nearest smaller place beside it, in suffix order, that has the same keys; -1 without any.

    Equal strings stand in the order of their places, (id, start). So the nearest smaller place on the left is
    the one before, if it is equal, and none on the right is both smaller and equal.
    """
    order = np.lexsort((start, ids, *keys[::-1]))
    equal = np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0)
    equal &= (ids[order][1:] != ids[order][:-1]) | (start[order][1:] != start[order][:-1])
    before = np.full(len(order), -1)
    before[order[1:][equal]] = order[:-1][equal]
    return before


def _settle(keys: tuple[np.ndarray, ...], ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Has a place an earlier copy; does it stand at several places, that is, has it one or is it one?"""
    before = _previous(keys, ids, start)
    copy = before >= 0
    several = copy.copy()
    several[before[copy]] = True
    return copy, several


def _piece_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """name, span, id, packed: the gram, hash of the text, document; and start, strings, kind and repeated."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, parts = np.array(batch.column(0), np.int64), []
            for first, data, sizes in _joined([utf8(x) for x in batch.column(1).to_pylist()]):
                doc, *rest = pieces(data, sizes, length, gram)
                parts.append((doc + first, *rest))
            if not parts:
                continue
            doc, start, count, name, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            copy, several = _settle((name, span), ids[doc], start)
            kind = np.where(copy, COPY, ALONE)
            rest = np.flatnonzero(~copy)
            order = rest[np.argsort(name[rest], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = name[order][1:] != name[order][:-1]
            kind[order] = np.where(new, np.where(np.append(new[1:], True), ALONE, ONE_OF_SEVERAL), FURTHER)
            packed = start << 12 | count << 3 | kind * 2 + several
            columns = [pa.array(x) for x in (name.view(np.int64), span.view(np.int64), ids[doc], packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "span", "id", "packed"])

    return docs.mapInArrow(run, "name long, span long, id long, packed long")


def _field(name: str) -> Column:
    packed = F.col("packed")
    return {
        "start": F.shiftright(packed, 12),
        "count": F.shiftright(packed, 3).bitwiseAND(F.lit(511)),
        "kind": F.shiftright(packed, 1).bitwiseAND(F.lit(3)),
        "several": packed.bitwiseAND(F.lit(1)) == 1,
    }[name]


def _parts_of_texts(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The text of listed pieces, or for hot grams two hashes of each of their strings.

    name, h2, id, start, count, known, text: with text null, name and h2 are hashes of one string.
    ``known`` pieces are there to be compared with; what they hold is settled.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            plain: list[tuple] = []
            hot = []
            for id_, blob, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack(blob)
                ranges = None
                for x in listed:
                    start, count = x["start"], x["count"]
                    if x["hot"]:
                        ranges = ranges or [Ranges(np.frombuffer(data, np.uint8).astype(np.uint64), salt) for salt in (1, 2)]
                        at = np.arange(start, start + count)
                        both = [r(at, at + length) for r in ranges]
                        hot.append((*both, np.full(count, id_), at, np.full(count, x["known"])))
                    else:
                        plain.append((x["name"], 0, id_, start, count, x["known"], data[start : start + count + length - 1]))
            if hot:
                h1, h2, id_, at, known = (np.concatenate(x) for x in zip(*hot, strict=True))
                # of equal strings of this batch the first one says all that others need to know
                copy, several = _settle((h1, h2), id_, at)
                gone = copy if keep_first else several
                keep = ~copy | (gone & ~known)
                out = zip(
                    h1.view(np.int64)[keep].tolist(), h2.view(np.int64)[keep].tolist(), id_[keep].tolist(), at[keep].tolist(),
                    # a negative count: to be removed, as the batch shows
                    np.where(gone, -1, 1)[keep].tolist(), known[keep].tolist(), strict=True,
                )
                plain += [(*x, None) for x in out]
            if plain:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                names = ["name", "h2", "id", "start", "count", "known", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*plain, strict=True), types, strict=True)], names=names)

    return docs.mapInArrow(run, "name long, h2 long, id long, start long, count int, known boolean, text binary")


def _repeated(rows: list[dict], length: int, keep_first: bool) -> list[tuple[int, int, int]]:
    """(id, first string, number of strings) that stand at several places of these rows, or have an earlier copy."""
    out = []
    plain = rows
    if plain:
        data = np.frombuffer(b"".join(r["text"] for r in plain), np.uint8)
        sizes = np.array([len(r["text"]) for r in plain], np.int64)
        offset = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(plain)), sizes)
        ids = np.array([r["id"] for r in plain], np.int64)
        start = np.array([r["start"] for r in plain], np.int64)
        rank = suffix_ranks(data, (offset + sizes)[owner], length)
        at = np.flatnonzero(rank >= 0)
        if len(at):
            where = start[owner[at]] + at - offset[owner[at]]
            copy, several = _settle((rank[at],), ids[owner[at]], where)
            known = np.array([r["known"] for r in plain])
            at = at[(copy if keep_first else several) & ~known[owner[at]]]
            if len(at):
                opens = np.ones(len(at), bool)
                opens[1:] = (at[1:] != at[:-1] + 1) | (owner[at][1:] != owner[at][:-1])
                head = np.flatnonzero(opens)
                for i, n in zip(at[head].tolist(), np.diff(np.append(head, len(at))).tolist(), strict=True):
                    r = plain[owner[i]]
                    out.append((r["id"], r["start"] + i - int(offset[owner[i]]), n))
    return out


def _compared(parts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """id, run: strings that are to be removed; all rows of a name, PIECES at most, meet in one task, in turn."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[dict]) -> pa.RecordBatch:
            found = _repeated(rows, length, keep_first)
            columns = [[x[0] for x in found], [x[1] << 9 | min(x[2], _MOST_WINDOWS) for x in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "run"])

        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= ARRAY_BYTES and row["name"] != held[-1]["name"]:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["text"]) + 40
        if held:
            yield answer(held)

    return parts.repartition("name").sortWithinPartitions("name").mapInArrow(run, "id long, run long")


def _counted(hashed: DataFrame, keep_first: bool) -> DataFrame:
    """The same of strings that are hashed one by one. Their first and last places are partial aggregates, so a string that stands
    everywhere is never gathered; the join back is one that adaptive execution can split."""
    place = F.struct("id", "start")
    ends = hashed.groupBy("name", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    gone = (place != F.col("low")) if keep_first else (F.col("low") != F.col("high"))
    run = (F.shiftleft("start", 9) + 1).alias("run")
    later = hashed.where("count > 0 AND NOT known").join(ends, ["name", "h2"]).where(gone).select("id", run)
    return hashed.where("count < 0 AND NOT known").select("id", run).unionByName(later)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """id (of ``_named``) and runs (first string times 512 plus number of strings) that start at several places.

    With ``keep_first`` only those that have an earlier copy, in the order of ``_named`` and place.
    """
    texts = _named(docs).select("__id", "__text")
    rows = _piece_rows(texts, length, min(gram, length))
    kind, start = _field("kind"), _field("start")
    rows = rows.withColumn(
        "part",  # settled copies go anywhere
        F.when(kind == FURTHER, F.xxhash64("name", "span")).when(kind == COPY, F.xxhash64("id", "packed")).otherwise(F.col("name")),
    )
    group = Window.partitionBy("part").orderBy("span", "id", "packed").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy("part", "span").orderBy("id", "packed").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(Window.partitionBy("part", "span").orderBy("id", "packed"))
    head = F.first("id").over(same), F.shiftright(F.first("packed").over(same), 12)
    other = (F.col("id"), start) if keep_first else (F.last("id").over(same), F.shiftright(F.last("packed").over(same), 12))
    gone = (head[0] != other[0]) | (head[1] != other[1]) | (kind == COPY if keep_first else _field("several"))
    settled = stored(
        rows.withColumn("n", F.count("*").over(group))
        .withColumn("copy", gone)
        .withColumn("stands", (kind != COPY) & (nth == 1) & ((F.col("n") > 1) | kind.isin(ONE_OF_SEVERAL, FURTHER)))
        .where("copy or stands")
        .select("name", "id", start.alias("start"), _field("count").alias("count"), "copy", "stands")
    )
    standing = settled.where("stands")
    hot = standing.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > PIECES).select("name")
    packed = texts.select(F.col("__id").alias("id"), _pack("__text").alias("text")).dropDuplicates(["id"])

    flagged = standing.join(hot.withColumn("hot", F.lit(True)), "name", "left")
    piece = F.struct("name", "start", "count", F.col("copy").alias("known"), F.coalesce("hot", F.lit(False)).alias("hot"))
    listed = flagged.groupBy("id").agg(F.collect_list(piece).alias("listed"))
    parts = stored(_parts_of_texts(packed.join(listed, "id").select("id", "text", "listed"), length, keep_first))
    single = _compared(parts.where("text IS NOT NULL"), length, keep_first)
    single = single.unionByName(_counted(parts.where("text IS NULL").drop("text"), keep_first))
    whole = settled.where("copy").select("id", (F.shiftleft("start", 9) + F.col("count")).alias("run"))
    return whole.unionByName(single).groupBy("id").agg(F.collect_list("run").alias("runs"))


def _named(docs: DataFrame) -> DataFrame:
    """The rows with ``__text``, null as empty, and ``__id``, a hash of id and text: rows that repeat share it."""
    return keyed(docs).withColumn("__id", F.xxhash64("__id", "__text"))


def covered(n: int, runs: list[int] | None, length: int) -> np.ndarray:
    """Which of n bytes lie in a string of the runs."""
    edge = np.zeros(n + 1, np.int64)
    if runs:
        run = np.array(runs, np.int64)
        np.add.at(edge, run >> 9, 1)
        np.add.at(edge, (run >> 9) + (run & 511) - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Bytes of each whole text that lie in a string of ``length`` bytes which also starts elsewhere.

    Texts are UTF-8; matches never cross documents but count within one, overlaps too. All copies
    go, the first one as well; strings are judged on the input. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256 of the remaining bytes. A null text is
    empty. Each row is a document, with or without an id: a row that repeats stands elsewhere with all its strings.
    """
    found = repeats(docs, length, gram)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for blob, runs, several in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = unpack(blob)
                gone = np.ones(len(data), bool) if several and len(data) >= length else covered(len(data), runs, length)
                if gone.any():
                    edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    rows.append((len(data), len(data) - len(kept), int((edges == 1).sum()), sha256_hex(kept)))
                else:
                    rows.append((len(data), 0, 0, sha256_hex(data)))
            n, removed, spans, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    named = _named(docs)
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), "__id", _pack("__text").alias("text"))
    several = named.groupBy(F.col("__id").alias("twice")).agg(F.count("*").alias("n")).where("n > 1")
    joined = texts.join(found, F.col("__id") == F.col("id"), "left").join(several, F.col("__id") == F.col("twice"), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("doc_id", "text", "runs", F.col("n").isNotNull().alias("several")).mapInArrow(run, schema)


def remove_later_copies(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and kept, the UTF-8 bytes of each text without those that a string with an earlier copy covers.

    The first copy of every string stays: documents stand in the order of a hash of id and text, strings of one
    document from left to right. Rows that repeat are one document and get the same bytes.
    """
    found = repeats(docs, length, gram, keep_first=True)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept = []
            for blob, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(unpack(blob), np.uint8)
                kept.append(data[~covered(len(data), runs, length)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    texts = _named(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "__id", _pack("__text").alias("text"))
    joined = texts.join(found, F.col("__id") == F.col("id"), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "doc_id long, kept binary")
