"""Alignment of two tokenizers' tokens of the same text.

Places where a token of either begins with a space and both have a token end before it are anchors: they
cut the document into windows of few tokens. A window's alignment depends on its token ids alone, so it is worked out
once for each pair of id tuples, and remembered.

Both tokenizers always have such a place at a space behind something that is no white space, if no match of A's pattern and no
piece of B goes over it. So a text is cut there, into units, and the ids of each different unit are worked out once and
remembered. Where a tokenizer doesn't keep a unit byte for byte, or a piece does go over such a space, both encode the whole text.

A pair of tokens is linked where both end at the same byte. How often a pair is linked is counted over the
corpus. Of two linked tokens one is the end of the other, so there are no more pairs than the vocabularies have
token ends (``pair_bound``), whatever the corpus: the counts may go to the driver and to all tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, held, id_and_text, mixed, portions, stored, tidied, utf8

#: Windows that a worker remembers, and the longest of them (bytes of ids).
KNOWN_WINDOWS = 250_000
KNOWN_BYTES = 256
#: Characters that are tokenised at once, and units.
PORTION = 500_000
UNITS = 64
#: From a space on up to the next one behind something that is no white space. Python's white space holds all of the pattern's.
_UNIT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: A piece that goes over such a space.
_OVER = re.compile(r"\S ")
#: Fixed by the piece format: the mark of a space.
_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_level_tokens(path: str) -> tuple[list[bytes], set[int]]:
    """Bytes of each id of a byte-level ``tokenizer.json``, and the ids of its special tokens. Its ids are in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    letters = byte_letters()
    tokens = {i: bytes(letters[c] for c in token) for token, i in described["model"]["vocab"].items()}
    special = {x["id"]: utf8(x["content"]) for x in described["added_tokens"]}
    tokens |= special
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)], set(special)


def piece_tokens(pieces) -> list[bytes]:
    """Bytes of each id of a piece model."""
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    return [bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else utf8(name.replace(_MARK, " ")) for i, name in enumerate(names)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """No more pairs than this can be linked: of each pair one token is an end of the other."""
    of_a, of_b = {}, {}
    for of, tokens in ((of_a, a), (of_b, b)):
        for token in tokens:
            of[token] = of.get(token, 0) + 1
    ends = lambda token: (token[i:] for i in range(len(token)))
    longer = sum(of_a.get(end, 0) for token in b for end in ends(token))
    return longer + sum(of_b.get(end, 0) for token in a for end in ends(token) if len(end) < len(token))


class Aligner:
    """Both tokenizers, and the alignments of windows met before."""

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        self.tokens_a, special = byte_level_tokens(byte_level)
        ranks = {token: i for i, token in enumerate(self.tokens_a) if token and i not in special}
        self._a = tiktoken.Encoding("A", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.tokens_b = piece_tokens(self._b)
        self._sizes_a, self._sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.tokens_a, self.tokens_b))
        self._bytes = [
            (np.frombuffer(b"".join(t), np.uint8), sizes, np.cumsum(sizes) - sizes)
            for t, sizes in ((self.tokens_a, self._sizes_a), (self.tokens_b, self._sizes_b))
        ]
        self._open_a, self._open_b = (np.array([x[:1] == b" " for x in t]) for t in (self.tokens_a, self.tokens_b))
        self._decimal = list(map(str, range(max(len(self.tokens_a), len(self.tokens_b)))))
        #: A link's number is the A id times this, plus the B id.
        self.factor = len(self.tokens_b)
        self._windows: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
        #: The same of units, behind the numbers of their tokens.
        self._units: dict[str, tuple[int, int, bytes, bytes]] = {}
        #: The pattern's words don't go over a space, and neither does a piece.
        names = (self._b.id_to_piece(i).replace(_MARK, " ") for i in range(self.factor))
        self._in_units = pattern == public_tokenizers.PATTERN and not any(map(_OVER.search, names))

    def _kept(self, ids: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, first: np.ndarray, want: bytes) -> bool:
        """Are the bytes of all tokens, one after the other, those of the text?"""
        size = sizes[ids]
        ends = np.cumsum(size)
        if int(ends[-1]) != len(want):
            return False
        return tokens[np.arange(len(want)) + np.repeat(first[ids] - (ends - size), size)].tobytes() == want

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each whole text by either tokenizer; none where the tokens' bytes aren't those of the text."""
        out, none = [], np.zeros(0, np.int64)
        for text, b in zip(texts, self._b.encode(texts, num_threads=1), strict=True):
            if not text:
                out.append((none, none))
                continue
            want = f" {text}"
            pair = self._a.encode_to_numpy(want, allowed_special=set(), disallowed_special=()).astype(np.int64), np.array(b, np.int64)
            good = len(b) and all(self._kept(ids, *known, utf8(want)) for ids, known in zip(pair, self._bytes, strict=True))
            out.append(pair if good else (none, none))
        return out

    def _align(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """(groups, links) of each window. All are laid end to end; tokens of either side that end together end a group."""
        ids_a, ids_b = (np.frombuffer(b"".join([w[n] for w in windows]), np.int32) for n in (0, 1))
        end_a, end_b = np.cumsum(self._sizes_a[ids_a]), np.cumsum(self._sizes_b[ids_b])
        at = np.minimum(np.searchsorted(end_b, end_a), max(0, len(end_b) - 1))
        last_a = np.flatnonzero(end_b[at] == end_a)
        last_b = at[last_a]
        links = (ids_a[last_a].astype(np.int64) * self.factor + ids_b[last_b]).astype("<u4").tobytes()
        text_a = list(map(self._decimal.__getitem__, ids_a.tolist()))
        text_b = list(map(self._decimal.__getitem__, ids_b.tolist()))
        stop_a, stop_b = (last_a + 1).tolist(), (last_b + 1).tolist()
        groups = [
            f"{text_a[i]}|{text_b[j]}" if m == i + 1 and n == j + 1 else f"{','.join(text_a[i:m])}|{','.join(text_b[j:n])}"
            for i, m, j, n in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b)
        ]
        # the last token of a window ends its last group
        stops = (np.searchsorted(last_a, np.cumsum([len(a) // 4 for a, _ in windows]) - 1) + 1).tolist()
        return [(";".join(groups[i:m]).encode(), links[4 * i : 4 * m]) for i, m in zip([0, *stops], stops)]

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token places of either side where windows begin: both end a token before it, and open one with a space there."""
        place_a, place_b = np.cumsum(self._sizes_a[a]) - self._sizes_a[a], np.cumsum(self._sizes_b[b]) - self._sizes_b[b]
        open_a, open_b = np.flatnonzero(self._open_a[a]), np.flatnonzero(self._open_b[b])
        there = np.searchsorted(place_b[open_b], place_a[open_a])
        shared = np.append(place_b[open_b], -1)[there] == place_a[open_a]
        return open_a[shared], open_b[there[shared]]

    def _different(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first window of each kind, kind of each window): windows of the same ids are of one kind."""
        hashes, size = np.zeros(len(cut_a), np.uint64), []
        for ids, cut, salt in ((a, cut_a, 1), (b, cut_b, 2)):
            size.append(np.diff(np.append(cut, len(ids))))
            nth = np.arange(len(ids)) - np.repeat(cut, size[-1])
            hashes = mixed(hashes + np.add.reduceat(mixed((ids << 16 | nth).astype(np.uint64) + np.uint64(salt << 60)), cut))
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        # hashes only propose: ids decide
        for ids, cut, n in ((a, cut_a, size[0]), (b, cut_b, size[1])):
            lead = first[kind]
            if not (np.array_equal(n[lead], n) and np.array_equal(ids[np.arange(len(ids)) + np.repeat(cut[lead] - cut, n)], ids)):
                return np.arange(len(cut_a)), np.arange(len(cut_a))
        return first, kind

    def _coded(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of units, many at a time; each alone where a tokenizer doesn't keep all of them."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(units)
        parts = [units[n : n + UNITS] for n in range(0, len(units), UNITS)]
        pairs = self.encode(["".join(part)[1:] for part in parts])
        kept = [n for n, (a, _) in enumerate(pairs) if len(a)]
        if kept:
            start = np.cumsum([0, *(len(utf8(unit)) for n in kept for unit in parts[n])])
            of = []
            for k, sizes in ((0, self._sizes_a), (1, self._sizes_b)):
                ids = np.concatenate([pairs[n][k] for n in kept])
                place = np.append(0, np.cumsum(sizes[ids]))
                cut = np.searchsorted(place, start)
                if not np.array_equal(place[np.minimum(cut, len(place) - 1)], start):  # a token goes over a border: whole texts, then
                    return [None] * len(units)
                data, cut = ids.astype(np.int32).tobytes(), (cut * 4).tolist()
                of.append([data[i:m] for i, m in zip(cut, cut[1:])])
            for n, pair in zip((n * UNITS + k for n in kept for k in range(len(parts[n]))), zip(*of, strict=True), strict=True):
                out[n] = pair
        alone = [n * UNITS + k for n, (a, _) in enumerate(pairs) if not len(a) for k in range(len(parts[n]))]
        for n, (a, b) in zip(alone, self.encode([units[n][1:] for n in alone]) if alone else (), strict=True):
            out[n] = (a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()) if len(a) else None
        return out

    def _rows_of(self, units: list[str]) -> list[tuple[int, int, bytes, bytes] | None]:
        """(A tokens, B tokens, groups, links) of different units, from memory or worked out together. A unit that a tokenizer
        doesn't keep, or that ends in white space (the last of a text), has none."""
        known = self._units
        found = list(map(known.get, units))
        new = [n for n, x in enumerate(found) if x is None and not units[n][-1].isspace()]
        coded = [(n, ids) for n, ids in zip(new, self._coded([units[n] for n in new]) if new else (), strict=True) if ids]
        for (n, (a, b)), x in zip(coded, self.windows([ids for _, ids in coded]), strict=True):
            found[n] = row = (len(a) // 4, len(b) // 4, *x)
            if len(units[n]) <= KNOWN_BYTES:
                known[units[n]] = row
        if len(known) > KNOWN_WINDOWS:
            known.clear()
        return found

    def align(self, texts: list[str]) -> list[tuple[int, int, bytes, bytes]]:
        """(A tokens, B tokens, groups as ``a1,a2|b1;a3|b2``, links as little-endian unsigned 32-bit numbers) of whole texts."""
        if not self._in_units:
            return self._align_whole(texts)
        cut = [_UNIT.findall(f" {text}") if text else [] for text in texts]
        every = list(chain.from_iterable(cut))
        number = {unit: n for n, unit in enumerate(dict.fromkeys(every))}
        rows = self._rows_of(list(number))
        n_a, n_b = (np.array([0 if x is None else x[n] for x in rows], np.int64) for n in (0, 1))
        groups, links = ([b"" if x is None else x[n] for x in rows] for n in (2, 3))
        kinds = list(map(number.__getitem__, every))
        kind, edge = np.array(kinds, np.int64), np.cumsum([0, *map(len, cut)])
        sums = [np.diff(np.append(0, np.cumsum(x))[edge]).tolist() for x in (n_a[kind], n_b[kind], n_a[kind] == 0)]
        groups, links, at = list(map(groups.__getitem__, kinds)), list(map(links.__getitem__, kinds)), edge.tolist()
        out = [(a, b, b";".join(groups[i:m]), b"".join(links[i:m])) for a, b, i, m in zip(*sums[:2], at, at[1:])]
        whole = [n for n, x in enumerate(sums[2]) if x]
        for n, x in zip(whole, self._align_whole([texts[n] for n in whole]) if whole else (), strict=True):
            out[n] = x
        return out

    def _align_whole(self, texts: list[str]) -> list[tuple[int, int, bytes, bytes]]:
        """The same, by tokens of the whole texts."""
        coded = self.encode(texts)
        a, b = (np.concatenate([np.zeros(0, np.int64), *(pair[n] for pair in coded)]) for n in (0, 1))
        if not len(a):
            return [(0, 0, b"", b"")] * len(texts)
        cut_a, cut_b = self.anchors(a, b)  # every text begins with a space
        first, kind = self._different(a, b, cut_a, cut_b)
        all_a, all_b = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()
        next_a, next_b = np.append(cut_a[1:], len(a)) * 4, np.append(cut_b[1:], len(b)) * 4
        of = [x[first].tolist() for x in (cut_a * 4, next_a, cut_b * 4, next_b)]
        found = self.windows([(all_a[i:m], all_b[j:n]) for i, m, j, n in zip(*of, strict=True)])
        groups, links = ([found[k][n] for k in kind.tolist()] for n in (0, 1))
        edge = np.searchsorted(cut_a, np.cumsum([0, *(len(x) for x, _ in coded)])).tolist()
        return [
            (len(x), len(y), b";".join(groups[i:m]), b"".join(links[i:m])) for (x, y), i, m in zip(coded, edge, edge[1:])
        ]

    def windows(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """(groups, links) of windows, from memory or worked out together."""
        known = self._windows
        found = list(map(known.get, keys))
        new = [n for n, x in enumerate(found) if x is None]
        for n, x in zip(new, self._align([keys[n] for n in new]) if new else (), strict=True):
            found[n] = x
            if len(keys[n][0]) <= KNOWN_BYTES:
                known[keys[n]] = x
        if len(known) > KNOWN_WINDOWS:
            known.clear()
        return found


def aligner(byte_level: str, pieces: str, pattern: str) -> Aligner:
    """One per worker process."""
    return held(("alignment", byte_level, pieces, pattern), lambda: Aligner(byte_level, pieces, pattern))


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, groups string"


def aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str, with_groups: bool = False) -> DataFrame:
    """Tokens of both tokenizers of each whole text, in groups, with their links.

    ``links`` has a 32-bit number for each link, zstandard-compressed; ``groups`` is the text of all groups,
    if asked for. Rows are independent; nothing is shuffled.
    """
    names = [x.split()[0] for x in _ALIGNED.split(", ")][: 7 if with_groups else 6]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, pack = aligner(byte_level, pieces, pattern), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for start, stop in portions(texts, PORTION):
                for a, b, groups, links in tool.align(texts[start:stop]):
                    digest = hashlib.sha256(groups).hexdigest() if a else ""
                    rows.append((a, b, len(links) // 4, digest, pack(links), *[groups.decode()] * with_groups))
            columns = zip(*rows, strict=True) if rows else [()] * (len(names) - 1)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=names)

    return id_and_text(docs).mapInArrow(run, _ALIGNED if with_groups else _ALIGNED.rpartition(", ")[0])


def _numbers(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(links of all rows, links of each row)."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(unpack(x), "<u4") for x in blobs.to_pylist()]
    return np.concatenate([np.zeros(0, "<u4"), *parts]), np.array([len(x) for x in parts], np.int64)


def link_counts(aligned_docs: DataFrame) -> DataFrame:
    """pair and n: how many links of the corpus hold each pair. A task sends a row for each of its different pairs."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs, n = np.unique(_numbers(batch.column(0))[0].astype(np.int64), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    rows = aligned_docs.select("links").mapInArrow(run, "pair long, n long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """Links between the tokens that two tokenizers make of every whole text.

    ``byte_level`` is a ``tokenizer.json`` (A, which gets a space and the text) with its split pattern, ``pieces`` a piece
    model (B, which adds that space). Byte offsets where tokens of both end cut them into groups; the two tokens that end there
    are linked. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count over the corpus is
    the highest of its B id), count_sum (of the links' counts) and groups_sha256 (of
    ``a1,a2|b1;a3|b2,b3``). A text that is null or empty, or that either tokenizer doesn't keep byte
    for byte, has no tokens: zeros, and an empty groups_sha256. A null doc_id stays null. Rows that repeat count as often as they
    stand there.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = stored(aligned(docs, byte_level, pieces, pattern))
    table = link_counts(found).toArrow()  # bounded by pair_bound
    pairs, counts = (np.asarray(table.column(i).combine_chunks(), np.int64) for i in (0, 1))
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    factor = Aligner(byte_level, pieces, pattern).factor
    most = np.zeros(factor, np.int64)
    np.maximum.at(most, pairs % factor, counts)
    known = spark.sparkContext.broadcast((pairs.astype(np.uint32), counts, counts == most[pairs % factor]))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            links, sizes = _numbers(batch.column("links"))
            at = np.searchsorted(pairs, links)
            ends = np.append(0, np.cumsum(sizes))
            sums = [np.append(0, np.cumsum(x[at]))[ends] for x in (best.astype(np.int64), counts)]
            n_best, total = (pa.array(np.diff(x)) for x in sums)
            kept = {name: batch.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups")}
            kept |= {"n_links": batch.column("n_groups"), "n_best": n_best, "count_sum": total, "groups_sha256": batch.column("groups_sha256")}
            yield pa.RecordBatch.from_pydict(kept)

    return found.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
