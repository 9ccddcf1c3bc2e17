"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text the encoder stores one number: the last token of
that prefix's encoding. It is unique, because a token can end a prefix only if it and
the last token of the rest would not have merged across their border. With the
last tokens at hand

* the encoding of the whole is read off backwards,
* appending bytes only adds entries,
* an edit only changes entries until the old ones hold again for as many positions as
  the longest token has bytes; from there on they are all the same as before.

Texts are first cut by the vocabulary's split pattern and each match is encoded on its
own, as the usual BPE libraries do. All matches of a portion of texts that weren't met
before advance together, one place at a time, through flat tables.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from granary.llm.common import held, id_and_text, portions, sha256_hex, tidied, utf8

#: Words whose codes a worker remembers from one portion of texts to the next, and the longest of them.
KNOWN_WORDS = 120_000
KNOWN_CHARACTERS = 64
#: Characters that are worked on at once.
PORTION = 1_000_000
#: Matches go together up to SHORT_BYTES, and from there to TOGETHER_BYTES; longer ones, and fewer than TOGETHER, one by one.
SHORT_BYTES = 64
TOGETHER_BYTES = 512
TOGETHER = 24

NEVER = 1 << 60
NONE = -1
_FITS_BITS = 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Non-negative keys and their values, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, NONE, np.int64), np.full(1 << bits, NONE, np.int32)
        at, open_ = self._home(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[at[open_]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[first]], values[free[first]]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = at[open_] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Their values, NONE for a key that isn't there."""
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            there = self.keys[at[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Read a file of ``base64(token) rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary: every single byte is a token, a lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        size = max(self.tokens) + 1
        # a token exists from the merge that makes it; single bytes are there from the start
        self.born = np.full(size, NONE, np.int64)
        self.left, self.right = np.full(size, NONE, np.int32), np.full(size, NONE, np.int32)
        self.length = np.zeros(size, np.int64)
        # trie: node times 256 plus byte to node, and the token of each node
        self._child: dict[int, int] = {}
        ends = [NONE]
        for token, rank in ranks.items():
            self.length[rank] = len(token)
            if len(token) > 1:
                self.born[rank] = rank
                halves = self.halves(rank)
                if halves is None:
                    continue  # the merges never lead to it
                self.left[rank], self.right[rank] = halves
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self._child.get(key, NONE)
                if node < 0:
                    node = self._child[key] = len(ends)
                    ends.append(NONE)
            ends[node] = rank
        self._ends = np.array(ends, np.int32)
        self._move = Table(np.fromiter(self._child, np.int64), np.fromiter(self._child.values(), np.int32))
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self._merge = Table(np.fromiter(pairs, np.int64), np.fromiter(pairs.values(), np.int32))
        self._asked = np.full(1 << _FITS_BITS, NONE, np.int64)
        # all tokens' bytes, one after the other
        self._bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._offset = np.cumsum(self.length) - self.length

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path))

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if the merges never lead to it."""
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= token:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do the merges leave two neighbours apart?

        Looks back in time: whichever of the two was made last is undone, and whatever
        then stands at the border must not merge before the moment of that undone merge.
        """
        answer = np.ones(len(left), bool)
        open_, a, b, until = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64), np.full(len(left), NEVER)
        while len(open_):
            rank = self._merge(a << 24 | b)
            merges = (rank >= 0) & (rank < until)
            answer[open_[merges]] = False
            born_a, born_b = self.born[a], self.born[b]
            undo_a = born_a > born_b
            # of two equal merges the left one comes first, so one at the border would precede b's
            until = np.where(undo_a, born_a, born_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            on = ~merges & (undo_a | (born_b >= 0))
            open_, a, b, until = open_[on], a[on], b[on], until[on]
        return answer

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same with a memory: a table of the last question of each place, with its answer in the lowest bit."""
        key = left.astype(np.int64) << 24 | right
        at = (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - _FITS_BITS)).astype(np.int64)
        said = self._asked[at]
        new = np.flatnonzero(said >> 1 != key)
        if len(new):
            said[new] = key[new] << 1 | self._apart(left[new], right[new])
            self._asked[at[new]] = said[new]
        return (said & 1).astype(bool)

    def extend(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Append to ``last`` the last tokens of data[:start+1] .. data[:stop].

        Goes through the places where a token can begin; what ends at such a place is
        settled before, as tokens that end there begin further left.
        """
        child, ends = self._child, self._ends
        last.extend([NONE] * (stop - start))
        for begin in range(max(0, start - self.longest + 1), stop):
            node, before, found = 0, last[begin - 1] if begin else NONE, []
            for end in range(begin, stop):
                node = child.get(node << 8 | data[end], NONE)
                if node < 0:
                    break
                if end >= start and last[end] == NONE and ends[node] >= 0:
                    found.append((end, int(ends[node])))
            if begin and found:
                tokens = np.array([token for _, token in found])
                fits = self.fits(np.full(len(tokens), before), tokens).tolist()
                found = [x for x, good in zip(found, fits, strict=True) if good]
            for end, token in found:
                last[end] = token
            if begin >= start and last[begin] == NONE:
                raise ValueError("the vocabulary has no token for a byte")

    def _last_tokens(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of every prefix of the pieces that begin at ``first``; they stand by falling size."""
        last = np.full(len(data), NONE, np.int32)
        widest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(widest), "left").tolist()
        for begin in range(widest):
            at = first[: active[begin]] + begin
            border = last[at - 1] if begin else None
            row, node = np.arange(len(at)), data[at].astype(np.int64)
            for end in range(begin, widest):
                node = self._move(node)
                there = np.flatnonzero(node >= 0)
                row, node = row[there], node[there].astype(np.int64)
                if not len(row):
                    break
                token, place = self._ends[node], at[row] + (end - begin)
                ask = np.flatnonzero((token >= 0) & (last[place] < 0))
                if begin and len(ask):
                    ask = ask[self.fits(border[row[ask]], token[ask])]
                last[place[ask]] = token[ask]
                if end + 1 == widest:
                    break
                n = np.searchsorted(row, active[end + 1])
                row = row[:n]
                node = node[:n] << 8 | data[place[:n] + 1]
            if (last[at] < 0).any():
                raise ValueError("the vocabulary has no token for a byte")
        return last

    def _encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of pieces that stand by falling size."""
        sizes = np.array(list(map(len, pieces)), np.int64)
        first = np.cumsum(sizes) - sizes
        last = self._last_tokens(np.frombuffer(b"".join(pieces), np.uint8), first, sizes)
        # read off backwards, all pieces one token at a time
        at, row, rows, tokens = first + sizes - 1, np.arange(len(pieces)), [], []
        while len(row):
            token = last[at[row]]
            rows.append(row)
            tokens.append(token)
            at[row] -= self.length[token]
            row = row[at[row] >= first[row]]
        counts = np.bincount(np.concatenate(rows), minlength=len(pieces))
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), "<u4")
        for nth, (row, token) in enumerate(zip(rows, tokens, strict=True)):
            ids[ends[row] - 1 - nth] = token
        code, stops = ids.tobytes(), (ends * 4).tolist()
        return [code[a:b] for a, b in zip([0, *stops], stops)]

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, as little-endian unsigned 32-bit integers; a piece that is a token itself stays whole."""
        whole = [self.ranks.get(piece, NONE) for piece in pieces]
        out = [b"" if rank < 0 else rank.to_bytes(4, "little") for rank in whole]
        rest = sorted((n for n, rank in enumerate(whole) if rank < 0 and pieces[n]), key=lambda n: -len(pieces[n]))
        for most, least in ((None, TOGETHER_BYTES), (TOGETHER_BYTES, SHORT_BYTES), (SHORT_BYTES, 0)):
            group = [n for n in rest if least < len(pieces[n]) and (most is None or len(pieces[n]) <= most)]
            if most is None or len(group) < TOGETHER:
                for n in group:
                    out[n] = np.array(PrefixCode(self, pieces[n]).ids(), "<u4").tobytes()
            else:
                for n, code in zip(group, self._encode_together([pieces[n] for n in group]), strict=True):
                    out[n] = code
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        return np.frombuffer(self.encode_all([piece])[0], "<u4").tolist()

    def decode_all(self, codes: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids (little-endian unsigned 32-bit integers): gathered token by token."""
        ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id that isn't in the vocabulary")
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        source = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(self._offset[ids] - (ends - sizes), sizes)
        data = self._bytes[source].tobytes()
        stops = np.append(0, ends)[np.cumsum([len(c) // 4 for c in codes], dtype=np.int64)].tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def decode(self, ids) -> bytes:
        return self.decode_all([np.array(ids, "<u4").tobytes()])[0]


class PrefixCode:
    """A piece of bytes with the last token of each of its prefixes; can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.vocabulary.extend(self.data, self.last, start, len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of data[start:stop]; returns how many positions were computed anew."""
        old, kept = self.last, self.last[:start]
        shift = start + len(data) - stop
        self.data = self.data[:start] + data + self.data[stop:]
        self.vocabulary.extend(self.data, kept, start, start + len(data))
        same, end = 0, start + len(data)
        while end < len(self.data) and same < self.vocabulary.longest:
            self.vocabulary.extend(self.data, kept, end, end + 1)
            same = same + 1 if kept[end] == old[end - shift] else 0
            end += 1
        self.last = kept + old[end - shift :]
        return end - start

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


#: White space of the split pattern: the Unicode property, not what Python counts as space.
_WHITE = r"\p{White_Space}"
#: A space beside other white space (Python's class holds all of the property).
_SPACE_BESIDE_SPACE = re.compile(r" \s|\s ")


def split_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", rf"[^{_WHITE}").replace(r"\s", _WHITE).replace(r"\S", rf"[^{_WHITE}]"))


def _words(text: str) -> list[str]:
    """The text cut at every space that stands between two characters that aren't white space."""
    words = text.split(" ")
    if words[0] and not text[0].isspace() and not text[-1].isspace() and not _SPACE_BESIDE_SPACE.search(text):
        return words
    out, open_ = [], []
    for word in words:
        if open_ and (not word or word[0].isspace() or not open_[-1] or open_[-1][-1].isspace()):
            open_.append(word)
        else:
            if open_:
                out.append(" ".join(open_))
            open_ = [word]
    return [*out, " ".join(open_)]


class Cutter:
    """Cuts texts by the split pattern and puts the values of all matches together.

    A space between two characters that aren't white space always opens a new match. So
    texts are cut there first; each different word of a portion of texts is looked at once, and
    a bounded number of words stays known for the next portion.
    """

    def __init__(self, pattern: str, values: Callable[[list[str]], list], total: Callable[[Iterable], object]):
        self.pattern, self.values, self.total = split_pattern(pattern), values, total
        self._known: dict = {}

    def __call__(self, texts: list[str]) -> list:
        out = []
        for start, stop in portions(texts, PORTION):
            out += self._portion(texts[start:stop])
        return out

    def _portion(self, texts: list[str]) -> list:
        cut, seen = [], set()
        for text in texts:
            words = _words(text)
            head, words[0] = words[0], ""
            cut.append((head, words))
            seen.update(words)
        known, matches = self._known, self.pattern.findall
        new = seen - known.keys()
        new.discard("")
        plain = [word for word in new if word.isalpha()]
        heads = {head: matches(head) for head, _ in cut}
        mixed = {word: matches(f" {word}") for word in new.difference(plain)}
        pieces = [f" {word}" for word in plain]
        pieces += {piece for found in (heads, mixed) for parts in found.values() for piece in parts}.difference(pieces)
        values, total = self.values(pieces), self.total
        of_piece = dict(zip(pieces, values, strict=True)).__getitem__
        known.update(zip(plain, values))
        for word, parts in mixed.items():
            known[word] = total(map(of_piece, parts))
        known[""] = total(())
        of_word = known.__getitem__
        out = [total((total(map(of_piece, heads[head])), total(map(of_word, words)))) for head, words in cut]
        if len(known) > KNOWN_WORDS:  # words of this portion are likely in the next one, too
            self._known = {word: known[word] for word in seen if len(word) <= KNOWN_CHARACTERS}
        else:
            for word in [w for w in new if len(w) > KNOWN_CHARACTERS]:
                del known[word]
        return out


class TextEncoder:
    """Whole texts: cut by the pattern, each match encoded on its own."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        #: texts -> ids of each, as little-endian unsigned 32-bit integers
        self.encode_texts = Cutter(pattern, lambda pieces: vocabulary.encode_all(list(map(utf8, pieces))), b"".join)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One per worker process."""
    return held(("bpe", path, pattern), lambda: TextEncoder(Vocabulary.load(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode the whole text of every document.

    ``path`` names a rank file that every executor can read. Returns doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes decoded from
    the ids) and, if asked for, the ids themselves as ``ids array<int>``. A null or empty
    text has no tokens. Rows are independent; nothing is shuffled.
    """

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(path, pattern)
        for batch in batches:
            rows, ids = [], []
            texts = batch.column(1).to_pylist()
            for start, stop in portions(texts, PORTION):
                codes = coder.encode_texts(texts[start:stop])
                for code, data in zip(codes, coder.vocabulary.decode_all(codes), strict=True):
                    rows.append((len(code) // 4, sha256_hex(code), sha256_hex(data)))
                if with_ids:
                    ids += [np.frombuffer(code, "<i4") for code in codes]
            n, coded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, schema)
